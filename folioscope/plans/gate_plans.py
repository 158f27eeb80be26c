"""Rule gates over the derived notes, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import gates as G
from ..operators import parsing as P
from .fixtures import notes, pages_rich, with_notes, with_rich
from .link_graph_plans import KEYS
from .registry import plan, table
from .text_plans import FM_ROWS, LINKS, prose_sql, sq

SLUGS = ["атлас", "орион"]
OKHEAD = "k % 97 <> 0 AND k % 89 <> 0 AND k % 83 <> 0 AND k % 79 <> 0"
TYPE = "CASE k % 8 WHEN 0 THEN 'concept' WHEN 1 THEN 'tool-card' WHEN 2 THEN 'decision' WHEN 3 THEN 'synthesis' WHEN 4 THEN 'agent-research' WHEN 5 THEN 'reference' WHEN 6 THEN 'tool-map' ELSE 'old-digest' END"
_BODY = r"CASE WHEN k % 97 = 0 OR k % 89 = 0 THEN text ELSE regexp_replace(text, '^(?s:---\n.*?\n---\n)', '') END"
_SHARE = rf"""sh AS (SELECT k, CASE WHEN cyr + lat > 0 THEN cyr / (cyr + lat) ELSE 0 END AS share FROM (SELECT k, length(regexp_replace(p, '[^А-Яа-яЁё]', '', 'g')) AS cyr, length(regexp_replace(p, '[^A-Za-z]', '', 'g')) AS lat
   FROM (SELECT k, regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)```.*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), 'https?://\S+', ' ', 'g') AS p FROM notes)))"""
SPEC = f""", {FM_ROWS}, {_SHARE}, n AS (SELECT notes.path, k, share, fm_error, {TYPE} AS ty FROM notes JOIN sh USING (k) JOIN heads USING (path)),
 f AS (SELECT path, 'head' AS rule, fm_error AS detail FROM n WHERE fm_error IS NOT NULL
  UNION ALL SELECT path, 'source', NULL FROM n WHERE fm_error IS NULL AND k % 9 = 0
  UNION ALL SELECT path, 'type', ty FROM n WHERE fm_error IS NULL AND k % 8 IN (6, 7)
  UNION ALL SELECT path, 'verified', CASE k % 5 WHEN 2 THEN 'true' WHEN 3 THEN 'false' ELSE 'непроверяемо-методом (видео)' END FROM n WHERE fm_error IS NULL AND k % 5 IN (2, 3, 4)
  UNION ALL SELECT path, 'subject', 'planet' FROM n WHERE fm_error IS NULL AND k % 4 = 3
  UNION ALL SELECT path, 'subject-self-foreign', NULL FROM n WHERE fm_error IS NULL AND k % 4 = 1 AND k % 3 = 0
  UNION ALL SELECT path, 'categories-unknown', 'данные | unknown-kind' FROM n WHERE fm_error IS NULL AND k % 6 = 0
  UNION ALL SELECT path, 'data-class', 'secret' FROM n WHERE fm_error IS NULL AND k % 10 = 7
  UNION ALL SELECT path, 'script-share', printf('%.1f%%', share * 100) FROM n WHERE share < 0.3
  UNION ALL SELECT path, 'help-no-project', NULL FROM n WHERE k % 4 = 1
  UNION ALL SELECT path, 'trust-missing', NULL FROM n WHERE k % 11 = 0
  UNION ALL SELECT path, 'trust-empty', NULL FROM n WHERE k % 11 <> 0 AND k % 13 = 0 AND k % 6 <> 0
  UNION ALL SELECT path, 'required-field', 'tool-card: ' || x FROM n, (SELECT unnest(['repo', 'stars', 'license', 'risk']) AS x) WHERE fm_error IS NULL AND ty = 'tool-card' AND k % 12 <> 0
  UNION ALL SELECT path, 'required-field', 'agent-research: ' || x FROM n, (SELECT unnest(['project', 'agent', 'claim_status']) AS x) WHERE fm_error IS NULL AND ty = 'agent-research' AND NOT (k % 12 = 0 AND x = 'project')
  UNION ALL SELECT path, 'subject-missing', NULL FROM n WHERE fm_error IS NULL AND k % 4 = 2
  UNION ALL SELECT path, 'categories-missing', NULL FROM n WHERE fm_error IS NULL AND k % 6 = 1
  UNION ALL SELECT path, 'help-no-category', NULL FROM n WHERE fm_error IS NULL AND k % 6 <> 1 AND (k % 4 = 1 OR k % 6 = 0))"""




@plan("spec_failures", with_notes(f"{SPEC} SELECT path, rule, detail FROM f"))
def spec_failures(spark, sf):
    return G.spec_failures(notes(spark, sf), SLUGS, changed=True)


@plan("spec_failed_notes", with_notes(f"{SPEC} SELECT path, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY path ORDER BY path LIMIT 20"))
def spec_failed_notes(spark, sf):
    return G.failed_paths(G.spec_failures(notes(spark, sf), SLUGS, changed=True), stop_after=20)


@plan("legacy_failures", with_notes(f"""SELECT path, 'raw-marker' AS rule, CASE WHEN contains(text, 'raw ocr') THEN 'raw-ocr' ELSE 'lorem-ipsum' END AS detail FROM notes WHERE contains(text, 'raw ocr') OR regexp_matches(text, '(?i)lorem ipsum')
  UNION ALL SELECT path, 'no-source', NULL FROM notes WHERE NOT (({OKHEAD} AND k % 9 <> 0) OR k % 6 = 0)
  UNION ALL SELECT path, 'dossier', x FROM notes, (SELECT unnest({rules.DOSSIER}) AS x) WHERE x <> 'Короткий ответ' AND NOT (x = 'Достоверность' AND k % 11 <> 0)"""))
def legacy_failures(spark, sf):
    return G.legacy_failures(notes(spark, sf), require_dossier=True)


def _mixed(spark, sf):
    """The notes, every tenth of them below a service folder."""
    return notes(spark, sf).withColumn("path", F.when(F.col("k") % 10 == 0, F.concat(F.lit("99 Система/"), "base")).otherwise(F.col("path")))


@plan("freshness_failures", with_notes("""SELECT path, CASE WHEN k % 11 = 0 THEN 'no-trust-block' WHEN k % 13 = 0 AND k % 6 <> 0 THEN 'empty-trust-block' ELSE 'no-freshness-mark' END AS rule FROM notes WHERE k % 10 <> 0 AND (k % 11 = 0 OR k % 13 = 0 OR k % 3 <> 0)"""))
def freshness_failures(spark, sf):
    return G.freshness_failures(_mixed(spark, sf))


@plan("layer_failures")
def layer_failures(spark, sf):
    return G.layer_failures(notes(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"), F.min("path").alias("sample"))


@plan("layer_marker_failures", with_notes(r"""SELECT path, 'raw-ocr-en' AS rule FROM notes WHERE k % 7 = 5 UNION ALL SELECT path, 'draft-marker' FROM notes WHERE k % 7 = 5 UNION ALL SELECT path, 'media-filename' FROM notes WHERE k % 7 = 5
  UNION ALL SELECT path, 'missing-use-section' FROM notes WHERE k % 97 = 0 OR (k % 8 < 6 AND k % 97 <> 0)"""))
def layer_marker_failures(spark, sf):
    d = G.layer_failures(notes(spark, sf))
    return d.filter(F.col("rule").isin("raw-ocr-en", "draft-marker", "media-filename", "missing-use-section")).select("path", "rule")


@plan("brief_failures", """SELECT doc_id, rule FROM documents, (SELECT unnest(['brief-title', 'brief-status-missing', 'brief-actions-missing']) AS rule) WHERE NOT (doc_id % 3 = 0)
   UNION ALL SELECT doc_id, 'brief-english-shell' FROM documents WHERE doc_id % 5 = 0""")
def brief_failures(spark, sf):
    good = F.concat(F.lit("# Короткий отчёт\n## Статус\nготово\n## Следующие действия\n- раз\n"), "text")
    t = F.when(F.col("doc_id") % 3 == 0, good).otherwise(F.col("text"))
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(t, F.lit("\n- Quality gate: ok"))).otherwise(t)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), t.alias("text"))
    return G.brief_failures(d).filter(F.col("rule").startswith("brief")).select(F.col("path").cast("bigint").alias("doc_id"), "rule")


@plan("report_page_failures", with_rich(r"""SELECT page_id, 'missing-synthesis-contract' AS rule FROM pages_rich UNION ALL SELECT page_id, 'weak-source-expansion' FROM pages_rich WHERE len(regexp_extract_all(html, '(?i)<a\s+[^>]*href=')) < 11"""))
def report_page_failures(spark, sf):
    d = G.report_html_failures(pages_rich(spark, sf), min_links=11)
    return d.filter(F.col("rule").isin("missing-synthesis-contract", "weak-source-expansion")).select("page_id", "rule")


CLASS = """cls AS (SELECT path, k, section, CASE WHEN k % 97 = 0 OR k % 89 = 0 THEN 'personal' WHEN k % 10 = 7 THEN NULL
   WHEN k % 12 = 0 THEN 'pd' WHEN section = '01 Право и Юриспруденция' AND k % 23 <> 0 THEN 'pd' WHEN section = '02 Здоровье' AND k % 23 <> 0 THEN 'personal'
   WHEN k % 10 = 3 THEN 'public' WHEN k % 23 = 0 THEN NULL ELSE 'text' END AS class FROM notes)"""


@plan("sensitivity_classes", with_notes(f", {CLASS} SELECT path, class, class IS NULL AS undetermined FROM cls"))
def sensitivity_classes(spark, sf):
    return G.sensitivity(notes(spark, sf))


@plan("cloud_readable_notes", with_notes(f", {CLASS} SELECT path FROM cls WHERE class IN ('public', 'text') AND section NOT IN ('01 Право и Юриспруденция', '02 Здоровье')"))
def cloud_readable_notes(spark, sf):
    return G.cloud_readable(notes(spark, sf))


@plan("sensitivity_batch_gate", with_notes(f", {CLASS} SELECT count(*) AS notes, count(*) FILTER (class IS NULL) AS undetermined, count(*) FILTER (class IN ('pd', 'personal')) AS blocked, 2 AS code FROM cls"))
def sensitivity_batch_gate(spark, sf):
    return G.batch_gate(G.sensitivity(notes(spark, sf)), "vps")


# notes moved to the places the audit treats apart, and given types, tags, states and titles
CANON_MOVES = """CASE k % 13 WHEN 0 THEN '06 Промты/' || base WHEN 1 THEN '08 AI и Инструменты/Claude Code/' || base WHEN 2 THEN '99 Система/_ROUTING/' || base
   WHEN 3 THEN '03 Проекты/_COMMUNITY_' || base WHEN 4 THEN '09 Технологии и Разработка/' || base WHEN 5 THEN '02 Знания/Capabilities/' || base WHEN 6 THEN '09 Личная продуктивность/' || base ELSE path END"""
CANON_TEXT = """replace(replace(replace(text, 'type: concept', CASE WHEN k % 3 = 0 THEN 'type: prompt' ELSE 'type: method' END), 'type: decision', 'tags: "#AI"'),
   'weekly log"', CASE WHEN k % 5 = 0 THEN 'подборка инструментов"' ELSE 'weekly log"' END)"""


def _canon(spark, sf):
    d = notes(spark, sf).selectExpr("k", f"{CANON_MOVES} AS path", f"{CANON_TEXT} AS text")
    done = F.when(F.col("k") % 10 == 3, F.replace("text", F.lit("# a comment\n"), F.lit("status: processed\n"))).otherwise(F.col("text"))
    return d.select("k", "path", F.regexp_extract("path", "([^/]*)$", 1).alias("base"), F.split("path", "/")[0].alias("section"), done.alias("text"))


def _route_sql() -> str:
    hay = {"path": "lower(path)", "title": "lower(title)", "type": "lower(type)", "either": "lower(title) || ' ' || lower(path)", "base": "base"}
    arms = []
    for test, target in rules.EARLY_ROUTES:
        on = " AND ".join(f"section = '{v}'" if f == "section" else f"regexp_matches({hay[f]}, '{v}')" for f, v in test.items())
        arms.append(f"WHEN {on} THEN '{target}'")
    for pattern, target in rules.TITLE_ROUTES:
        tag = f" OR contains(lower(tags), '{rules.TAG_ROUTES[target]}')" if target in rules.TAG_ROUTES else ""
        arms.append(f"WHEN regexp_matches(lower(title), '{pattern}'){tag} THEN '{target}'")
    return "CASE " + " ".join(arms) + " ELSE section END"


def _duck(p: str) -> str:
    return p.replace("(?imu)", "(?im)").replace("(?iu)", "(?i)").replace("'", "''")


def _head_sql(key: str) -> str:
    return rf"""regexp_replace(trim(regexp_extract(text, '(?m)\A---\n(?s:.*?)^{key}:\s*(.*)$', 1)), '^[''"]|[''"]$', '', 'g')"""


_KINDS = ", ".join("(" + " OR ".join(f"regexp_matches(text, '{_duck(p)}')" for p in ps) + f") AS has_{k}" for k, ps in rules.AUDIT_KINDS.items())
_ALIAS = "CASE section " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in rules.SECTION_ALIASES.items()) + " END"
_FLAGS = ", ".join([f"CASE WHEN judged AND NOT has_{k} THEN 'missing:{k}' END" for k in rules.AUDIT_KINDS]
                   + [f"CASE WHEN regexp_matches(text, '{_duck(p)}') AND NOT (system OR mentions) THEN 'raw:{n}' END" for n, p in rules.AUDIT_RAW]
                   + ["CASE WHEN judged AND len(string_split(text, chr(10))) > 220 THEN 'long-note' END", r"CASE WHEN judged AND len(regexp_extract_all(text, '(?m)^##+\s+')) >= 12 THEN 'many-headings' END",
                      f"CASE WHEN judged AND NOT processed AND regexp_matches(title, '{_duck(rules.COLLECTION_WORDS)}') THEN 'collection-candidate' END", "CASE WHEN alias IS NOT NULL THEN 'section-alias:' || alias END",
                      f"CASE WHEN section NOT IN ({', '.join(repr(x) for x in rules.CANON_SECTIONS)}) AND alias IS NULL THEN 'noncanonical-section' END",
                      "CASE WHEN NOT system AND inferred <> section AND alias IS DISTINCT FROM inferred AND NOT starts_with(path, inferred || '/') THEN 'route:' || inferred END"])
_SOFT = ", ".join(["CASE WHEN atomised THEN 'atomized-source' END"] + [f"CASE WHEN regexp_matches(text, '{_duck(p)}') AND (system OR mentions) THEN 'raw-reference:{n}' END" for n, p in rules.AUDIT_RAW]
                  + [r"CASE WHEN regexp_matches(base, '^_COMMUNITY_|Community \d+') THEN 'graph-community-note' END"])
CANON = rf""", c0 AS (SELECT k, {CANON_MOVES} AS path, CASE WHEN k % 10 = 3 THEN replace({CANON_TEXT}, '# a comment' || chr(10), 'status: processed' || chr(10)) ELSE {CANON_TEXT} END AS text FROM notes),
  c1 AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base, string_split(path, '/')[1] AS section, {_head_sql('type')} AS type, {_head_sql('tags')} AS tags, {_head_sql('status')} AS status,
    regexp_matches(text, '(?m)^##\s+Атомизировано(?:\s|$)') AS atomised, regexp_matches(text, '(?i)source|источник') AS mentions, {_KINDS},
    path IN ({', '.join(repr(x) for x in rules.AUDIT_SYSTEM_FILES)}) OR regexp_matches(path, '{rules.AUDIT_SYSTEM_PATHS}') AS system FROM c0),
  c2 AS (SELECT *, coalesce(nullif({_head_sql('title')}, ''), nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), ''), regexp_replace(base, '\.md$', '')) AS title, {_ALIAS} AS alias, NOT system AND NOT atomised AS judged,
    lower(status) = 'processed' AND {' AND '.join(f'has_{k}' for k in rules.AUDIT_KINDS)} AND lower(type) IN ({', '.join(repr(x) for x in rules.PROCESSED_TYPES)}) AS processed FROM c1),
  c3 AS (SELECT *, {_route_sql()} AS inferred FROM c2),
  c4 AS (SELECT *, list_filter([{_FLAGS}], lambda x: x IS NOT NULL) AS flags, list_filter([{_SOFT}], lambda x: x IS NOT NULL) AS soft FROM c3)"""


@plan("canon_audit", with_notes(f"""{CANON} SELECT path, section, inferred, array_to_string(flags, ';') AS flags, array_to_string(soft, ';') AS soft,
   greatest(0, 100 - 12 * len(list_filter(flags, lambda x: NOT starts_with(x, 'route:'))) - 3 * len(soft)) AS score FROM c4"""))
def canon_audit(spark, sf):
    return G.canon_audit(_canon(spark, sf)).select("path", "section", "inferred", F.array_join("flags", ";").alias("flags"),
                                                   F.array_join("soft", ";").alias("soft"), F.col("score").cast("long").alias("score"))


@plan("final_audit", with_notes(f""", {LINKS}, wkeys AS (SELECT DISTINCT key FROM (SELECT unnest([regexp_replace(path, '\\.md$', ''), regexp_replace(base, '\\.md$', ''), substr(base, 14, length(base) - 16), section]) AS key FROM notes))
  SELECT path, x AS rule, CASE x WHEN 'raw-media-name' THEN 'IMG_1234.PNG' WHEN 'draft-marker' THEN 'intake-draft' ELSE 'raw ocr' END AS detail FROM notes, (SELECT unnest(['raw-media-name', 'draft-marker', 'raw-ocr']) AS x) WHERE k % 7 = 5
  UNION ALL SELECT path, 'broken-wiki-link', target FROM links WHERE target <> '...' AND target NOT IN (SELECT key FROM wkeys) AND regexp_replace(target, '^\\d{{4}}-\\d{{2}}-\\d{{2}} - ', '') NOT IN (SELECT key FROM wkeys)
  UNION ALL SELECT DISTINCT section || '/graph-out-old', 'nested-runtime', '' FROM notes WHERE k % 50 = 0"""))
def final_audit(spark, sf):
    n = notes(spark, sf)
    k = F.regexp_extract("path", r"note (\d+)\.md$", 1).cast("int")
    files = n.select(F.when(k % 50 == 0, F.concat("section", F.lit("/graph-out-old/deep/graph-out/"), "base")).otherwise(F.col("path")).alias("path"))
    return G.final_audit(n, files=files.unionByName(n.select(F.concat(F.lit("graph-out/"), "path").alias("path"))))


NOW = "2024-09-01 00:00:00"
LINT = rf"""hd AS (SELECT path, k, mtime, text, regexp_extract(text, '^(?s:---\n(.*?)\n---\n)', 1) AS h, section FROM notes WHERE section <> '_drafts'),
  pr AS (SELECT path, {prose_sql('text')} AS p FROM notes), lt AS (SELECT path, length(regexp_replace(p, '[^А-Яа-яЁё]', '', 'g')) AS cyr, length(regexp_replace(p, '[^A-Za-z]', '', 'g')) AS lat FROM pr),
  ps AS (SELECT path, array_to_string(list_filter([CASE WHEN h = '' THEN 'no head' END, CASE WHEN h <> '' AND NOT regexp_matches(h, '(?m)^source:\s*\S') THEN 'no source' END,
      CASE WHEN h <> '' AND k % 8 > 5 THEN 'type' END], lambda x: x IS NOT NULL), '; ') AS problems FROM hd),
  lf AS (SELECT path, CASE WHEN coalesce(nullif(regexp_extract(h, '(?m)^created:\s*(\S+)', 1), ''), nullif(regexp_extract(h, '(?m)^updated:\s*(\S+)', 1), ''), strftime(mtime, '%Y-%m-%d')) >= '2024-03-10' THEN 'spec_new' ELSE 'spec_old' END AS "check", problems AS detail FROM hd JOIN ps USING (path)
      WHERE problems <> ''
    UNION ALL SELECT path, 'low_script', CAST(CAST(round(cyr / (cyr + lat) * 100) AS INT) AS STRING) FROM hd JOIN lt USING (path) WHERE cyr + lat >= 100 AND cyr / (cyr + lat) < 0.3
    UNION ALL SELECT path, 'missing_blocks', 'Достоверность' FROM hd WHERE k % 11 = 0
    UNION ALL SELECT path, 'stale_notes', '' FROM hd WHERE TIMESTAMP '{NOW}' - coalesce(try_cast(nullif(regexp_extract(h, '(?m)^updated:\s*(\S+)', 1), '') AS TIMESTAMP), mtime) > INTERVAL 90 DAYS)"""


_SEVERITY = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in G.CHECKS.items())


@plan("lint_findings", with_notes(f', {LINT} SELECT path, "check", CASE "check" {_SEVERITY} END AS severity, detail FROM lf'))
def lint_findings(spark, sf):
    return G.lint_findings(notes(spark, sf), NOW, spec_date="2024-03-10", stale_days=90)


@plan("lint_summary", with_notes(f""", {LINKS}, {KEYS}, {LINT}, a AS (SELECT "check", path AS item, CASE WHEN "check" = 'low_script' THEN CAST(detail AS DOUBLE) ELSE 0 END AS weight, 1 AS n FROM lf
    UNION ALL SELECT 'broken_wikilinks', target, -count(*), count(*) FROM broken GROUP BY target
    UNION ALL SELECT 'orphans', path, 0, 1 FROM notes WHERE section <> '_drafts' AND path NOT IN (SELECT path FROM resolved)),
  c AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{s}')" for c, s in G.CHECKS.items())}) v(c, severity)),
  r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY weight, item) AS pos FROM a)
  SELECT c.c AS "check", severity, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n, CASE WHEN c.c = 'broken_wikilinks' THEN count(r.item) END AS unique_targets,
    coalesce(list(r.item ORDER BY pos) FILTER (pos <= 20), []) AS worst, (SELECT count(*) FROM a WHERE "check" IN ('broken_wikilinks', 'index_divergence')) = 0 AS run_ok
  FROM c LEFT JOIN r ON r."check" = c.c GROUP BY c.c, severity"""))
def lint_summary(spark, sf):
    return G.lint_summary(notes(spark, sf), NOW, spec_date="2024-03-10", stale_days=90)


_INDEX = "'| name | note | n | x |' || chr(10) || '|---|---|---|---|' || chr(10) || '| ' || section || ' | s | ' || CAST(n + CASE WHEN section LIKE '0%' THEN 0 ELSE 3 END AS STRING) || ' | - |' || chr(10) || '| old ' || section || ' | s | 0 | - |' || chr(10) || 'Всего markdown: **' || CAST(n AS STRING) || '**'"


@plan("index_count_mismatches", with_notes("SELECT section, count(*) + 3 AS claimed, count(*) AS actual FROM notes WHERE section NOT LIKE '0%' GROUP BY section"))
def index_count_mismatches(spark, sf):
    n = notes(spark, sf)
    index = n.groupBy("section").agg(F.count("*").alias("n")).selectExpr(_INDEX.replace("chr(10)", "chr(10)") + " AS text")
    return G.count_mismatches(G.claimed_counts(index), n)


@plan("index_claimed_totals", with_notes("SELECT count(*) AS total FROM notes GROUP BY section"))
def index_claimed_totals(spark, sf):
    index = notes(spark, sf).groupBy("section").agg(F.count("*").alias("n")).selectExpr(_INDEX + " AS text")
    return G.claimed_total(index)


@plan("stale_indexes", """SELECT event_type AS path, round((SELECT epoch_us(max(ts)) FROM events) / 86400e6 - epoch_us(min(ts)) / 86400e6, 1) AS lag_days FROM events GROUP BY event_type""")
def stale_indexes(spark, sf):
    e = table(spark, sf, "events")
    return G.stale_indexes(e.select(F.col("ts").alias("mtime")), e.groupBy(F.col("event_type").alias("path")).agg(F.min("ts").alias("mtime")))


@plan("composite_gate", with_notes(f"{SPEC}, g AS (SELECT 'spec' AS gate, CASE WHEN rule LIKE 'help%' THEN 'warning' ELSE 'failure' END AS level FROM f UNION ALL SELECT 'freshness', 'failure' FROM notes WHERE k % 11 = 0 OR k % 13 = 0 OR k % 3 <> 0) "
      "SELECT x.gate, count(*) FILTER (level = 'failure') AS failures, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'failure') = 0 AS ok FROM (SELECT unnest(['spec', 'freshness', 'graph']) AS gate) x LEFT JOIN g ON g.gate = x.gate GROUP BY x.gate"))
def composite_gate(spark, sf):
    n = notes(spark, sf)
    a = G.spec_failures(n, SLUGS, changed=True).select(F.lit("spec").alias("gate"), F.when(F.col("rule").startswith("help"), "warning").otherwise("failure").alias("level"))
    b = G.freshness_failures(n).select(F.lit("freshness").alias("gate"), F.lit("failure").alias("level"))
    return G.composite(a.unionByName(b), ["spec", "freshness", "graph"])


@plan("weekly_cards", with_notes(r"""SELECT path, CASE WHEN starts_with(text, '---') THEN 'a comment' ELSE 'Note ' || k END AS title, starts_with(text, '---') AS headed FROM notes WHERE mtime >= TIMESTAMP '2024-01-20 00:00:00'"""))
def weekly_cards(spark, sf):
    n = notes(spark, sf)
    d = G.weekly_cards(n, "2024-01-20T00:00:00")
    return d.join(n.select("path", F.col("text").startswith("---").alias("headed")), "path").select("path", "title", "headed")


@plan("head_value_census", with_notes(f""", {FM_ROWS}, v AS (SELECT key AS field, value, count(*) AS n FROM vals WHERE key IN ('type', 'verified', 'verification_status') AND NOT is_list GROUP BY ALL)
  SELECT field, value, n, CASE field WHEN 'type' THEN CASE WHEN value IN ('concept', 'tool-card', 'decision', 'synthesis', 'agent-research', 'reference') THEN 'conformant' ELSE 'rule' END
     WHEN 'verified' THEN CASE WHEN value IN ('подтверждён', 'подтвержден', 'не-проверялось') THEN 'conformant' ELSE 'rule' END ELSE 'rule' END AS cover FROM v"""))
def head_value_census(spark, sf):
    from ..operators.rollups import value_census
    return value_census(notes(spark, sf))
