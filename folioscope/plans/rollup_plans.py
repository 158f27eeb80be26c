"""Clusters, attribution, roll-ups, curated lists and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions import urls as U
from ..operators import ledgers as G
from ..operators import parsing as P
from ..operators import rollups as R
from .fixtures import notes, pages_rich, with_notes, with_rich
from .registry import plan, table
from .text_plans import compact_sql, odistinct, sq

TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace('(?iu)', '(?i)')}') THEN '{t}'" for t, _title, p in rules.TOPICS) + f" ELSE '{rules.TOPIC_DEFAULT}' END"


@plan("topic_parts", f"""SELECT topic, part, max(parts) AS parts, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, substr(sha1(topic || ' ' || part || ' ' || string_agg(ref, ' ' ORDER BY ref)), 1, 10) AS fingerprint FROM (
  SELECT topic, ref, chars, (row_number() OVER (PARTITION BY topic ORDER BY ref) - 1) // 25 + 1 AS part, CAST(ceil(count(*) OVER (PARTITION BY topic) / 25) AS BIGINT) AS parts
  FROM (SELECT {TOPIC} AS topic, 'doc-' || doc_id AS ref, length({compact_sql('text')}) AS chars FROM documents)) GROUP BY topic, part HAVING sum(chars) >= 80""")
def topic_parts(spark, sf):
    return R.topic_parts(table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("ref"), "text"))


@plan("atom_fingerprints", """SELECT doc_id, substr(sha1(lang || '|' || source || '|' || 'a' || doc_id % 5 || '|' || 'b'), 1, 10) AS fingerprint FROM documents""")
def atom_fingerprints(spark, sf):
    srcs = F.array(F.lit("b"), F.concat(F.lit("a"), (F.col("doc_id") % 5).cast("string")))
    return table(spark, sf, "documents").select("doc_id", R.atom_fingerprint(F.col("lang"), F.col("source"), srcs).alias("fingerprint"))


WORDS = "list_filter(string_split_regex(lower({}), '[^a-zа-яё0-9]+'), lambda w: length(w) >= 4)"
_TITLE = "array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ')"


ATOM = f"""rec AS (SELECT doc_id AS ref, lower(text) AS low FROM documents),
  atom AS (SELECT item_id AS atom, {odistinct(WORDS.format(_TITLE + " || chr(10) || text || chr(10)"))} AS w FROM benchmark),
  hit AS (SELECT atom, ref, len(list_filter(w, lambda x: contains(low, x))) AS score FROM atom, rec)"""


def _atoms(spark, sf):
    i = F.col("item_id")
    own = F.when(i % 4 == 0, F.array(i * 20 + 1, F.lit(-5).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "benchmark").select(i.alias("atom"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"),
                                                F.col("text").alias("what"), F.array().cast("array<string>").alias("sources"), own.alias("refs"))


def _records(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), "text")


@plan("source_reattribution", f"""WITH {ATOM}, n AS (SELECT item_id AS note, {odistinct(WORDS.format(_TITLE))} AS tw, list_slice({odistinct(WORDS.format('text'))}, 1, 160) AS bw FROM benchmark),
  cited AS (SELECT atom AS note, ref FROM hit WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY atom ORDER BY score DESC, ref) <= 6),
  d AS (SELECT note, ref, 3 * len(list_filter(tw, lambda w: contains(low, w))) + len(list_filter(bw, lambda w: contains(low, w))) AS score FROM n JOIN cited USING (note) JOIN rec USING (ref)),
  b AS (SELECT *, max(score) OVER (PARTITION BY note) AS best, first_value(ref) OVER (PARTITION BY note ORDER BY score DESC, ref) AS top FROM d)
  SELECT note, ref, score, CASE WHEN best >= 8 THEN score >= 8 AND score >= greatest(8, floor(best * 0.35)) ELSE ref = top END AS kept FROM b""")
def source_reattribution(spark, sf):
    """Notes cite the documents their text has most in common with, out of all documents."""
    refs = R.record_candidates(_atoms(spark, sf), _records(spark, sf)).select(F.col("atom").alias("note"), "ref")
    n = _atoms(spark, sf).select(F.col("atom").alias("note"), "title", F.col("what").alias("body"), F.col("what").alias("text"))
    return R.reattribute(refs, n, _records(spark, sf))


@plan("atom_sources", f"""WITH {ATOM}, own AS (SELECT item_id AS atom, item_id * 20 + 1 AS ref FROM benchmark WHERE item_id % 4 = 0 AND item_id * 20 + 1 IN (SELECT doc_id FROM documents))
  SELECT atom, ref, score FROM (SELECT *, max(score) OVER (PARTITION BY atom) AS best FROM hit WHERE score > 0 AND atom NOT IN (SELECT atom FROM own)) WHERE score = best
  UNION ALL SELECT atom, ref, NULL FROM own""")
def atom_sources(spark, sf):
    return R.atom_sources(_atoms(spark, sf), _records(spark, sf))


# -- curated lists -------------------------------------------------------------------
_CAT = "CASE doc_id % 6 WHEN 0 THEN 'Databases' WHEN 1 THEN 'Developer Tools' WHEN 2 THEN 'Legal' WHEN 3 THEN 'Marketing' WHEN 4 THEN 'Browser Automation' ELSE 'Other Things' END"
_WORD = "CASE doc_id % 5 WHEN 0 THEN 'postgres analytics for the desk' WHEN 1 THEN 'agent memory search' WHEN 2 THEN 'pays with wallet' WHEN 3 THEN 'reads local file tree' ELSE 'plain words' END"
LIST = f"""concat('# List', chr(10), '- [No category](https://github.com/acme/none-', CAST(doc_id % 30 AS STRING), ') - first', chr(10), '### 🗄️ <a name="x"></a>', {_CAT}, chr(10), 'prose line', chr(10),
  '- [Tool `', CAST(doc_id AS STRING), '`](https://github.com/acme/tool-', CAST(doc_id % 200 AS STRING), '.git) [![b](x)](y) ', CASE doc_id % 3 WHEN 0 THEN '🐍 ☁️' WHEN 1 THEN '📇 🏠 🍎 🐧' ELSE '🎖️ 🦀' END, ' - ', {_WORD}, ' -', chr(10),
  '- [Elsewhere](https://example.com/x) - not a repository')"""


def entries(spark, sf):
    return P.list_entries(table(spark, sf, "documents").selectExpr("doc_id", f"{LIST} AS text"))


_DESC = f"regexp_replace({_WORD}, '\\s*[—–-]\\s*$', '')"
ENTRIES = f"""e AS (SELECT doc_id, 1 AS line, 'No category' AS name, 'acme/none-' || doc_id % 30 AS repo, 'Uncategorized' AS category, 'first' AS description, '' AS languages, '' AS scopes, '' AS os, false AS official FROM documents
  UNION ALL SELECT doc_id, 4, 'Tool ' || doc_id, 'acme/tool-' || doc_id % 200, {_CAT}, {_WORD}, CASE doc_id % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'TypeScript/JavaScript' ELSE 'Rust' END,
    CASE doc_id % 3 WHEN 0 THEN 'cloud-service' WHEN 1 THEN 'local-service' ELSE '' END, CASE doc_id % 3 WHEN 1 THEN 'macOS,Linux' ELSE '' END, doc_id % 3 = 2 FROM documents)"""


@plan("list_entries", f"WITH {ENTRIES} SELECT * FROM e")
def list_entries(spark, sf):
    d = entries(spark, sf)
    return d.select("doc_id", "line", "name", "repo", "category", "description", *[F.array_join(c, ",").alias(c) for c in ("languages", "scopes", "os")], "official")


@plan("list_risks", f"""WITH {ENTRIES}, r AS (SELECT lower(description || ' ' || scopes || ' ' || category) AS t FROM e)
  SELECT CASE WHEN regexp_matches(t, '{rules.HIGH_RISK}') THEN '{rules.RISK_TEXT["high"]}' WHEN regexp_matches(t, '{rules.MEDIUM_RISK}') THEN '{rules.RISK_TEXT["medium"]}' ELSE '{rules.RISK_TEXT["low"]}' END AS risk, count(*) AS n FROM r GROUP BY ALL""")
def list_risks(spark, sf):
    d = entries(spark, sf)
    return d.groupBy(P.list_risk(F.col("description"), F.col("scopes"), F.col("category")).alias("risk")).agg(F.count("*").alias("n"))


def _fits(col: str, pairs) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({col}, '{p}') THEN '{rules.CATEGORIES[c]}' END" for p, c in pairs)


_CATS = f"list_filter([{_fits('category', rules.LIST_CATEGORY_FITS)}, {_fits('t', rules.LIST_KEYWORD_FITS)}], lambda x: x IS NOT NULL)"
CATS = f"""ec AS (SELECT *, category || ' ' || description || ' ' || name AS t FROM e), cc AS (SELECT *, {_CATS} AS c0 FROM ec),
  c1 AS (SELECT *, CASE WHEN len(c0) = 0 THEN ['{rules.CATEGORIES[rules.LIST_CATEGORY_DEFAULT]}'] ELSE list_slice({odistinct('c0')}, 1, 6) END AS cats FROM cc)"""


@plan("list_categories", f"WITH {ENTRIES}, {CATS} SELECT doc_id, line, array_to_string(cats, ' | ') AS cats FROM c1")
def list_categories(spark, sf):
    d = entries(spark, sf)
    return d.select("doc_id", "line", F.array_join(P.list_categories(F.col("description"), F.col("category"), F.col("name")), " | ").alias("cats"))


@plan("list_tags")
def list_tags(spark, sf):
    d = P.list_tags(entries(spark, sf), ["mcp", "curated-list"])
    return d.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@plan("list_catalogue", f"""WITH {ENTRIES}, f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id, line) AS rn FROM e) SELECT repo, doc_id, name, category FROM f WHERE rn = 1""")
def list_catalogue(spark, sf):
    return R.catalogue(entries(spark, sf)).select("repo", "doc_id", "name", "category")


@plan("list_catalogue_counts", f"""WITH e0 AS (SELECT 1), {ENTRIES.replace('e AS (', 'e9 AS (', 1)}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id, line) AS rn FROM e9) WHERE rn = 1), {CATS}
  SELECT 'category' AS kind, category AS label, count(*) AS n FROM e GROUP BY category UNION ALL SELECT 'project', label, count(*) FROM (SELECT unnest(cats) AS label FROM c1) GROUP BY label""")
def list_catalogue_counts(spark, sf):
    return R.catalogue_counts(R.catalogue(entries(spark, sf)))


@plan("list_project_fit", f"""WITH {ENTRIES}, ec AS (SELECT *, category || ' ' || description || ' ' || name AS t FROM e),
  s AS (SELECT doc_id, line, p, CASE WHEN regexp_matches(t, '(?i)knowledge|memory|vault|note|search|rag|graph') AND p = 'Memory Desk' THEN 3 ELSE 0 END
      + CASE WHEN regexp_matches(t, '(?i)agent|orchestrat|mcp|gateway|coding|developer|github|ci|deploy|observability') AND regexp_matches(p, '(?i)agent|os|dev|platform|ops') THEN 2 ELSE 0 END
      + CASE WHEN regexp_matches(t, '(?i)legal|court|case law|contract|compliance|identity|trust') AND p = 'Law Shop' THEN 2 ELSE 0 END
      + CASE WHEN regexp_matches(t, '(?i)crm|sales|marketing|commerce|customer|support|ticket') AND p = 'Law Shop' THEN 2 ELSE 0 END AS k FROM ec, (SELECT unnest(['Agent OS', 'Law Shop', 'Memory Desk', 'Zoo']) AS p)),
  g AS (SELECT doc_id, line, string_agg(p, ', ' ORDER BY k DESC, p) FILTER (k > 0) AS b FROM s GROUP BY ALL) SELECT doc_id, line, coalesce(b, 'Agent OS, Law Shop, Memory Desk') AS projects FROM g""")
def list_project_fit(spark, sf):
    d = R.project_fit(entries(spark, sf), ["Agent OS", "Law Shop", "Memory Desk", "Zoo"])
    return d.select("doc_id", "line", F.array_join("projects", ", ").alias("projects"))


@plan("capability_suggestions", "SELECT path, id, max(score) AS score, min(ord) AS ord FROM (SELECT doc_id AS path, o AS ord, 'cap' || (doc_id + o) % 3 AS id, 0.5 + o / 10.0 AS score FROM documents, (SELECT unnest(range(0, 5)) AS o)) WHERE score >= 0.6 AND (path, ord) IN (SELECT (path, min(ord)) FROM (SELECT doc_id AS path, o AS ord, 'cap' || (doc_id + o) % 3 AS id FROM documents, (SELECT unnest(range(1, 5)) AS o)) GROUP BY path, id) AND path % 5 > 0 GROUP BY path, id")
def capability_suggestions(spark, sf):
    d = table(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    s = s.withColumn("id", F.concat(F.lit("cap"), ((F.col("path") + F.col("ord")) % 3).cast("string"))).withColumn("score", F.round(0.5 + F.col("ord") / 10.0, 1))
    n = d.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "## Применимые способности\n").otherwise("x").alias("text"))
    return R.chosen_suggestions(s, n, 0.6)


@plan("repository_tools", with_rich(r""", p AS (SELECT lpad(CAST(page_id AS STRING), 6, '0') AS path, html, page_id, 'acme/tool-' || page_id % 7 AS r1 FROM pages_rich)
  SELECT r1 AS repo, count(*) AS notes, coalesce(first('what ' || page_id ORDER BY path) FILTER (page_id % 3 = 0), '') AS what, coalesce(first('do ' || page_id ORDER BY path) FILTER (page_id % 3 = 1), '') AS decision,
    'https://github.com/' || r1 || '.git https://github.com/' || r1 || '/releases' AS sources FROM p GROUP BY r1"""))
def repository_tools(spark, sf):
    i = F.col("page_id")
    n = pages_rich(spark, sf).select(F.lpad(i.cast("string"), 6, "0").alias("path"), F.col("html").alias("text"), F.when(i % 3 == 0, "identity").when(i % 3 == 1, "decision").otherwise("note").alias("role"),
                                     F.concat(F.lit("what "), i.cast("string")).alias("what"), F.concat(F.lit("do "), i.cast("string")).alias("decision"))
    return R.tools(n)


def _results(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("n"), (i % 97).cast("string")).alias("key"), F.lpad(i.cast("string"), 7, "0").alias("group_id"),
        F.when(i % 4 == 0, "note").when(i % 4 == 1, "atoms").otherwise("dup").alias("outcome"),
        F.array(F.concat(F.lit("a/"), (i % 3).cast("string")), F.concat(F.lit("b/"), (i % 3).cast("string")), F.concat(F.lit("c/x"), (i % 5).cast("string"))).alias("files"),
        F.concat_ws(" ", F.when(i % 97 % 6 == 0, "Agent").when(i % 97 % 6 == 1, "Legal portal").when(i % 97 % 6 == 2, "Startup investor").otherwise("Plain"), F.get(F.split("text", " "), F.lit(0))).alias("title"),
        F.col("text").alias("summary"))


def _w(terms, e):
    return " + ".join(f"CASE WHEN contains({e}, '{t}') THEN {w} ELSE 0 END" for t, w in terms)


RECS = f"""res AS (SELECT 'n' || doc_id % 97 AS key, lpad(CAST(doc_id AS STRING), 7, '0') AS group_id, CASE doc_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'atoms' ELSE 'dup' END AS outcome, 2 AS nf,
    CASE doc_id % 97 % 6 WHEN 0 THEN 'Agent' WHEN 1 THEN 'Legal portal' WHEN 2 THEN 'Startup investor' ELSE 'Plain' END || ' ' || string_split(text, ' ')[1] AS title, text AS summary FROM documents),
  rg AS (SELECT key, count(*) AS groups, CAST(sum(nf) AS BIGINT) AS files, count(*) FILTER (outcome = 'note') AS note, count(*) FILTER (outcome = 'atoms') AS atoms, count(*) FILTER (outcome = 'dup') AS dup,
    arg_min(title, group_id) AS title, arg_min(summary, group_id) AS summary FROM res GROUP BY key),
  rl AS (SELECT *, lower(title || ' ' || summary) AS low FROM rg),
  recs AS (SELECT key, groups, files, note, atoms, dup, title, {_w(R.IMPORTANCE, 'low')} + CASE WHEN note > 0 THEN 6 ELSE 0 END + CASE WHEN atoms > 0 THEN 5 ELSE 0 END + least(files, 10) AS score,
    CASE {" ".join("WHEN " + " OR ".join(f"contains(low, '{t}')" for t in terms) + f" THEN '{topic}'" for terms, topic in R.RECORD_TOPICS)} ELSE '{R.RECORD_TOPIC_DEFAULT}' END AS topic FROM rl)"""


@plan("note_records", f"WITH {RECS} SELECT key, groups, files, note, atoms, dup, score, topic FROM recs")
def note_records(spark, sf):
    return R.records(_results(spark, sf)).select("key", "groups", "files", "note", "atoms", "dup", "score", "topic")


@plan("top_records", f"WITH {RECS} SELECT key, score, files FROM recs WHERE note > 0 OR atoms > 0 ORDER BY score DESC, files DESC, key LIMIT 20")
def top_records(spark, sf):
    return R.top_records(R.records(_results(spark, sf))).select("key", "score", "files")


@plan("topic_modules", f"""WITH {RECS}, atm AS (SELECT topic, lower(substr(title, 1, 96)) AS low, first(substr(title, 1, 96) ORDER BY score DESC, key) AS atom, max(score) AS s, first(key ORDER BY score DESC, key) AS k FROM recs GROUP BY ALL),
  tp AS (SELECT topic, string_agg(atom, ' | ' ORDER BY s DESC, k, atom) AS atoms FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, k, atom) AS rn FROM atm) WHERE rn <= 6 GROUP BY topic)
  SELECT r.topic, count(*) AS n, CAST(sum(files) AS BIGINT) AS files, CAST(sum(score) AS BIGINT) AS score, first(title ORDER BY score DESC, key) AS lead, any_value(tp.atoms) AS atoms FROM recs r JOIN tp ON tp.topic = r.topic GROUP BY r.topic""")
def topic_modules(spark, sf):
    return R.modules(R.records(_results(spark, sf)))


@plan("note_digests", with_notes(r"""SELECT path, starts_with(what, 'Проект Атлас') AS has_what, about = what AS about_is_what, why FROM (SELECT path, 'Проект Атлас' AS what, 'Проект Атлас' AS about, 'Useful to decide whether to apply it.' AS why FROM notes)"""))
def note_digests(spark, sf):
    d = R.digests(notes(spark, sf), ["Что это", "Суть"], ["Как использовать"], ["Зачем это нужно"])
    return d.select("path", F.col("what").startswith("Проект Атлас").alias("has_what"), (F.col("about") == F.col("what")).alias("about_is_what"), "why")


# -- ledgers over events -----------------------------------------------------------------
def _obs(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", i.alias("seq"), (i % 4).alias("tier"), (i % 7 > 0).alias("deep"),
                                             F.when(i % 11 == 0, "failed").when(i % 3 == 0, "cached").otherwise("processed").alias("status"))


RUNS = """SELECT user_id AS run_id, count(*) AS files, count(*) FILTER (event_id % 11 <> 0 AND event_id % 3 <> 0) AS processed, count(*) FILTER (event_id % 11 <> 0 AND event_id % 3 = 0) AS cached,
  count(*) FILTER (event_id % 11 = 0) AS failed, count(*) FILTER (event_id % 4 >= 1 AND event_id % 7 = 0) AS deep_missing,
  count(*) FILTER (event_id % 11 = 0) = 0 AND count(*) FILTER (event_id % 4 >= 1 AND event_id % 7 = 0) = 0 AS ok FROM events GROUP BY user_id"""


@plan("run_summary", RUNS)
def run_summary(spark, sf):
    return G.run_summary(_obs(spark, sf))


SYNTHESIS = """SELECT user_id AS run_id, count(*) % 5 = 0 AS skipped, count(*) FILTER (event_type = 'error') % 4 = 3 AS degraded,
   greatest(count(*) FILTER (event_type = 'click') - 2, 0) AS atomized, count(*) FILTER (event_type = 'purchase') % 2 AS written, count(*) FILTER (event_type = 'signup') % 3 AS enriched
   FROM events WHERE user_id % 6 > 0 GROUP BY user_id"""


@plan("run_verdicts", f"""WITH r AS ({RUNS}), s AS ({SYNTHESIS}), p AS (SELECT user_id AS run_id, count(*) FILTER (event_id % 4 >= 1) AS deep FROM events GROUP BY user_id),
   j AS (SELECT r.*, deep, s.run_id IS NULL AS gone, coalesce(skipped, false) AS skipped, coalesce(degraded, false) AS degraded, coalesce(atomized, 0) AS atomized,
     coalesce(written, 0) AS written, coalesce(enriched, 0) AS enriched FROM r JOIN p USING (run_id) LEFT JOIN s USING (run_id)), d AS (SELECT * FROM j WHERE processed > 0 AND deep > 0)
   SELECT run_id, 'deep-missing' AS failure FROM j WHERE deep_missing > 0 UNION ALL SELECT run_id, 'nothing-processed' FROM j WHERE processed = 0 AND files > 0 AND cached = 0
   UNION ALL SELECT run_id, 'synthesis-missing' FROM d WHERE gone OR skipped AND atomized = 0 AND written = 0 UNION ALL SELECT run_id, 'synthesis-degraded' FROM d WHERE degraded
   UNION ALL SELECT run_id, 'no-atoms' FROM d WHERE atomized = 0 UNION ALL SELECT run_id, 'nothing-enriched' FROM d WHERE enriched = 0""")
def run_verdicts(spark, sf):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    s = table(spark, sf, "events").filter("user_id % 6 > 0").groupBy(F.col("user_id").alias("run_id")).agg(
        (F.count("*") % 5 == 0).alias("skipped"), (of("error") % 4 == 3).alias("degraded"), F.greatest(of("click") - 2, F.lit(0)).alias("atomized"),
        (of("purchase") % 2).alias("written"), (of("signup") % 3).alias("enriched"))
    return G.run_verdicts(_obs(spark, sf), s)


RATES = [("click", 15.0, 75.0, 18.75, 1.5), ("view", 3.0, 15.0, 3.75, 0.3), ("purchase", 0.8, 4.0, 1.0, 0.08)]


@plan("cost_rollup", """SELECT provider, CAST(sum(a + b + c + d) AS BIGINT) AS tokens, round(sum((a * r0 + b * r1 + c * r2 + d * r3) / 1e6), 4) AS usd, sum((a * r0 + b * r1 + c * r2 + d * r3) / 1e6) > 0.2 AS over FROM (
  SELECT 'p' || user_id % 3 AS provider, ts, CAST(floor(value * 10) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) AS b, event_id % 50 AS c, event_id % 9 AS d,
    CASE event_type WHEN 'view' THEN 3.0 WHEN 'purchase' THEN 0.8 ELSE 15.0 END AS r0, CASE event_type WHEN 'view' THEN 15.0 WHEN 'purchase' THEN 4.0 ELSE 75.0 END AS r1,
    CASE event_type WHEN 'view' THEN 3.75 WHEN 'purchase' THEN 1.0 ELSE 18.75 END AS r2, CASE event_type WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.08 ELSE 1.5 END AS r3 FROM events) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY provider""")
def cost_rollup(spark, sf):
    v = F.col("value")
    u = table(spark, sf, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("Model-"), "event_type").alias("model"), "ts",
                                          F.floor(v * 10).alias("input"), F.floor(v).alias("output"), (F.col("event_id") % 50).alias("cache_write"), (F.col("event_id") % 9).alias("cache_read"))
    return G.cost_rollup(u, RATES, "click", "2024-01-10 00:00:00", 0.2).withColumn("usd", F.round("usd", 4))


@plan("flat_cost_rollup", """WITH e AS (SELECT 'p' || user_id % 4 AS provider, user_id, ts, CASE WHEN event_id % 5 > 0 THEN event_id * 100 + CAST(floor(value) AS BIGINT) END AS total FROM events),
   b AS (SELECT user_id FROM e GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-01 06:00:00'),
   s AS (SELECT provider, user_id, arg_max(total, ts) FILTER (total IS NOT NULL) AS total FROM e SEMI JOIN b USING (user_id) GROUP BY ALL)
   SELECT provider, CAST(coalesce(sum(total), 0) AS BIGINT) AS tokens, round(coalesce(sum(total), 0) * 2.5 / 1e6, 4) AS usd, coalesce(sum(total), 0) * 2.5 / 1e6 > 10 AS over FROM s GROUP BY provider""")
def flat_cost_rollup(spark, sf):
    e = table(spark, sf, "events")
    begun = e.groupBy("user_id").agg(F.min("ts").alias("started"))
    samples = e.join(begun, "user_id").select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"), F.col("user_id").alias("session"), "started", "ts",
        F.when(F.col("event_id") % 5 > 0, F.col("event_id") * 100 + F.floor("value")).alias("total"))
    return G.flat_cost_rollup(samples, 2.5, "2024-01-01 06:00:00", 10).withColumn("usd", F.round("usd", 4))


@plan("session_tokens", "SELECT user_id AS run_id, arg_min(t, ts) AS first, arg_max(t, ts) AS last, arg_max(t, ts) - arg_min(t, ts) AS delta FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN CAST(floor(value * 100) AS BIGINT) END AS t FROM events) WHERE t IS NOT NULL GROUP BY user_id")
def session_tokens(spark, sf):
    e = table(spark, sf, "events")
    return G.session_tokens(e.select(F.col("user_id").alias("run_id"), "ts", F.when(F.col("event_id") % 5 > 0, F.floor(F.col("value") * 100)).alias("tokens")))


@plan("placement_violations", "SELECT DISTINCT event_type AS label FROM events WHERE event_type IN ('click', 'view')")
def placement_violations(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.when(F.col("event_type").isin("error", "signup") & (F.col("event_id") % 2 == 0), "local").otherwise("cloud").alias("place"))
    return G.placement_violations(d, ["click", "view", "error", "signup"])


_ID = "CASE event_id % 6 WHEN 0 THEN concat('../x/', CAST(event_id AS STRING)) ELSE concat('s/', CAST(event_id AS STRING), '.md') END"
_ACT = "CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'work' WHEN 2 THEN 'forget' ELSE 'sing' END"


@plan("weekly_decisions", """SELECT outcome, count(*) AS n, max(target) AS sample FROM (SELECT CASE WHEN event_id % 6 = 0 THEN 'invalid' WHEN event_id % 4 = 0 THEN 'read' WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 4 = 1 THEN 'work' WHEN event_id % 4 = 2 THEN 'forget' ELSE 'invalid' END AS outcome,
   CASE WHEN event_id % 6 > 0 AND event_id % 5 > 0 AND event_id % 4 IN (1, 2) THEN 's__' || event_id || '.md' END AS target FROM events) GROUP BY outcome""")
def weekly_decisions(spark, sf):
    e = table(spark, sf, "events")
    d = G.decisions(e.selectExpr(f"{_ID} AS id", f"{_ACT} AS action"), e.filter("event_id % 5 > 0").selectExpr(f"{_ID} AS path"))
    return d.groupBy("outcome").agg(F.count("*").alias("n"), F.max("target").alias("sample"))


@plan("batch_progress", """SELECT user_id AS batch, count(*) AS jobs, count(*) FILTER (event_id % 3 > 0) AS done, count(*) FILTER (event_id % 3 > 0 AND event_id % 5 = 0) AS failed, count(*) FILTER (event_id % 3 = 0) AS remaining,
   CASE WHEN count(*) FILTER (event_id % 3 > 0) > 0 AND count(*) FILTER (event_id % 3 = 0) > 0 THEN CAST(round((epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts)))) / count(*) FILTER (event_id % 3 > 0) * count(*) FILTER (event_id % 3 = 0)) AS BIGINT) END AS eta FROM events GROUP BY user_id""")
def batch_progress(spark, sf):
    i = F.col("event_id")
    j = table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("ts").alias("started"), F.when(i % 3 > 0, F.col("ts")).alias("finished"), F.when(i % 5 == 0, 1).otherwise(0).alias("code"))
    return G.progress(j, "2024-02-01 00:00:00")


@plan("chunk_ledger", """WITH c AS (SELECT user_id AS run_id, event_id AS ord, event_id // 200 AS parent, CASE WHEN event_id % 97 = 0 THEN 'insufficient_quota' WHEN event_id % 6 = 0 THEN 'invalid' ELSE 'accepted' END AS status,
     event_id % 4 AS files, CASE event_type WHEN 'error' THEN 'invalid' WHEN 'signup' THEN 'timeout' END AS prior FROM events),
   q AS (SELECT run_id, min(ord) AS stop, arg_min(parent, ord) AS stopped FROM c WHERE status = 'insufficient_quota' GROUP BY run_id)
   SELECT run_id, CASE WHEN ord > stop THEN CASE WHEN parent = stopped THEN 'not_attempted' ELSE coalesce(prior, 'not_attempted') END ELSE status END AS status,
     count(*) AS chunks, CAST(sum(files) AS BIGINT) AS files FROM c LEFT JOIN q USING (run_id) GROUP BY ALL""")
def chunk_ledger(spark, sf):
    i = F.col("event_id")
    c = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), i.alias("ord"), F.floor(i / 200).alias("parent"),
        F.when(i % 97 == 0, "insufficient_quota").when(i % 6 == 0, "invalid").otherwise("accepted").alias("status"), (i % 4).alias("files"),
        F.when(F.col("event_type") == "error", "invalid").when(F.col("event_type") == "signup", "timeout").alias("prior"))
    return G.chunk_ledger(c)


_LINE = """CASE WHEN event_id % 10 = 0 THEN concat('{', props) ELSE concat('{"ts": "', CASE WHEN event_id % 2 = 0 THEN '2024-01-01' ELSE '2024-05-01' END, '", "cause": "', CASE WHEN event_id % 3 = 0 THEN '' ELSE 'c' END, '", "fix": 1}') END"""


@plan("lesson_ledger_failures", """SELECT event_id AS id, 'not-json' AS problem FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'missing:cause' FROM events WHERE event_id % 10 <> 0 AND event_id % 2 = 1 AND event_id % 3 = 0
   UNION ALL SELECT event_id, 'missing:rule' FROM events WHERE event_id % 10 <> 0 AND event_id % 2 = 1""")
def lesson_ledger_failures(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id AS id", f"{_LINE} AS line")
    return G.ledger_failures(d, "2024-03-01", ["cause", "fix", "rule"])


STEP = "CASE event_type WHEN 'view' THEN 'staged' WHEN 'click' THEN 'measured' WHEN 'error' THEN 'rolled_back' WHEN 'signup' THEN 'staged' ELSE 'measured' END"


def steps(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id AS item", "ts", "event_id AS seq", f"{STEP} AS status")


@plan("item_states", f"SELECT user_id AS item, arg_max({STEP}, ts) AS status, count(*) AS events FROM events GROUP BY user_id")
def item_states(spark, sf):
    return G.item_states(steps(spark, sf))


@plan("illegal_steps", f"""SELECT item, seq, before, status FROM (SELECT user_id AS item, event_id AS seq, {STEP} AS status, coalesce(lag({STEP}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'pending') AS before FROM events)
   WHERE NOT ((before = 'pending' AND status = 'staged') OR (before = 'staged' AND status IN ('measured', 'rolled_back')) OR (before = 'measured' AND status IN ('measured', 'rolled_back')) OR (before = 'rolled_back' AND status = 'staged'))""")
def illegal_steps(spark, sf):
    return G.illegal_steps(steps(spark, sf))


@plan("duplicate_jobs", """WITH j AS (SELECT event_id AS job, ts, user_id % 40 AS fingerprint, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'completed' ELSE 'failed' END AS status FROM events)
   SELECT j.job, f.job AS of FROM j JOIN (SELECT fingerprint, arg_min(job, (ts, job)) AS job, min(ts) AS ts FROM j WHERE status <> 'failed' GROUP BY fingerprint) f USING (fingerprint) WHERE j.ts > f.ts OR (j.ts = f.ts AND j.job > f.job)""")
def duplicate_jobs(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("job"), "ts", (F.col("user_id") % 40).alias("fingerprint"),
                                          F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "completed").otherwise("failed").alias("status"))
    return G.duplicate_submissions(e)


RED = """WITH c AS (SELECT user_id AS "check", ts, event_type <> 'view' AS red FROM events), g AS (SELECT "check", max(ts) AS green FROM c WHERE NOT red GROUP BY ALL)
   SELECT c."check", min(ts) AS first_red_at, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts)))) / 86400 > 4 AS failing FROM c LEFT JOIN g ON g."check" = c."check" WHERE red AND (green IS NULL OR ts > green) GROUP BY c."check" """


@plan("red_checks", RED)
def red_checks(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").alias("check"), "ts", (F.col("event_type") != "view").alias("red"))
    return G.red_since(c, 4, "2024-02-01 00:00:00")


@plan("subtitle_lines", r"""WITH l AS (SELECT conv_id, turn, line, said FROM (SELECT conv_id, turn, unnest(ls) AS said, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT conv_id, turn, list_concat(['00:01 --> 00:02', '12'], list_concat(string_split(text, chr(10)), [string_split(text, chr(10))[-1]])) AS ls FROM conversations))),
   k AS (SELECT conv_id, turn, line, regexp_replace(said, '^\s+|\s+$', '', 'g') AS said FROM l WHERE line > 1 AND trim(said) <> ''),
   p AS (SELECT *, lag(said) OVER (PARTITION BY conv_id ORDER BY turn, line) AS prev FROM k) SELECT conv_id, turn, line, said FROM p WHERE prev IS NULL OR prev <> said""")
def subtitle_lines(spark, sf):
    c = table(spark, sf, "conversations")
    last = F.element_at(T.lines_of(F.col("text")), -1)
    vtt = c.select("conv_id", "turn", F.concat(F.lit("00:01 --> 00:02\n12\n<c>"), "text", F.lit("</c>\n"), last).alias("text"))
    d = G.drop_repeats(G.subtitle_lines(vtt, ["conv_id", "turn"]), ["conv_id"], ["turn", "line"])
    return d.select("conv_id", "turn", "line", "said")


_FEED = "concat('<feed>', array_join(transform(sequence(1, 20), i -> concat('<yt:videoId>v', CAST(page_id % 50 * 10 + i AS STRING), '</yt:videoId>')), ''), '</feed>')"


@plan("new_feed_items", "SELECT page_id AS channel, i - 1 AS pos, 'v' || (page_id % 50 * 10 + i) AS id FROM pages, (SELECT unnest(range(1, 16)) AS i) WHERE (page_id % 50 * 10 + i) % 3 > 0")
def new_feed_items(spark, sf):
    f = table(spark, sf, "pages").selectExpr("page_id AS channel", f"{_FEED} AS xml")
    ids = G.feed_ids(f)
    return G.new_items(ids, ids.filter(F.substring("id", 2, 9).cast("int") % 3 == 0)).select("channel", "pos", "id")


_SEED = "regexp_extract(url, '^https?://[^/?#]+'{})"


@plan("site_addresses", f"""SELECT url AS seed, u FROM (SELECT url, list_slice({odistinct("l")}, 1, 4) AS us FROM (SELECT url, list_concat([url], [{_SEED.format('')} || '/a' || page_id, {_SEED.format('')} || '/b', url]) AS l FROM pages)), (SELECT unnest(range(1, 5)) AS i), LATERAL (SELECT us[i] AS u) WHERE u IS NOT NULL""")
def site_addresses(spark, sf):
    from ..functions import html as H
    p = table(spark, sf, "pages")
    o = H.origin(F.col("url"))
    xml = F.concat(F.lit("<loc>"), o, F.lit("/a"), F.col("page_id").cast("string"), F.lit("</loc><loc>https://other.org/x</loc><loc>"), o, F.lit("/b</loc>"))
    seeds = p.select(F.col("url").alias("seed"), F.lit("Sitemap: x").alias("robots"), F.array(xml).alias("sitemaps"), "html")
    return G.site_urls(seeds, 4).select("seed", F.col("url").alias("u"))
