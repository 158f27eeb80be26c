"""Readability and preservation over documents and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import readability as R
from .fixtures import notes, with_notes
from .registry import plan, table

S_RX = r"list_filter(string_split_regex(regexp_replace({t}, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '')"


def rhythm_sql(src: str, key: str = "doc_id", text: str = "text") -> str:
    n = r"len(regexp_extract_all(x, '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'))"
    return rf"""ss AS (SELECT {key}, {text} AS t, {S_RX.replace('{t}', text)} AS s FROM {src}),
  nn AS (SELECT {key}, t, s, list_filter(list_transform(s, lambda x: {n}), lambda x: x > 0) AS n FROM ss),
  ag AS (SELECT {key}, t, s, n, len(n) AS sentences, coalesce(list_sum(n), 0) AS words, coalesce(list_avg(n), 0) AS mean, CASE WHEN len(n) > 1 THEN list_stddev_pop(n) ELSE 0 END AS sd FROM nn),
  rhythm AS (SELECT {key}, CAST(sentences AS BIGINT) AS sentences, CAST(words AS BIGINT) AS words, round_even(mean, 1) AS mean_len, round_even(sd, 1) AS stdev_len,
    round_even(CASE WHEN mean > 0 THEN sd / mean ELSE 0 END, 3) AS cv_len, coalesce(list_min(n), 0) AS min_len, coalesce(list_max(n), 0) AS max_len,
    CASE WHEN sentences > 0 THEN round_even(len(list_filter(n, lambda x: x < 5)) / sentences, 3) ELSE 0 END AS short_share,
    CASE WHEN sentences > 0 THEN round_even(len(list_filter(n, lambda x: x > 25)) / sentences, 3) ELSE 0 END AS long_share,
    len(regexp_extract_all(t, '—')) AS em_dash, len(regexp_extract_all(t, '…|\.\.\.')) AS ellipsis, len(regexp_extract_all(t, '\(')) AS parentheses,
    len(list_filter(s, lambda x: regexp_matches(x, '\?\s*$'))) AS questions FROM ag)"""


COLS = ["sentences", "words", "mean_len", "stdev_len", "cv_len", "min_len", "max_len", "short_share", "long_share", "em_dash",
        "ellipsis", "parentheses", "questions"]


@plan("rhythm", f"WITH {rhythm_sql('documents')} SELECT * FROM rhythm")
def rhythm(spark, sf):
    return R.with_rhythm(table(spark, sf, "documents")).select("doc_id", *COLS)


def _q(p: str) -> str:
    return p.replace("'", "''")


_BANS = ", ".join(f"('{_q(n)}', '{_q(p).replace(chr(92) + 'b', '').replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}')" for n, p in rules.HARD_BANS)
BANS = f"banrules AS (SELECT * FROM (VALUES {_BANS}) v(name, p)), bans AS (SELECT path, name, len(regexp_extract_all(lower(text), p)) AS n FROM src, banrules WHERE len(regexp_extract_all(lower(text), p)) > 0)"


def _marks():
    out = []
    for i, (cat, items) in enumerate(rules.MARKERS.items()):
        for j, m in enumerate(items):
            lit = not m.startswith("re:")
            out.append(f"({i * 100 + j}, '{cat}', '{_q(m.removeprefix('re:'))}', '{_q(m.removeprefix('re:').lower())}', {str(lit).lower()})")
    return ", ".join(out)


MARKS = f"""markrules AS (SELECT * FROM (VALUES {_marks()}) v(i, category, marker, p, lit)),
  marks AS (SELECT * FROM (SELECT path, category, marker, i, CASE WHEN lit THEN (length(low) - length(replace(low, p, ''))) // length(p) ELSE len(regexp_extract_all(low, p)) END AS n
    FROM (SELECT path, lower(text) AS low FROM src), markrules) WHERE n > 0)"""


@plan("banned_phrases", with_notes(f", src AS (SELECT path, text FROM notes), {BANS} SELECT path, name, n FROM bans"))
def banned_phrases(spark, sf):
    d = R.with_phrases(notes(spark, sf).select("path", "text"))
    return d.select("path", F.inline("bans"))


@plan("phrase_markers", with_notes(f", src AS (SELECT path, text FROM notes), {MARKS} SELECT path, category, CAST(sum(n) AS BIGINT) AS n FROM marks GROUP BY ALL"))
def phrase_markers(spark, sf):
    d = R.with_phrases(notes(spark, sf).select("path", "text")).select("path", F.inline("markers"))
    return d.groupBy("path", "category").agg(F.sum("n").alias("n"))


@plan("marker_verdicts", with_notes(f""", src AS (SELECT path, text FROM notes), {MARKS}, v AS (SELECT path, coalesce(sum(n), 0) AS n, coalesce(bool_or(category = '{rules.PASTE_CATEGORY}'), false) AS pasted
   FROM notes LEFT JOIN marks USING (path) GROUP BY path) SELECT CASE WHEN pasted THEN 'pasted' WHEN n <= 2 THEN 'clean' WHEN n <= 5 THEN 'suspicious' ELSE 'generated' END AS verdict, count(*) AS notes FROM v GROUP BY ALL"""))
def marker_verdicts(spark, sf):
    d = R.with_phrases(notes(spark, sf).select("path", "text"))
    return d.groupBy(R.marker_verdict(d).alias("verdict")).agg(F.count("*").alias("notes"))


SCORE = f"""{BANS}, {MARKS}, {rhythm_sql('src', 'path')},
  b AS (SELECT path, coalesce(sum(n), 0) AS ban_count, coalesce(sum(n) FILTER (name <> '{rules.DASH_BAN}'), 0) AS hard FROM src LEFT JOIN bans USING (path) GROUP BY path),
  m AS (SELECT path, coalesce(sum(n) FILTER (category = '{rules.PASTE_CATEGORY}'), 0) AS pasted, coalesce(sum(n) FILTER (category <> '{rules.PASTE_CATEGORY}'), 0) AS soft FROM src LEFT JOIN marks USING (path) GROUP BY path),
  pen AS (SELECT path, ban_count, hard, pasted, soft, least(45, 12 * hard) + CASE WHEN pasted > 0 THEN 60 ELSE 0 END + least(30, round_even(2 * (soft / greatest(words, 1) * 100), 0))
      + CASE WHEN em_dash / greatest(words, 1) * 100 > 2 THEN least(8, round_even(3 * (em_dash / greatest(words, 1) * 100 - 2), 0)) ELSE 0 END
      + CASE WHEN sentences >= 4 AND cv_len < 0.45 THEN least(20, round_even((0.45 - cv_len) / 0.45 * 30, 0)) ELSE 0 END AS p
    FROM rhythm JOIN b USING (path) JOIN m USING (path)),
  scored AS (SELECT *, CAST(greatest(0, least(100, 100 - p)) AS BIGINT) AS score FROM pen)"""


@plan("cleanliness_scan", with_notes(f""", src AS (SELECT path, text FROM notes), {SCORE} SELECT path, score, CASE WHEN score >= 85 THEN 'clean' WHEN score >= 60 THEN 'edit' ELSE 'rewrite' END AS band,
   CAST(ban_count AS BIGINT) AS ban_count, CAST(hard AS BIGINT) AS slop_count FROM scored"""))
def cleanliness_scan(spark, sf):
    return R.scan(notes(spark, sf).select("path", "text")).select("path", "score", "band", "ban_count", F.col("hard").alias("slop_count"))


@plan("cleanliness_distribution", with_notes(f""", src AS (SELECT path, text FROM notes), {SCORE}, o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM scored)
  SELECT count(*) AS notes, (SELECT score FROM o WHERE i = least(n - 1, floor(0.5 * n))) AS median_score, (SELECT score FROM o WHERE i = least(n - 1, floor(0.1 * n))) AS p10_score,
   count(*) FILTER (score >= 85) AS clean, count(*) FILTER (score BETWEEN 60 AND 84) AS edit, count(*) FILTER (score < 60) AS rewrite, count(*) FILTER (ban_count > 0) AS ban_notes, count(*) FILTER (hard > 0) AS slop_notes FROM scored"""))
def cleanliness_distribution(spark, sf):
    return R.distribution(R.scan(notes(spark, sf).select("path", "text")))


@plan("cleanliness_worst", with_notes(f", src AS (SELECT path, text FROM notes), {SCORE} SELECT path, score, CAST(ban_count AS BIGINT) AS ban_count FROM scored ORDER BY score, path LIMIT 300"))
def cleanliness_worst(spark, sf):
    return R.worst(R.scan(notes(spark, sf).select("path", "text")))


AFTER = ("CASE k % 5 WHEN 0 THEN replace(text, '2024-05-0', 'date ') WHEN 1 THEN replace(text, 'https://', '') WHEN 2 THEN replace(text, '## Достоверность', '## Другое') "
         "WHEN 3 THEN replace(text, 'note', 'memo') ELSE concat(text, ' extra 17') END")


def _pairs(spark, sf):
    return notes(spark, sf).selectExpr("path", "text AS before", f"{AFTER} AS after")


def _fact_sql(kind: str, rx: str) -> str:
    e = _q(rx)
    return (f"SELECT path, '{kind}' AS kind, v AS sample FROM (SELECT path, v, sum(b) AS nb, sum(a) AS na FROM (SELECT path, unnest(regexp_extract_all(before, '{e}')) AS v, 1 AS b, 0 AS a FROM pr"
            f" UNION ALL SELECT path, unnest(regexp_extract_all(after, '{e}')), 0, 1 FROM pr) GROUP BY path, v) WHERE "
            + ("nb > 0 AND na = 0" if kind == "latin" else "na < nb"))


_HEADS = " UNION ALL ".join(f"SELECT path, 'heading' AS kind, '{t}' AS sample FROM pr WHERE regexp_matches(before, '(?m){rules.body_heading(t)}') AND NOT regexp_matches(after, '(?m){rules.body_heading(t)}')" for t in rules.BODY_HEADINGS)
LOST = f"""pr AS (SELECT path, text AS before, {AFTER} AS after FROM notes WHERE NOT (text LIKE '---%' AND NOT regexp_matches(text, '(?s)^---\\n.*?\\n---\\n'))),
  lost AS ({' UNION ALL '.join(_fact_sql(k, r) for k, r in [*R.FACTS.items(), ('latin', R.LATIN_WORD)])} UNION ALL {_HEADS}
   UNION ALL SELECT path, 'byte', substr(blk, 1, 60) FROM (SELECT path, after, unnest(list_filter(list_concat(list_concat([regexp_extract(before, '(?s)^---\\n.*?\\n---\\n')],
       regexp_extract_all(before, '(?s)```.*?```')), list_concat(regexp_extract_all(regexp_replace(before, '(?s)```.*?```', ' ', 'g'), '`[^`\\n]+`'),
       [regexp_extract(before || chr(10) || '## ', '(?s)(## Достоверность.*?)\\n##\\s+', 1)])), lambda x: x <> '')) AS blk FROM pr) WHERE NOT contains(after, blk))"""


@plan("lost_facts", with_notes(f", {LOST} SELECT path, kind, sample FROM lost"))
def lost_facts(spark, sf):
    return R.preservation(_pairs(spark, sf)).filter("lost is not null").select("path", F.inline("lost"))


@plan("four_way_verdicts", with_notes(f""", {LOST}, src AS (SELECT path, after AS text FROM pr), {SCORE}, s AS (SELECT path, coalesce(bool_or(kind IN ('number', 'url', 'path', 'wikilink', 'version', 'isoDate', 'byte')), false) AS acc,
   coalesce(bool_or(kind IN ('latin', 'heading')), false) AS term FROM pr LEFT JOIN lost USING (path) GROUP BY path)
  SELECT NOT acc AS accuracy, ban_count = 0 AS language, score >= 85 AS style, NOT term AS terminology, count(*) AS n FROM s JOIN scored USING (path) GROUP BY ALL"""))
def four_way_verdicts(spark, sf):
    d = R.preservation(_pairs(spark, sf)).filter("lost is not null")
    d = R.scan(d, "after").withColumn("v", R.four_way(F.col("lost"), F.col("ban_count"), F.col("score")))
    return d.groupBy("v.accuracy", "v.language", "v.style", "v.terminology").agg(F.count("*").alias("n"))


@plan("rewrite_outcomes", with_notes(r"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN k % 89 = 0 AND k % 97 <> 0 THEN 'input-error' WHEN k % 7 IN (0, 2) THEN 'fixed' ELSE 'failed' END AS outcome FROM notes WHERE k % 7 IN (0, 1, 2, 4) AND NOT regexp_matches(path, '(^|/)[._]')) GROUP BY ALL"""))
def rewrite_outcomes(spark, sf):
    return R.rewrite_pass(notes(spark, sf).select("path", "text")).groupBy("outcome").agg(F.count("*").alias("n"))


def scan_text_sql(t: str) -> str:
    """The judged text: no head, code or untouchable section."""
    t = rf"regexp_replace({t}, '^(?s:---\r?\n.*?\r?\n---(?:\r?\n|$))', '')"
    t = rf"regexp_replace(regexp_replace({t}, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g')"
    for title in rules.UNTOUCHABLE:
        t = rf"regexp_replace({t}, '(?s)(?m:{rules.body_heading(title)}).*?(\n##\s+|\z)', ' \1', 'g')"
    return t


@plan("readability_sweep", with_notes(f""", src AS (SELECT path, {scan_text_sql("text")} AS text FROM (SELECT CASE WHEN k % 5 = 0 THEN '_old/' || base ELSE path END AS path, text FROM notes)
    WHERE NOT regexp_matches(path, '(^|/)[._]')), {SCORE}
  SELECT CASE WHEN hard > 0 THEN 'failure' WHEN ban_count > 0 OR score < 85 THEN 'advice' ELSE 'ok' END AS level, count(*) AS n, min(score) AS low FROM scored GROUP BY ALL"""))
def readability_sweep(spark, sf):
    n = notes(spark, sf).select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("_old/"), "base")).otherwise(F.col("path")).alias("path"), "text")
    return R.sweep(n).groupBy("level").agg(F.count("*").alias("n"), F.min("score").alias("low"))
