"""Coverage, accounting and change tracking over documents and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import coverage as V
from .fixtures import notes, with_notes
from .registry import plan, table
from .text_plans import FM_ROWS

CENSUS = "census AS (SELECT 'inbox/' || CASE doc_id % 3 WHEN 0 THEN 'file-' || doc_id || '.pdf' WHEN 1 THEN 'scan ' || doc_id || '.png' ELSE CASE WHEN doc_id < 60 THEN 'notes-' || doc_id % 60 ELSE 'memo-' || doc_id END || '.docx' END AS name, sha256(text) AS sha256, doc_id FROM documents)"


def census(spark, sf):
    i = F.col("doc_id")
    s = i.cast("string")
    name = F.when(i % 3 == 0, F.concat(F.lit("file-"), s, F.lit(".pdf"))).when(i % 3 == 1, F.concat(F.lit("scan "), s, F.lit(".png"))).otherwise(
        F.concat(F.when(i < 60, F.lit("notes-")).otherwise(F.lit("memo-")), s, F.lit(".docx")))
    return table(spark, sf, "documents").select(F.concat(F.lit("inbox/"), name).alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")


READY = "ready AS (SELECT path, base, text, k FROM notes WHERE k % 6 = 0 AND (k % 5 IN (0, 2)) AND regexp_matches(text, '(?s)status: \"final\".*Публичные источники:'))"
COVER = f"""{CENSUS}, {READY}, rf AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'local-media:([a-f0-9]{{16}})', 1)) AS r FROM ready),
  cov AS (SELECT name, CASE WHEN substr(sha256, 1, 16) IN (SELECT r FROM rf) THEN 'hash' WHEN EXISTS (SELECT 1 FROM notes n WHERE contains(n.text, substr(name, 7))) THEN 'name' END AS covered_by FROM census)"""


@plan("covered_inputs", with_notes(f", {COVER} SELECT name, covered_by FROM cov"))
def covered_inputs(spark, sf):
    return V.covered_inputs(census(spark, sf), notes(spark, sf)).select("name", "covered_by")


@plan("archive_decisions", with_notes(f""", {CENSUS}, {READY}, src AS (SELECT path, unnest(['file-' || k || '.pdf', 'notes-' || k % 50 || '.docx']) AS f FROM notes WHERE text LIKE '---%'),
  rf AS (SELECT path, unnest(list_distinct(regexp_extract_all(text, 'local-media:([a-f0-9]{{16}})', 1))) AS r FROM notes),
  m AS (SELECT name, path FROM census JOIN src ON f = substr(name, 7) UNION SELECT name, path FROM census JOIN rf ON r = substr(sha256, 1, 16)),
  g AS (SELECT name, count(*) AS notes, count(*) FILTER (path IN (SELECT path FROM ready)) AS strict_notes, array_to_string(list_slice(list(path ORDER BY path), 1, 8), ';') AS sample FROM m GROUP BY name)
  SELECT c.name, coalesce(notes, 0) AS notes, coalesce(strict_notes, 0) AS strict_notes, coalesce(strict_notes, 0) AS full_notes, coalesce(sample, '') AS sample,
    CASE WHEN strict_notes > 0 THEN 'archive' ELSE 'keep' END AS action FROM census c LEFT JOIN g USING (name)"""))
def archive_decisions(spark, sf):
    return V.archive_decisions(census(spark, sf), notes(spark, sf))


@plan("census_split", f"WITH {CENSUS} SELECT name, sha256 IN (SELECT sha256 FROM census WHERE doc_id % 4 = 0) AS cached FROM census")
def census_split(spark, sf):
    c = census(spark, sf)
    return V.census_split(c, c.filter("doc_id % 4 = 0")).select("name", "cached")


def _units(spark, sf):
    d = census(spark, sf).filter("doc_id % 5 > 0")
    return d.groupBy(F.concat(F.lit("g"), F.floor(F.col("doc_id") / 4).cast("string")).alias("group_id")).agg(F.collect_list("name").alias("files"))


@plan("complete_units", f"""WITH {CENSUS} SELECT 'g' || doc_id // 4 AS group_id, count(*) AS n FROM census WHERE doc_id % 5 > 0 GROUP BY ALL
  UNION ALL SELECT 'forced-' || substr(name, 7), 1 FROM census c WHERE doc_id % 10 <> 0 AND doc_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM census d WHERE d.name = c.name AND d.doc_id % 5 > 0)""")
def complete_units(spark, sf):
    c = census(spark, sf)
    return V.complete_units(c, _units(spark, sf), c.filter("doc_id % 10 = 0").select("name")).select("group_id", F.size("files").alias("n"))


DECLARED = "CASE doc_id % 7 WHEN 0 THEN 'dup' WHEN 1 THEN 'noise' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'deferred' END"
_STATUS = f"""cov2 AS (SELECT DISTINCT name FROM cov WHERE covered_by IS NOT NULL), dec AS (SELECT name, {DECLARED} AS reason, 'inbox/file-' || (doc_id * 2) || '.pdf' AS covering FROM census),
  st AS (SELECT d.name, CASE WHEN d.name IN (SELECT name FROM cov2) THEN 'noted' WHEN reason = 'dup' AND covering IN (SELECT name FROM cov2) THEN 'dup' WHEN reason IN ('noise', 'unreadable', 'deferred') THEN reason ELSE 'unaccounted' END AS status FROM dec d)"""


def _status(spark, sf):
    c = census(spark, sf)
    cov = V.covered_inputs(c, notes(spark, sf)).filter("covered_by is not null")
    dec = c.selectExpr("name", f"{DECLARED} AS reason", "concat('inbox/file-', cast(doc_id * 2 as string), '.pdf') AS covering").filter("reason is not null")
    return V.accounting(c, cov, dec), c


@plan("accounting_status", with_notes(f", {COVER}, {_STATUS} SELECT name, status FROM st"))
def accounting_status(spark, sf):
    return _status(spark, sf)[0]


@plan("ledger_balance", with_notes(f""", {COVER}, {_STATUS} SELECT count(*) AS census, {", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("noted", "dup", "noise", "unreadable", "deferred", "unaccounted"))},
   true AS balanced, CASE WHEN count(*) FILTER (status = 'unaccounted') = 0 THEN 'full' ELSE 'gaps' END AS verdict FROM st"""))
def ledger_balance(spark, sf):
    return V.ledger_balance(*_status(spark, sf))


@plan("gap_split", f"""WITH {CENSUS} SELECT name, CASE WHEN doc_id % 5 > 0 AND (doc_id // 4) % 2 = 0 AND doc_id % 12 <> 1 THEN 'provenance' ELSE 'real' END AS gap FROM census WHERE doc_id % 3 < 2""")
def gap_split(spark, sf):
    c = census(spark, sf).filter("doc_id % 3 < 2")
    u = _units(spark, sf)
    res = u.select("group_id", F.when(F.substring("group_id", 2, 20).cast("bigint") % 2 == 0, "note").otherwise("noise").alias("outcome"))
    return V.split_gaps(u, res, c.select("name"), c.filter("doc_id % 12 = 1").select("name"))


@plan("gap_union", f"""WITH {CENSUS}, o AS (SELECT DISTINCT name, unnest(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'code' END, CASE WHEN doc_id % 3 = 0 THEN 'reconciler' END, CASE WHEN doc_id % 5 = 0 THEN 'quality' END], lambda x: x IS NOT NULL)) AS origin FROM census)
  SELECT name, string_agg(origin, ',' ORDER BY origin) AS origins FROM o GROUP BY name""")
def gap_union(spark, sf):
    c = census(spark, sf)
    parts = [c.filter(f"doc_id % {m} = 0").select("name", F.lit(o).alias("origin")) for m, o in ((2, "code"), (3, "reconciler"), (5, "quality"))]
    return V.united_gaps(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@plan("groups_to_resume", "SELECT user_id AS group_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60) GROUP BY user_id")
def groups_to_resume(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "group_id")
    done = e.filter("event_type = 'purchase' and value > 60")
    return V.remaining_groups(e, done).groupBy("group_id").agg(F.count("*").alias("n"))


@plan("archive_worklist", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN h || '.png' END AS file, doc_id % 4 <> 0 OR h IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0) AS matched FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 > 0) WHERE true")
def archive_worklist(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3 == 0).alias("strict_final"))
    arch = d.filter("doc_id % 4 <> 0").select(F.concat("hash", F.lit(".png")).alias("file"))
    out = V.archive_worklist(d, arch)
    return out.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("file")).alias("file"), "matched")


# -- changes ----------------------------------------------------------------------
@plan("snapshot_rollup", with_notes(r"SELECT section AS top, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files, count(DISTINCT base) AS names, 0 AS links_inside, CAST(sum(len(regexp_extract_all(text, '\[\[[^\]\n]+\]\]'))) AS BIGINT) AS links_outside FROM notes GROUP BY section"))
def snapshot_rollup(spark, sf):
    return C.snapshot_rollup(C.snapshot_rows(notes(spark, sf)))


@plan("snapshot_changes", with_notes("""SELECT base AS basename, CASE WHEN k % 10 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'declared' ELSE 'undeclared' END AS change, CASE WHEN k % 10 <> 0 AND k % 7 = 0 THEN 'planned' END AS reason FROM notes WHERE k % 10 = 0 OR k % 10 = 1"""))
def snapshot_changes(spark, sf):
    n = notes(spark, sf)
    s = C.snapshot_rows(n).join(n.select("path", "k"), "path")
    said = s.select("basename", F.when(F.col("k") % 7 == 0, "planned").otherwise(" ").alias("reason"))
    return C.compare_snapshots(s.filter("k % 10 <> 1"), s.filter("k % 10 <> 0"), said)


@plan("quarantine_gate", with_notes("SELECT count(*) FILTER (regexp_matches(text, '(?m)^## Что это')) AS n, 0 AS appeared, count(*) + 5 - 5 AS listed, 'holds' AS verdict, count(*) AS ceiling FROM notes"))
def quarantine_gate(spark, sf):
    n = notes(spark, sf).withColumn("base", F.concat(F.lit("synthesis-"), "base"))
    layer = C.quarantine_layer(n)
    return C.quarantine_verdict(layer, layer, n.count())


@plan("failure_ratchet", with_notes(f""", {FM_ROWS}, f AS (SELECT section AS gate, count(*) AS failures FROM heads JOIN notes USING (path) WHERE fm_error IS NOT NULL GROUP BY section)
  SELECT gate, failures, 7 AS ceiling, failures <= 7 AS ok, least(failures, 7) AS next FROM f"""))
def failure_ratchet(spark, sf):
    from ..functions import frontmatter as fm
    bad = fm.with_frontmatter(notes(spark, sf)).filter("fm_error is not null").groupBy(F.col("section").alias("gate")).agg(F.count("*").alias("failures"))
    return C.ratchet(bad, notes(spark, sf).select(F.col("section").alias("gate"), F.lit(7).alias("ceiling")).distinct())


@plan("incremental_refresh", "SELECT doc_id, length(text) AS n, doc_id % 3 > 0 AS reused FROM documents")
def incremental_refresh(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    settings = {"version": "1", "model": "none"}

    def compute(x):
        return x.select("cache_key", F.col("path").alias("doc_id"), F.length("text").alias("n"))
    cached = compute(C.settings_key(d.filter("path % 3 > 0"), settings))
    return C.incremental(C.settings_key(d, settings), cached, compute).drop("cache_key")


@plan("new_submissions", "SELECT min(source) AS name, count(*) AS copies, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 9 = 0) GROUP BY sha256(text)")
def new_submissions(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("source").alias("name"), "doc_id")
    return C.new_submissions(d, d.filter("doc_id % 9 = 0"))


@plan("job_fingerprints", "SELECT job, sha256(string_agg(f, ',' ORDER BY p)) AS fingerprint FROM (SELECT source || doc_id % 50 AS job, substr(sha256(text), 1, 3) AS p, sha256(string_agg(DISTINCT sha256(text), ',' ORDER BY sha256(text))) AS f FROM documents GROUP BY ALL) GROUP BY job")
def job_fingerprints(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", (F.col("doc_id") % 50).cast("string")).alias("job"), F.sha2("text", 256).alias("sha256"))
    return C.job_fingerprints(d)


@plan("write_once_counts", "SELECT count(*) AS given, count(DISTINCT h) FILTER (h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)) AS written, count(*) - count(DISTINCT h) FILTER (h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)) AS skipped FROM (SELECT sha256(text) AS h FROM documents)")
def write_once_counts(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("fingerprint"), "doc_id")
    return C.write_once(d, d.filter("doc_id % 2 = 0"))[1]


@plan("block_upsert", "SELECT doc_id AS block_id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || source ELSE source END AS body FROM documents")
def block_upsert(spark, sf):
    d = table(spark, sf, "documents")
    cur = d.filter("doc_id % 8 <> 0").select(F.col("doc_id").alias("block_id"), F.col("source").alias("body"))
    new = d.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("block_id"), F.concat(F.lit("new "), "source").alias("body"))
    return C.upsert_blocks(cur, new)


@plan("kept_snapshots", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 3")
def kept_snapshots(spark, sf):
    return C.newest(table(spark, sf, "events"), 3, "ts", ["user_id"]).select("user_id", "event_id")


@plan("latest_report", "SELECT first(n ORDER BY contains(n, 'visual') DESC, ts DESC, n DESC) AS name FROM (SELECT event_type || CASE WHEN user_id % 50 = 0 THEN '-visual-' ELSE '-' END || event_id AS n, ts FROM events)")
def latest_report(spark, sf):
    n = F.concat("event_type", F.when(F.col("user_id") % 50 == 0, "-visual-").otherwise("-"), F.col("event_id").cast("string"))
    return C.latest_report(table(spark, sf, "events").select(n.alias("name"), F.col("ts").alias("mtime"))).select("name")
