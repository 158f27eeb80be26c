"""Snapshots, ratchets and incremental recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def snapshot_rows(files: DataFrame) -> DataFrame:
    """(path, basename, sha256, bytes, links, derived) of every note."""
    derived = F.exists(F.split("path", "/"), lambda p: p.startswith(rules.GRAPH_FOLDER))
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("basename"), F.sha2("text", 256).alias("sha256"),
                        F.octet_length("text").alias("bytes"), T.count_of(F.col("text"), r"\[\[[^\]\n]+\]\]").alias("links"),
                        derived.alias("derived"))


def snapshot_rollup(snap: DataFrame) -> DataFrame:
    """Bytes, files and links per top directory, derived directories apart."""
    return snap.groupBy(F.split("path", "/")[0].alias("top")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.count_distinct("basename").alias("names"),
        F.sum(F.when(F.col("derived"), F.col("links")).otherwise(0)).alias("links_inside"),
        F.sum(F.when(~F.col("derived"), F.col("links")).otherwise(0)).alias("links_outside"))


def compare_snapshots(before: DataFrame, after: DataFrame, declared: DataFrame) -> DataFrame:
    """(basename, change, reason): missing, declared or undeclared names.

    A declaration without a reason declares nothing.
    """
    b, a = before.select("basename").distinct(), after.select("basename").distinct()
    ok = (declared.filter(F.coalesce(F.trim("reason"), F.lit("")) != "").groupBy("basename").agg(F.min("reason").alias("reason")))
    gone = b.join(a, "basename", "left_anti").select("basename", F.lit("missing").alias("change"), F.lit(None).cast("string").alias("reason"))
    new = a.join(b, "basename", "left_anti").join(ok, "basename", "left").select(
        "basename", F.when(F.col("reason").isNotNull(), "declared").otherwise("undeclared").alias("change"), "reason")
    return gone.unionByName(new)


def newest(df: DataFrame, keep: int, by: str, keys: list[str] | None = None) -> DataFrame:
    """Newest ``keep`` rows (of each key)."""
    if not keys:
        return df.orderBy(F.desc(by)).limit(keep)
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def latest_report(reports: DataFrame, mark: str = "visual") -> DataFrame:
    """Newest report, marked ones before all others; one row."""
    order = F.struct(F.col("name").contains(mark), F.col("mtime"), F.col("name"))
    return reports.agg(F.max_by("name", order).alias("name"), F.max_by("mtime", order).alias("mtime"))


def quarantine_layer(notes: DataFrame) -> DataFrame:
    """Notes either detector names: a synthesis file name or the atomised heading."""
    hit = F.col("base").rlike(r"^synthesis-.*\.md$") | F.col("text").rlike(rules.ATOMISED_HEADING)
    return notes.filter(hit).select("path", F.sha2("text", 256).alias("sha256"))


def quarantine_verdict(layer: DataFrame, manifest: DataFrame, ceiling: int) -> DataFrame:
    """One row: size, newcomers, verdict and the next ceiling (never higher)."""
    new = layer.join(manifest.select("path"), "path", "left_anti").agg(F.count("*").alias("appeared"))
    d = (layer.agg(F.count("*").alias("n")).crossJoin(new)  # one row each
         .crossJoin(manifest.agg(F.count("*").alias("listed"))))
    verdict = (F.when(F.col("listed") != ceiling, "manifest-mismatch").when(F.col("appeared") > 0, "appeared")
               .when(F.col("n") > ceiling, "grew").when(F.col("n") < ceiling, "shrank").otherwise("holds"))
    d = d.withColumn("verdict", verdict)
    return d.withColumn("ceiling", F.when(F.col("verdict") == "shrank", F.col("n")).otherwise(F.lit(ceiling)))


def ratchet(measured: DataFrame, stored: DataFrame) -> DataFrame:
    """(gate, failures, ceiling, ok, next): the ceiling only moves down."""
    d = measured.join(stored, "gate", "left")
    return d.select("gate", "failures", "ceiling", (F.coalesce(F.col("failures") <= F.col("ceiling"), F.lit(True))).alias("ok"),
                    F.least("failures", F.coalesce("ceiling", "failures")).alias("next"))


def settings_key(df: DataFrame, settings: dict[str, str], key: str = "path", text: str = "text") -> DataFrame:
    """Digest of content and settings: equal digests may reuse a result."""
    parts = [F.col(key).cast("string").alias("key"), F.sha2(text, 256).alias("text_sha256")]
    parts += [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return df.withColumn("cache_key", F.sha2(F.to_json(F.struct(*parts)), 256))


def incremental(keyed: DataFrame, cached: DataFrame, compute) -> DataFrame:
    """Results of unchanged rows from the cache, the rest from ``compute``."""
    todo = keyed.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")
    kept = cached.join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
    fresh = compute(todo)
    return kept.select(*cached.columns).withColumn("reused", F.lit(True)).unionByName(
        fresh.select(*cached.columns).withColumn("reused", F.lit(False)))


def new_submissions(files: DataFrame, live: DataFrame) -> DataFrame:
    """First copy of each content in a submission that no live job holds."""
    first = files.groupBy("sha256").agg(F.min("name").alias("name"), F.count("*").alias("copies"))
    return first.join(live.select("sha256").distinct(), "sha256", "left_anti")


def job_fingerprints(files: DataFrame, job: str = "job", digits: int = 3) -> DataFrame:
    """(job, fingerprint) over the distinct digests of a job's files, in two levels.

    The sorted digests that share their first ``digits`` hex digits give one
    hash, and those hashes in order give the job's, so no list holds a job: a
    job of any size meets in at most 16 ** digits short lists.
    """
    def joined(values: Column) -> Column:
        return F.sha2(F.array_join(values, ","), 256)
    part = files.select(job, "sha256").distinct().groupBy(job, F.substring("sha256", 1, digits).alias("_p")).agg(
        joined(F.array_sort(F.collect_list("sha256"))).alias("_h"))
    return part.groupBy(job).agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"])).alias("fingerprint"))


def write_once(new: DataFrame, existing: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """Rows to append and the count of those whose key is already there."""
    known = existing.select(key).distinct()
    first = new.dropDuplicates([key])
    fresh = first.join(known, key, "left_anti")
    skipped = new.agg(F.count("*").alias("given")).crossJoin(fresh.agg(F.count("*").alias("written")))  # one row each
    return fresh, skipped.withColumn("skipped", F.col("given") - F.col("written"))


def upsert_blocks(current: DataFrame, incoming: DataFrame, key: str = "block_id") -> DataFrame:
    """A block with a known id is replaced, a new one appended."""
    n = incoming.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in incoming.columns if c != key], F.lit(True).alias("_new"))
    d = current.join(n, key, "full_outer")
    return d.select(key, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns if c != key])
