"""Is every input accounted for: coverage, accounting, gaps, resume.

Inputs are ``census(name, sha256, ...)``; notes are ``notes(path, base, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import require_rows
from .parsing import source_basenames, strictly_ready
from .substring import containing


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def cited_refs(notes: DataFrame) -> DataFrame:
    """(path, ref): digests a note cites, sixteen or sixty-four hex digits."""
    rx = r"(?i)local-media:([a-f0-9]{64}|[a-f0-9]{16})(?![a-f0-9])"
    return notes.select("path", F.explode(F.array_distinct(F.transform(T.find_all(F.col("text"), rx, 1), F.lower))).alias("ref"))


def covered_inputs(census: DataFrame, notes: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Census with ``covered_by``: name, hash or null.

    The cheap equi-join on cited digests of ready notes runs first; only what is
    left goes to the name search, and that search follows words, not a nested
    loop.  A name and its note must be in one normal form (done at ingest).
    """
    require_rows(census, "census", allow_empty)
    refs = cited_refs(notes.filter(strictly_ready(F.col("text")))).select("ref").distinct()
    keyed = census.select("name", F.explode(F.array(F.col("sha256"), F.substring("sha256", 1, 16))).alias("ref"))
    by_hash = keyed.join(refs, "ref", "left_semi").select("name").distinct()
    rest = census.join(by_hash, "name", "left_anti").select(base_name(F.col("name")).alias("needle")).distinct()
    by_name = containing(notes.select("path", "text"), rest).select("needle").distinct().withColumn("_n", F.lit(True))
    d = census.join(by_hash.withColumn("_h", F.lit(True)), "name", "left").withColumn("needle", base_name(F.col("name")))
    d = d.join(by_name, "needle", "left")
    return d.withColumn("covered_by", F.when(F.col("_h"), "hash").when(F.col("_n"), "name")).drop("_h", "_n", "needle")


def archive_decisions(census: DataFrame, notes: DataFrame, weak: bool = False, keep: int = 8) -> DataFrame:
    """Per input: matched, strict and full-strict notes, first names, decision.

    A note matches by reference, by digest or by a listed source file; three
    equi-joins, united.  Counts are aggregates; the sample is cut to ``keep``
    before it is collected.
    """
    n = notes.select("path", "base", "text", strictly_ready(F.col("text")).alias("strict"))
    text_hash = n.select("path", F.explode(F.array_distinct(T.find_all(F.col("text"), r"[a-f0-9]{64}"))).alias("key"))
    ref = n.select("path", F.explode(F.array_distinct(T.find_all(F.col("text"), r"local-media:([a-f0-9]{16})", 1))).alias("key"))
    src = n.select("path", F.explode(source_basenames(F.col("text"))).alias("key"))
    c = census.select("name", F.col("sha256").alias("h"), F.substring("sha256", 1, 16).alias("r"), base_name(F.col("name")).alias("b"))
    hits = (c.join(text_hash, c["h"] == text_hash["key"]).select("name", "path")
            .union(c.join(ref, c["r"] == ref["key"]).select("name", "path"))
            .union(c.join(src, c["b"] == src["key"]).select("name", "path")).distinct())
    full = hits.join(n.select("path", "strict", (F.col("strict") & ~F.col("base").startswith("synthesis-")).alias("full")), "path")
    sums = full.groupBy("name").agg(F.count("*").alias("notes"), F.count_if("strict").alias("strict_notes"), F.count_if("full").alias("full_notes"))
    w = Window.partitionBy("name").orderBy("path")
    first = (full.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).groupBy("name")
             .agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("sample")))
    d = census.select("name").join(sums, "name", "left").join(first, "name", "left").fillna(0).fillna("", ["sample"])
    may = F.col("notes") > 0 if weak else F.col("full_notes") > 0
    return d.withColumn("action", F.when(may, "archive").otherwise("keep"))


def census_split(census: DataFrame, cache: DataFrame) -> DataFrame:
    """Census with ``cached``: the digest is in the hash cache."""
    known = cache.select("sha256").distinct().withColumn("_c", F.lit(True))
    return census.join(known, "sha256", "left").withColumn("cached", F.coalesce("_c", F.lit(False))).drop("_c")


def complete_units(census: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """Units plus a forced one-file unit for every input no list mentions.
    ``units(group_id, files)``, ``excluded(name)``."""
    named = units.select(F.explode("files").alias("name")).union(excluded.select("name"))
    named = named.select(base_name(F.col("name")).alias("b")).distinct()
    gone = (census.select("name", base_name(F.col("name")).alias("b")).join(named, "b", "left_anti")
            .select(F.concat(F.lit("forced-"), F.col("b")).alias("group_id"), F.array("name").alias("files")))
    return units.select("group_id", "files").unionByName(gone)


def accounting(census: DataFrame, covered: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, status): noted, dup, noise, unreadable, deferred or unaccounted.

    ``covered(name)`` have a note.  A declared duplicate counts only when the
    note it points to exists: ``declared(name, reason, covering)`` with
    ``covering`` another input's name.
    """
    c = covered.select("name").distinct()
    has = c.withColumn("_n", F.lit(True))
    cov = c.select(F.col("name").alias("covering")).withColumn("_d", F.lit(True))
    one = declared.groupBy("name").agg(F.min_by(F.struct("reason", "covering"), F.struct("reason", "covering")).alias("x"))
    one = one.select("name", "x.reason", "x.covering").join(cov, "covering", "left")
    d = census.select("name").join(has, "name", "left").join(one, "name", "left")
    status = (F.when(F.col("_n"), "noted").when((F.col("reason") == "dup") & F.col("_d"), "dup")
              .when(F.col("reason").isin("noise", "unreadable", "deferred"), F.col("reason")).otherwise("unaccounted"))
    return d.select("name", status.alias("status"))


def ledger_balance(status: DataFrame, census: DataFrame) -> DataFrame:
    """Counts per status against the census, one row with the verdict."""
    kinds = ["noted", "dup", "noise", "unreadable", "deferred", "unaccounted"]
    a = status.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("*").alias("_t"))
    d = a.crossJoin(census.agg(F.count("*").alias("census")))  # one row each
    return d.select("census", *kinds, (F.col("_t") == F.col("census")).alias("balanced"),
                    F.when(F.col("unaccounted") == 0, "full").otherwise("gaps").alias("verdict"))


def split_gaps(units: DataFrame, results: DataFrame, unaccounted: DataFrame, quality_failed: DataFrame | None = None) -> DataFrame:
    """(name, gap): provenance when the file's group gave a note, else real; a
    note that failed its gate leaves a real gap."""
    gave = results.filter("outcome = 'note'").select("group_id").distinct()
    noted = units.join(gave, "group_id", "left_semi").select(F.explode("files").alias("f"))
    noted = noted.select(base_name(F.col("f")).alias("b")).distinct().withColumn("_g", F.lit(True))
    d = unaccounted.select("name", base_name(F.col("name")).alias("b")).join(noted, "b", "left")
    if quality_failed is not None:
        d = d.join(quality_failed.select("name").distinct().withColumn("_q", F.lit(True)), "name", "left")
    else:
        d = d.withColumn("_q", F.lit(None).cast("boolean"))
    return d.select("name", F.when(F.col("_g") & F.col("_q").isNull(), "provenance").otherwise("real").alias("gap"))


def united_gaps(gaps: DataFrame) -> DataFrame:
    """``gaps(name, origin)`` from any number of checks: none erases another."""
    return gaps.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


def remaining_groups(units: DataFrame, finished: DataFrame) -> DataFrame:
    return units.join(finished.select("group_id").distinct(), "group_id", "left_anti")


def archive_worklist(ledger: DataFrame, archive: DataFrame) -> DataFrame:
    """Pending ledger rows with their archived file; null when it is missing.
    ``ledger(hash, strict_final)``, ``archive(file)`` named by digest."""
    a = archive.select(F.substring("file", 1, 64).alias("hash"), "file").groupBy("hash").agg(F.min("file").alias("file"))
    return ledger.filter(~F.col("strict_final")).join(a, "hash", "left").withColumn("matched", F.col("file").isNotNull())
