"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the mean number of copies the mix takes of it.
Among all rates that give each source its target of words, entropy balancing
takes those closest to 1 in relative entropy.  Their form is known: the rate of
a document is exp(lambda * size / mean size) with one multiplier for each
source, cut off at the largest rate allowed.  The multipliers minimise a convex
dual; Newton steps on it need two sums a source and step, which Spark takes over
all documents.  Rates depend on source and size alone, so those sums run over
the counts of (source, size), not over texts.

Rates become whole copies bucket by bucket: from the largest document down, a
document takes the copies that bring the words taken so far closest to the sum
of rate * size, so a bucket ends within about its smallest document of it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import long_field, stored

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], cap: float) -> dict[str | None, float]:
    """Words the mix shall take of each source: all sizes shared by weight, a
    source's share cut at ``cap`` times its size, the excess shared again by
    weight among the others until none is above."""
    left, total, out = dict(weights), float(sum(sizes.values())), {}
    while left:
        unit = total / sum(left.values())
        full = [s for s, w in left.items() if w * unit > cap * sizes[s]]
        if not full:
            return out | {s: w * unit for s, w in left.items()}
        for s in full:
            out[s] = cap * sizes[s]
            total -= out[s]
            del left[s]
    return out


def solve(counts: DataFrame, goal: dict[int, tuple[float, float, int, int]], cap: float, tolerance: float = 1e-9,
          most_rounds: int = 200) -> dict[int, float]:
    """Multiplier of each source.

    ``counts`` holds (sid, size, n); ``goal`` maps sid to (target, mean size,
    documents, smallest size above 0).  A round is one aggregation of the sums
    of taken words and their derivative.  The root lies between bounds known
    beforehand; a Newton step (on the logarithm, which is nearly straight) that
    would leave them is halved into them, so rounds always end.
    """
    spark = counts.sparkSession
    low, high, lam = {}, {}, {}
    for s, (target, mean, n, least) in goal.items():
        ratio = target / (mean * n)
        if ratio >= cap * (1 - 1e-12):
            continue  # everything is taken cap times
        low[s] = 0.0 if ratio >= 1 else -1 / (math.e * ratio) - 1e-9
        high[s] = 0.0 if ratio < 1 else math.log(cap) * mean / least + 1e-9
        lam[s] = min(max(math.log(ratio), low[s]), high[s])
    open_ = set(lam)
    for _ in range(most_rounds):
        if not open_:
            break
        now = spark.createDataFrame([(s, lam[s], goal[s][1]) for s in open_], "sid2 int, lam double, mean double")
        rate = F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean")), F.lit(float(cap)))
        words = F.col("n") * F.col("size")
        sums = counts.join(F.broadcast(now), F.col("sid") == F.col("sid2")).groupBy("sid").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < cap, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")).collect()
        for r in sums:
            s, target = r["sid"], goal[r["sid"]][0]
            gap = math.log(r["taken"] / target) if r["taken"] > 0 else -math.inf
            if abs(gap) <= tolerance:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap * r["taken"] / r["slope"] if r["slope"] > 0 else math.nan
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] <= 1e-12 * max(1.0, abs(lam[s])):
                open_.discard(s)
    return lam


def rounded(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Whole copies of the documents of one bucket."""
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last")
    owed, copies = 0.0, []
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist()):
        owed += rate * size
        n = min(cap, max(0, math.floor(owed / size + 0.5))) if size else min(cap, math.floor(rate + 0.5))
        owed -= n * size
        copies.append(n)
    return rows.assign(copies=copies)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, cap: int = 3, bucket: int = 2000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, rate) of every row of ``docs``.

    ``size`` counts the words of a whole text, ``target`` is in words for the
    row's source, ``taken`` is copies * size.  Without ``weights`` the sources
    in code point order (null last) weigh 1, 2, 3, 1, ...; a source missing from
    given weights is not taken.  No rate exceeds ``cap``.  Sources are a
    catalogue, as their weights are: one row each goes to the driver.

    A null text is empty; a document without words takes nothing but keeps a
    copy; a source without words has target 0.  A null source is a source.  A
    null doc_id or a repeated row is a document like any other.  An empty table
    gives no rows; columns besides doc_id, text and source are not read.
    """
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                               F.col("text").cast("string").alias("text")).select(
        "doc_id", "source", word_count("text").alias("size")), "sizes")
    table = {r["source"]: r for r in sized.groupBy("source").agg(
        F.sum("size").alias("size"), F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
        F.count(F.when(F.col("size") > 0, 1)).alias("full")).collect()}
    names = sorted(table, key=lambda s: (s is None, s or ""))
    weights = weights or {s: 1.0 + i % 3 for i, s in enumerate(names)}
    live = {s: weights[s] for s in names if weights.get(s, 0) > 0}
    goal = targets({s: table[s]["size"] for s in names}, live, float(cap))
    sid = {s: i for i, s in enumerate(names)}
    want = {sid[s]: (t, table[s]["size"] / table[s]["full"], table[s]["full"], table[s]["least"])
            for s, t in goal.items() if t > 0}
    schema = ("source2 string, sid int, source_size long, target double, mean double, lam double, buckets int")
    catalogue = [(s, sid[s], table[s]["size"], float(goal.get(s, 0.0)), 1.0, None, -(-table[s]["n"] // bucket)) for s in names]
    known = F.broadcast(spark.createDataFrame(catalogue, schema))
    on = F.col("source").eqNullSafe(F.col("source2"))
    counts = stored(sized.filter("size > 0").join(known, on).groupBy("sid", "size").agg(F.count("*").alias("n")), "counts")
    lam = solve(counts, want, cap)
    catalogue = [(s, i, size, t, want[i][1] if i in want else 1.0, lam.get(i), b) for s, i, size, t, _, _, b in catalogue]
    known = F.broadcast(spark.createDataFrame(catalogue, schema))
    rate = F.when(F.col("target") <= 0, F.when(F.col("source_size") == 0, 1.0).otherwise(0.0)).when(
        F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(cap)).otherwise(
        F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean")), F.lit(float(cap))))
    rows = sized.join(known, on).select(
        "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "sid",
        F.pmod(F.xxhash64("doc_id"), F.col("buckets")).cast("int").alias("bucket"))
    out = T.StructType([*rows.schema.fields, long_field("copies")])
    done = rows.groupBy("sid", "bucket").applyInPandas(lambda b: rounded(b, cap), out)
    return done.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
