"""Near duplicates: an exact Jaccard join of word shingle sets around pivots.

Jaccard distance is a metric, but unrelated texts all lie at distance 1 from
each other, so pivots drawn from the whole table would have every document on
every border.  Regions therefore start from shared shingles.  Sort every set by
one order, rare shingles first: two sets within the distance share a shingle
among the first n - ceil(t n) + 1 of each, so the documents that hold a shingle
there form a root region, and every link lies inside a root region.

In a region the document with the smallest id is the pivot.  Distances to it
settle most of the region: documents within the threshold are linked through
the pivot.  What is left are pairs of documents that no chain of links connects
yet.  By the triangle inequality such a pair can only be a link if the
distances of the two to the pivot differ by no more than the threshold - the
window around a border that has to look across it.  A pair is settled in the
region of the first shingle it shares, where it shares no more than what follows
there in either set; elsewhere the same bound may pass it over, which keeps
texts of one template, each with changes of its own, from all meeting each
other.  Large regions recur with a
new pivot among the unconnected; small ones, and what ``rounds`` leave of large
ones, are joined pair by pair within those windows.  No pair is ever dropped
without a bound that proves it is no link.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.graph import components

from .batches import discard, long_field, map_texts, slices, stored, texts_of

#: Hashes of words a worker keeps between texts: some 20 MB.
WORDS = 100_000

_words: dict[bytes, int] = {}


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a whole
    text (of the whole word sequence where it has fewer words)."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(_words) > WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(width):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def histogram(s: np.ndarray) -> bytes:
    """How many shingles fall in each class of hash values, a byte each, cut at 255.

    The number of classes is the power of two that gives each 4 to 8 shingles
    (64 at least), so unrelated sets of any size differ clearly.
    """
    bins = 64
    while bins * 8 < len(s):
        bins *= 2
    return np.minimum(np.bincount(s & (bins - 1), minlength=bins), 255).astype(np.uint8).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Least number of shingles in which two sets with these histograms differ.

    The finer histogram is folded to the other's classes; cut once more at 255,
    neither side can look farther from the other than it is.
    """
    a, b = (np.frombuffer(h, np.uint8).astype(np.int32) for h in (x, y))
    size = min(len(a), len(b))
    return int(np.abs(np.minimum(a.reshape(-1, size).sum(0), 255) - np.minimum(b.reshape(-1, size).sum(0), 255)).sum())


def frequent_shingles(docs: DataFrame, width: int, share: int, least: int, most: int) -> np.ndarray:
    """Shingles seen ``least`` times or more among the texts of one hash class in ``share``.

    They only decide the order of shingles inside sets, which any choice keeps
    exact; ``most`` bounds what is sent to the tasks.
    """
    some = docs.select(F.col("text").cast("string").alias("text")).filter(
        F.pmod(F.xxhash64("text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        done: set[int] = set()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(seen, np.int64, len(seen))
            n = np.fromiter(seen.values(), np.int64, len(seen))
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1])], names=["s", "n"])

        for b in slices(batches):
            for text in texts_of(b.column(0)):
                s = shingles(text, width)
                mark = hash(s.tobytes())
                if mark not in done:
                    done.add(mark)
                    seen.update(s.tolist())
            if len(seen) > 1_000_000:
                yield flush()
                seen.clear()
                done.clear()
        yield flush()

    rows = some.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(rows.orderBy(F.desc("n"), "s").limit(most).toPandas()["s"].to_numpy(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def described(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, mark, bins, prefix): size and hash of each document's set, and,
    for the first of equal sets a task meets, its histogram and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    seen: set[bytes] = set()  # of one task: each gets its own copy of this function

    def run(texts: list[str], _) -> list[pa.Array]:
        often, rows = sent.value, []
        for text in texts:
            s = shingles(text, width)
            mark = xxhash.xxh3_128_digest(s.tobytes())
            if not len(s) or mark in seen:
                rows.append((len(s), mark, None, None))
                continue
            if len(seen) < 1_000_000:
                seen.add(mark)
            hot = np.zeros(len(s), bool)
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                hot = often[at] == s
            order = np.concatenate((s[~hot], s[hot]))
            rows.append((len(s), mark, histogram(s), order[:prefix_length(len(s), percent)].tolist()))
        return [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())])]

    return map_texts(docs, ["doc_id"], run, [long_field("n"), T.StructField("mark", T.BinaryType()), T.StructField(
        "bins", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])


def texts_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents named in the stored table ``ids``.

    A stored table has a known size, so Spark sends a small one to the scan of
    the texts and shuffles the texts only for a large one.
    """
    some = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(some.join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def bounded(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(a, b, least) of the pairs that sizes and histograms cannot rule out, with
    a lower bound of the distance.

    Sets that differ in at least L shingles have a similarity of at most
    (na + nb - L) / (na + nb + L).
    """
    def side(x: str) -> DataFrame:
        return facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}"))

    both = pairs.join(side("a"), "a").filter("na > 0").join(side("b"), "b").filter(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("least", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            off = np.fromiter(map(apart, b.column(3).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
            top = np.maximum(na + nb - off, 0)
            keep = 100 * top >= percent * (na + nb + off)
            least = 1 - top / (na + nb + off)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)),
                                              pa.array(least[keep])], names=["a", "b", "least"])

    return both.select("a", "b", "na", "binsa", "nb", "binsb").mapInArrow(run, schema)


def measured(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of each pair's sets.

    Texts travel, as they are smaller than their sets; the rows of one pivot
    come together and its set is made once.
    """
    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    met = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], long_field("both"), long_field("either")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.empty(0, np.int64)
        for b in slices(batches, 128):
            both, either = [], []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if a != last:
                    last, first = a, shingles(x, width)
                second = shingles(y, width)
                n = len(np.intersect1d(first, second, assume_unique=True))
                both.append(n)
                either.append(len(first) + len(second) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                                             names=schema.names)

    return met.mapInArrow(run, schema)


def connected(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after more links: only links between components met so
    far are followed, so a later call works on what the earlier ones left open."""
    ends = links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).distinct()
    if label is None:
        return stored(components(ends, links), "labels")
    lu, lv = (label.select(F.col("id").alias(x), F.col("component").alias(f"l{x}")) for x in ("u", "v"))
    between = stored(links.join(lu, "u", "left").join(lv, "v", "left").select(
        F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")).filter("u <> v").distinct(), "between")
    if between.isEmpty():
        return label
    heads = between.select(F.col("u").alias("id")).union(between.select(F.col("v").alias("id"))).distinct()
    top = stored(components(heads, between), "heads").select(F.col("id").alias("component"), F.col("component").alias("top"))
    every = label.unionByName(ends.join(label, "id", "left_anti").select("id", F.col("id").alias("component")))
    return stored(every.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, small: int = 64, rounds: int = 2,
                    share: int = 16, least: int = 6, most: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union|
    of their shingle sets; ``component_id`` is the smallest doc_id a chain of
    links reaches.  Equal sets are one document in all that follows, so copies
    cost nothing beyond their hashes.

    A null, empty or blank text has no shingles and is linked with nothing; a
    text of fewer than ``width`` words has its word sequence as only shingle.
    Repeated rows get equal results (of different texts under one id, one is
    taken for the id's links); a row with a null doc_id gets the component of
    its equals, or null without any.
    An empty table gives no rows; columns besides doc_id and text are not read.
    """
    far = 1 - percent / 100
    frequent = frequent_shingles(docs, width, share, least, most)
    seen = stored(described(docs, width, percent, frequent), "sets")
    groups = seen.filter("n > 0").groupBy("mark")
    classes = stored(groups.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"),
                                F.first("bins", ignorenulls=True).alias("bins")), "classes")
    nodes = classes.filter("id is not null").dropDuplicates(["id"])
    facts = nodes.select("id", "n", "bins")
    # root regions; in the order of ids the first member is the pivot, and no region is held in memory
    posted = groups.agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix", ignorenulls=True).alias(
        "prefix")).filter("id is not null").select(F.posexplode("prefix").alias("at", "region"), "id", "n").withColumn(
        "after", F.col("n") - F.col("at")).drop("at")
    w = Window.partitionBy("region").orderBy("id")
    ranked = posted.withColumn("pivot", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "next", F.lead("id").over(w))
    members = stored(ranked.filter("pivot <> id or next is not null").select("region", "id", "pivot", "n", "after"), "regions")
    sizes = stored(seen.select("doc_id", "n", "mark"), "sizes")
    discard(seen)
    link = F.expr(f"100 * both >= {percent} * either")
    tried = known = texts = label = None

    def follow(pairs: DataFrame) -> None:
        """Measure what bounds leave of new pairs and connect what they link."""
        nonlocal tried, known, texts, label
        asked = stored(pairs, "asked")
        tried = asked if tried is None else tried.unionByName(asked)
        left = stored(bounded(asked, facts, percent), "pairs")
        if texts is None:
            texts = texts_for(docs, stored(ends_of(left), "ids"))
        else:
            more = stored(ends_of(left).join(texts.select("id"), "id", "left_anti"), "ids")
            if not more.isEmpty():
                texts = texts.unionByName(texts_for(docs, more))
        found = stored(measured(left, texts, width), "measured")
        known = found if known is None else known.unionByName(found)
        label = connected(label, found.filter(link).select(F.col("a").alias("u"), F.col("b").alias("v")))

    # a document first meets the pivot that leads most of its regions, then those other pivots that nothing connects it with
    led = stored(members.filter("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(
        F.count("*").alias("n")), "led")
    best = led.groupBy("b").agg(F.min(F.struct(-F.col("n"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    follow(best)
    la, lb = (label.select(F.col("id").alias(x), F.col("component").alias(f"l{x}")) for x in ("a", "b"))
    follow(led.select("a", "b").join(tried, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").filter(
        "coalesce(la, a) <> coalesce(lb, b)").select("a", "b"))
    for turn in range(rounds + 1):
        named = members.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        spread = named.groupBy("region").agg(F.min("n").alias("shortest"), F.min("label").alias("low"),
                                             F.max("label").alias("high"), F.max(F.when(
                                                 F.col("id") == F.col("pivot"), F.col("label"))).alias("main")).filter("low <> high")
        # distance to the region's pivot, or the bound that ruled the pair out: the window's place
        place = known.select(F.col("a").alias("pivot"), F.col("b").alias("id"),
                             F.expr("1 - both / either").alias("d"))
        # those that can share enough with the smallest set there, should the region be where they first meet
        able = F.expr(f"{100 + percent} * after >= {percent} * (n + shortest)")
        open_ = named.join(spread.select("region", "shortest", "main"), "region").filter(able).join(place, ["pivot", "id"], "left").withColumn(
            "d", F.when(F.col("id") == F.col("pivot"), 0.0).otherwise(F.col("d")))
        open_ = stored(open_.select("region", "id", "pivot", "label", "main", "n", "after", "d"), "open")
        if turn < rounds:
            open_ = open_.join(open_.groupBy("region").agg(F.count("*").alias("size")), "region")
        whole = F.lit(True) if turn == rounds else F.col("size") <= small
        y = open_.filter(whole & (F.col("id") != F.col("pivot")))
        # one side of an open pair is outside the component of the pivot; those are few where the region is large
        x = y.filter("label <> main").select("region", *[F.col(c).alias(c + "2") for c in ("id", "label", "n", "after", "d")])
        window = F.coalesce(F.abs(F.col("d") - F.col("d2")) <= far + 1e-9, F.lit(True))
        enough = F.expr(f"{100 + percent} * least(after, after2) >= {percent} * (n + n2)")
        pairs = x.join(y, "region").filter((F.col("label") != F.col("label2")) & enough & window).select(
            F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        # large regions: a new pivot among those that the old one does not reach
        big = open_.filter(~whole)
        fresh = big.join(big.filter("label <> main").groupBy("region").agg(F.min("id").alias("fresh")), "region")
        led_by = fresh.filter("id = fresh").select("region", F.col("label").alias("own"))
        pairs = pairs.unionByName(fresh.join(led_by, "region").filter("label <> own").select(
            F.least("id", "fresh").alias("a"), F.greatest("id", "fresh").alias("b")))
        follow(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        members = fresh.select("region", "id", F.col("fresh").alias("pivot"), "n", "after")
        if members.isEmpty():
            break
        members = stored(members, "regions")
    label = classes.join(label, "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    return sizes.join(label, "mark", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
