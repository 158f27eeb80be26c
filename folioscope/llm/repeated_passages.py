"""Removal of long passages that an earlier document holds, by suffix order and run-compressed BWT.

A suffix array of the whole corpus would need the corpus in one place, so only
the parts of texts that can match are indexed, in buckets that never need each
other:

1. Anchors.  Every window of ``length`` bytes holds a lowest ``seed``-byte
   string by hash (its minimizer); equal windows hold the same one at the same
   place.  Anchors that one document alone has cannot lie in a match.
2. Contexts.  Around every shared anchor the bytes of all windows that hold it
   are cut out.  Equal contexts are one, with the smallest document they occur
   in; all later documents lose them whole.
3. Index.  Contexts of a bucket of anchors lie behind each other.  Prefix
   doubling sorts their suffixes to the depth of a match; the Burrows-Wheeler
   transform in that order is kept as runs (equal preceding byte, equal prefix
   of ``length`` bytes), each run with its first and last suffix as samples.
   Suffixes come in the order of documents, so a run's first sample carries its
   smallest document, and the smallest of the runs that share a prefix is the
   earliest document with that match.  Streaming a context's positions through
   the runs tells where its matching statistic against earlier documents
   reaches ``length``.
4. Crowded anchors.  Contexts of an anchor that has more of them than a bucket
   holds are not indexed: their windows (128-bit hashes) are aggregated to the
   smallest document on Spark and joined back, so no task holds a group.

Exact copies are settled beforehand by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import discard, long_field, slices, stored, texts_of


def eights(raw: bytes, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from every position as one word, first byte lowest (``>u8``: highest)."""
    out = np.empty(max(len(raw) - 7, 0), np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(raw, kind, (len(raw) - k) // 8, k)
    return out


def seeds(raw: bytes, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (16 at least, 24 at most) from every position."""
    words, n = eights(raw), len(raw) - size + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    out += words[8:8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    out += words[size - 8:size - 8 + n] * np.uint64(0x165667B19E3779F9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every w neighbours."""
    done = 1
    while 2 * done <= w:
        a, done = pick(a[:-done], a[done:]), 2 * done
    return pick(a[:len(a) - (w - done)], a[w - done:]) if w > done else a


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the lowest of some w neighbours, ties included."""
    low = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), w, np.maximum) == h)


def anchors_of(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, doc_id): distinct anchors of the first of equal texts a task meets."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    schema = T.StructType([src.schema["doc_id"], T.StructField("h", T.ArrayType(T.LongType()))])
    seen: set[bytes] = set()  # of one task: each gets its own copy of this function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, found = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                raw = text.encode()
                if len(raw) < length:
                    continue
                mark = xxhash.xxh3_128_digest(raw)
                if mark in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(mark)
                h = seeds(raw, seed)
                ids.append(doc_id)
                found.append(np.unique(h[minimizers(h, length - seed + 1)].view(np.int64)))
            stops = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.ListArray.from_arrays(
                pa.array(stops), pa.array(flat))], names=["doc_id", "h"])

    return src.mapInArrow(run, schema).select(F.explode("h").alias("h"), "doc_id")


def contexts_of(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(h, c, doc_id, start, bytes, lead): the context of every shared anchor; c is its hash, and lead
    marks the first of a text's equal ones."""
    schema = T.StructType([long_field("h"), long_field("c"), texts.schema["doc_id"], long_field("start"),
                           T.StructField("bytes", T.BinaryType()), T.StructField("lead", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            ids, keys, starts, parts, leads = [], [], [], [], []
            for doc_id, text, shared in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
                raw = text.encode()
                if len(raw) < length:
                    continue
                h = seeds(raw, seed)
                at = minimizers(h, length - seed + 1)
                at = at[np.isin(h[at].view(np.int64), np.array(shared, np.int64))]
                start = np.maximum(at - (length - seed), 0)
                ids += [doc_id] * len(at)
                keys.append(h[at].view(np.int64))
                starts.append(start)
                cut = [raw[i:j + length] for i, j in zip(start.tolist(), at.tolist())]
                met: set[tuple[int, bytes]] = set()
                for mark in zip(keys[-1].tolist(), cut):
                    leads.append(mark not in met)
                    met.add(mark)
                parts += cut
            c = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)).view(np.int64)
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*keys, none])), pa.array(c), pa.array(ids, b.schema.field(0).type),
                pa.array(np.concatenate([*starts, none])), pa.array(parts, pa.binary()),
                pa.array(leads, pa.bool_())], names=schema.names)

    return texts.select("doc_id", "text", "shared").mapInArrow(run, schema)


class RunIndex:
    """Run-compressed BWT of texts in suffix order to a fixed depth of 8 bytes or more.

    ``head`` and ``last`` are the sampled suffixes at the ends of each run, in
    positions of the joined text; ``prefix`` numbers the prefix of ``depth``
    bytes that a run's suffixes share.
    """

    def __init__(self, parts: list[bytes], depth: int):
        joined = b"".join(parts) + bytes(depth + 7)
        text = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        offset = np.cumsum(sizes) - sizes
        self.part = np.repeat(np.arange(len(parts)), np.maximum(sizes - depth + 1, 0))
        first = np.cumsum(np.maximum(sizes - depth + 1, 0)) - np.maximum(sizes - depth + 1, 0)
        self.place = np.arange(len(self.part)) - first[self.part]
        self.start = offset[self.part] + self.place  # suffixes that hold ``depth`` bytes of their text
        packed = eights(joined, ">u8")  # numbers in the order of their bytes
        rank, k = np.unique(packed, return_inverse=True)[1].astype(np.uint64), 8
        bits = np.uint64(int(rank.max(initial=0)).bit_length() or 1)
        while 3 * k < depth and 3 * bits <= 64:  # three ranks fit one word: triple the depth
            wide = (rank[:-2 * k] << bits | rank[k:-k]) << bits | rank[2 * k:]
            rank = np.append(np.unique(wide, return_inverse=True)[1].astype(np.uint64), np.zeros(2 * k, np.uint64))
            k, bits = 3 * k, np.uint64(int(rank.max(initial=0)).bit_length() or 1)
        while 2 * k < depth:
            wide = rank[:-k] << np.uint64(32) | rank[k:]
            rank, k = np.append(np.unique(wide, return_inverse=True)[1].astype(np.uint64), np.zeros(k, np.uint64)), 2 * k
        order = rank[self.start] << np.uint64(32) | rank[self.start + depth - k]
        sa = np.argsort(order, kind="stable")
        before = np.where(self.place > 0, text[np.maximum(self.start - 1, 0)], 0)[sa]
        new = np.ones(len(sa), bool)
        new[1:] = order[sa][1:] != order[sa][:-1]
        turn = new.copy()
        turn[1:] |= before[1:] != before[:-1]
        at = np.flatnonzero(turn)
        self.head, self.last = sa[at], sa[np.append(at[1:], len(sa)) - 1] if len(sa) else sa
        self.prefix = np.cumsum(new)[at] - 1
        self.run = np.empty(len(sa), np.int64)
        self.run[sa] = np.cumsum(turn) - 1

    def earliest(self, owner: np.ndarray) -> np.ndarray:
        """For every suffix the smallest owner of a text with the same prefix.

        ``owner`` rises with the texts, so the head of a run has the run's smallest."""
        if not len(self.run):
            return self.run
        least = np.full(int(self.prefix[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.prefix, owner[self.part[self.head]])
        return least[self.prefix[self.run]]


def matched(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Stretches of each context that texts of earlier documents hold."""
    rows = rows.drop_duplicates(["h", "c"]).sort_values(["doc_id", "h", "c"], kind="stable").reset_index(drop=True)
    owner = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)[1]
    index = RunIndex(rows["bytes"].tolist(), depth)
    hit = np.flatnonzero(index.earliest(owner) < owner[index.part])
    part, place = index.part[hit], index.place[hit]
    begins = np.ones(len(hit), bool)
    begins[1:] = (part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(begins)
    stops = place[np.append(at[1:], len(hit)) - 1] + depth if len(at) else place
    spans = pd.DataFrame({"part": part[at], "span": list(zip(place[at].tolist(), stops.tolist()))})
    lists = spans.groupby("part")["span"].agg(list)
    out = rows.loc[lists.index, ["h", "c"]]
    return out.assign(spans=[[{"a": a, "b": b} for a, b in x] for x in lists])


def crowded_windows(asked: DataFrame, depth: int) -> DataFrame:
    """(h, c, spans) of contexts that smaller documents hold in part, by the windows of ``depth`` bytes they are made of.

    A window that very many contexts hold is one row per task after the map-side
    minimum; the join back streams, and AQE splits it where it is skewed."""
    place = F.explode(F.sequence(F.lit(0), F.length("bytes") - depth))
    window = F.substring("bytes", F.col("place") + 1, F.lit(depth))
    held = asked.select("h", "c", "doc_id", "bytes", place.alias("place")).select(
        F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"), "h", "c", "doc_id", "place")
    low = held.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    hits = held.join(low.drop("high"), ["w1", "w2"]).filter("doc_id > low")
    places = hits.groupBy("h", "c").agg(F.array_sort(F.collect_set("place")).alias("p"))
    begins = F.filter("p", lambda i: ~F.array_contains("p", i - 1))
    stops = F.filter("p", lambda i: ~F.array_contains("p", i + 1))
    return places.select("h", "c", F.zip_with(begins, stops, lambda a, b: F.struct(
        a.cast("long").alias("a"), (b + depth).cast("long").alias("b"))).alias("spans"))


def shared_contexts(contexts: DataFrame, depth: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(h, c, first) of every distinct context, and (h, c, spans) of those that
    smaller documents hold in part."""
    per = contexts.groupBy("h", "c").agg(F.min("doc_id").alias("first"))
    classes = stored(per, "classes")
    sizes = stored(classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    fits = F.col("n") <= rows
    total, crowded = sizes.agg(F.sum(F.when(fits, F.col("n"))), F.count(F.when(~fits, 1))).head()
    buckets = max(1, -(-(total or 0) // rows))

    def asked(some: DataFrame) -> DataFrame:
        """The bytes of one occurrence of each context that has others beside it."""
        open_ = classes.join(some.select("h"), "h").select("h", "c", F.col("first").alias("doc_id"))
        lead = contexts.filter("lead").select("h", "c", "doc_id", "bytes")
        return lead.join(open_, ["h", "c", "doc_id"]).filter(F.length("bytes") >= depth)

    schema = "h long, c long, spans array<struct<a:long,b:long>>"
    found = asked(sizes.filter(fits)).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")).groupBy(
        "bucket").applyInPandas(lambda g: matched(g, depth)[["h", "c", "spans"]], schema)
    if crowded:
        found = found.unionByName(crowded_windows(stored(asked(sizes.filter(~fits)), "crowded"), depth))
    return classes, found


def cut_out(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept) with the spans of each text removed; kept is what is left, as bytes."""
    schema = T.StructType([texts.schema["doc_id"], long_field("n_removed"), long_field("n_spans"),
                           T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text, pairs in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()):
                raw, left, at, n = text.encode(), [], 0, 0
                for s in sorted(pairs, key=lambda s: (s["a"], s["b"])):
                    if s["a"] > at or n == 0:
                        left.append(raw[at:s["a"]])
                        n += 1
                    at = max(at, s["b"])
                left.append(raw[at:])
                kept = b"".join(left)
                rows.append((doc_id, len(raw) - len(kept), n, kept))
            cols = list(zip(*rows)) or [()] * 4
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return texts.select("doc_id", "text").join(spans, "doc_id").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 50, seed: int = 20, rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): one narrow row per row of ``docs`` (doc_id, n_bytes, sha, first), where
    ``first`` is the smallest id with an equal text, and (doc_id, n_removed, n_spans, kept) of the
    texts that lose bytes to other texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = stored(docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    first = narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    narrow = stored(narrow.join(first, ["k1", "k2"]).select("doc_id", "n_bytes", "sha", "first"), "copies")
    near = Window.partitionBy("h").orderBy("doc_id")
    # what two emitted documents share; copies met in different tasks are told apart right after
    met = anchors_of(docs, length, seed).select("h", "doc_id", F.lag("doc_id").over(near).alias("p"), F.lead(
        "doc_id").over(near).alias("q")).filter("p is not null or q is not null").select("h", "doc_id")
    home = narrow.filter("doc_id is not null").select("doc_id", "first").dropDuplicates(["doc_id"])
    owned = stored(met.join(home, "doc_id").select("h", F.col("first").alias("doc_id")).distinct(), "anchors")
    both = owned.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    shared = owned.join(both.select("h"), "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("shared"))
    texts = docs.select("doc_id", text.alias("text"))
    contexts = stored(contexts_of(texts.join(shared, "doc_id"), length, seed), "contexts")
    discard(owned)
    classes, found = shared_contexts(contexts, length, rows)
    found = stored(found, "found")
    placed = contexts.select("h", "c", "doc_id", "start", F.length("bytes").cast("long").alias("size")).filter(
        F.col("size") >= length).join(classes, ["h", "c"]).join(found, ["h", "c"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")))
    spans = placed.select("doc_id", "start", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(
        F.col("spans"))).alias("s")).select("doc_id", F.struct((F.col("start") + F.col("s.a")).alias("a"), (
            F.col("start") + F.col("s.b")).alias("b")).alias("s"))
    spans = stored(spans.groupBy("doc_id").agg(F.collect_set("s").alias("spans")), "spans")
    discard(contexts, classes)
    return narrow, cut_out(texts, spans)


def repeated_passages(docs: DataFrame, length: int = 50, seed: int = 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Of the UTF-8 bytes of a text those are removed that a string of ``length``
    bytes covers which also starts in a document with a smaller doc_id.  Matches
    are judged on the input and stay inside documents.

    A null text is an empty one; texts shorter than ``length`` lose nothing.
    Rows with one doc_id take nothing from each other.  A row without doc_id
    goes wholly if a named document has its text, and takes no other part.  An
    empty table gives no rows; columns besides doc_id and text are not read.
    """
    narrow, cut = remove_repeats(docs, length, seed)
    cut = stored(cut.select(F.col("doc_id").alias("id"), "n_removed", "n_spans", F.sha2("kept", 256).alias("left")), "cut").dropDuplicates(["id"])
    copy = F.expr(f"n_bytes >= {length} and first is not null and (doc_id is null or doc_id > first)")
    part = narrow.join(cut, F.col("doc_id") == F.col("id"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return part.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))
