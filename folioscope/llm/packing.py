"""Harmonic packing of tokenised documents into sequences of one length.

A piece of n tokens belongs to class k = capacity // n: k such pieces fit one
sequence whatever their exact lengths are (capacity / (k + 1) < n <= capacity /
k).  Every worker fills the bins of every class on its own, k pieces to a bin,
so no worker needs to know another.  Documents may be cut, so a rest that would
waste more than ``slack`` of its slot gives up one piece that exactly fills the
slot of the next class, until the rest fits a slot well.

What a worker cannot complete is less than one bin per class.  Those pieces
meet once more: numbered through per class over all workers (from a table of
counts, not a sort of the pieces) they fill k to a bin again, and the last bin
of each class - at most capacity * (1/1 + 1/2 + ...) pieces of capacity * 128
tokens however large the input - is closed first-fit by falling length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import long_field, slices, stored, texts_of
from .bpe import cache

#: Bits of a sequence id below the number of its worker or class.
SHIFT = 40


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        slot = capacity // k
        take = n if slot - n <= slack * slot else capacity // (k + 1)
        out.append(take)
        n -= take
    return out


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, slack: float, with_ids: bool) -> DataFrame:
    """Pieces of all documents; bin is -1 for those of bins this worker leaves open."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tail = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([src.schema["doc_id"]] + [long_field(n) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "bin", "place", "offset")] + tail)
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worker = cache(path), TaskContext.get().partitionId()
        bins: dict[int, int] = {}
        held: dict[int, list] = {}

        def table(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(cols, types)], names=schema.names)

        types = None
        for b in slices(batches):
            types = types or [b.schema.field(0).type] + [pa.int64()] * 9 + [pa.binary()] * with_ids
            texts, ready = texts_of(b.column(1)), []
            for doc_id, chunks in zip(b.column(0).to_pylist(), known.chunked(texts)):
                ids = b"".join(map(known.__getitem__, chunks)) + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity, slack):
                    k = capacity // length
                    part = ids[4 * start:4 * (start + length)]
                    open_bin = held.setdefault(k, [])
                    offset = open_bin[-1][9] + open_bin[-1][2] if open_bin else 0
                    open_bin.append([doc_id, start, length, zlib.crc32(part), n, k, worker, -1, len(open_bin), offset]
                                    + [part] * with_ids)
                    start += length
                    if len(open_bin) == k:
                        number = bins[k] = bins.get(k, -1) + 1
                        for row in open_bin:
                            row[7] = number
                        ready += open_bin
                        held[k] = []
            yield table(ready)
        rest = [row for rows in held.values() for row in rows]
        if rest:
            yield table(rest)

    return src.mapInArrow(run, schema)


def first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Close the last bins: longest piece first, into the first bin with room."""
    rows = rows.sort_values(["length", "doc_id", "start", "worker", "place"], ascending=[False, True, True, True, True])
    room = np.empty(0, np.int64)
    bins, offsets = [], []
    for n in rows["length"]:
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            room = np.append(room, capacity)
            fits = [len(room) - 1]
        bins.append(fits[0])
        offsets.append(capacity - room[fits[0]])
        room[fits[0]] -= n
    return rows.assign(sequence_id=(1 << 62) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, slack: float = 1 / 64,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row per piece.

    ``ids`` (little-endian 32-bit) come along on demand.  Every row of ``docs``
    is packed whole: its ids, then ``end_id``.  A null or empty text is the end
    id alone; repeated rows are packed as often as they come; an empty table
    gives no rows; columns besides doc_id and text are not read.  Within a
    sequence offsets are gapless from 0, the padding is at its end.
    """
    pieces = stored(_pieces(docs, path, capacity, end_id, slack, with_ids), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    # class k of a worker: bins are numbered apart from those of other classes
    closed = pieces.filter("bin >= 0").withColumn("sequence_id", F.expr(
        f"shiftleft(worker, {SHIFT}) + bin * {capacity} + class - 1"))
    left = pieces.filter("bin < 0")
    counts = left.groupBy("class", "worker").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy("worker")
    before = counts.select("class", "worker", (F.sum("n").over(w) - F.col("n")).alias("before"),
                           F.sum("n").over(Window.partitionBy("class")).alias("all"))
    left = left.join(before, ["class", "worker"]).withColumn("rank", F.expr("before + place")).withColumn(
        "bin", F.expr("rank div class"))
    full = F.expr("(bin + 1) * class <= all")
    inside = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    joined = left.filter(full).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).withColumn(
        "sequence_id", F.expr(f"(1L << 61) + shiftleft(class, {SHIFT}) + bin"))
    last = left.filter(~full).select(*pieces.columns, F.lit(0).alias("one"))
    schema = T.StructType([f for f in last.schema.fields if f.name != "one"] + [long_field("sequence_id")])
    last = last.groupBy("one").applyInPandas(lambda rows: first_fit(rows, capacity).drop(columns="one"), schema)
    return closed.select(*names).unionByName(joined.select(*names)).unionByName(last.select(*names))
