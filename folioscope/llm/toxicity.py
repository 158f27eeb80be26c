"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its hashed n-grams.  In a bounded sample of labelled
training rows, a first pass counts the texts of each class that hold a bucket;
the log ratio of those counts scales the bucket's feature, and the buckets that
tell the classes apart most clearly are kept.  A logistic regression on the
scaled features follows, and all texts are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, slices, stored, texts_of
from .quality_classifier import remainder

#: Lower case; whatever is neither a letter nor part of a non-ASCII character becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Buckets whose counts a task hands over in one row.
SENT = 1 << 15


@dataclass
class Settings:
    orders: tuple[int, ...] = (3, 4, 5, 6)  # n-gram lengths in bytes
    bits: int = 20                          # buckets: 2 ** bits
    per_class: int = 6000                   # labelled training rows of each class that the fit reads at most
    features: int = 4096                    # buckets kept
    least: int = 3                          # texts a kept bucket stands in
    smoothing: float = 1.0
    penalty: float = 3e-4
    rounds: int = 400
    rate: float = 0.05


def buckets(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a text, one array for each order."""
    raw = np.frombuffer(b" " + text.encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    h = raw
    for k in range(2, max(s.orders) + 1):
        if len(raw) < k:
            return
        h = h[:-1] * np.uint32(0x01000193) + raw[k - 1:]
        if k in s.orders:
            yield (h * np.uint32(0x9E3779B1 + 2 * k)) >> np.uint32(32 - s.bits)


@dataclass
class Model:
    slot: np.ndarray    # bucket -> feature, -1 where dropped
    weight: np.ndarray  # of each feature, its log-count ratio included
    bias: float
    settings: Settings

    def hits(self, text: str) -> np.ndarray:
        found = [x[x >= 0] for x in (self.slot[b] for b in buckets(text, self.settings))]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weight[self.hits(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def training_sample(docs: DataFrame, labels: DataFrame, fold: int, mod: int, s: Settings) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of at most ``per_class`` labelled rows of each class, and the class sizes.

    Rows are taken in the order of a hash of their id, so the choice is the
    same on every run and the id list is small enough to be sent around.
    """
    known = labels.filter(remainder("doc_id", mod) != fold).filter("toxic in (0, 1)").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    ids = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(s.per_class) for c in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * per_class ids
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("toxic", "text")
    return stored(sample, "toxic-sample").repartition(8), sizes


def fit(docs: DataFrame, labels: DataFrame, fold: int, mod: int, s: Settings) -> Model:
    sample, sizes = training_sample(docs, labels, fold, mod, s)
    width = 1 << s.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, width), np.int32), np.zeros(2, np.int64)
        for b in slices(batches):
            for c, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                here = np.zeros(width, bool)
                for h in buckets(text, s):
                    here[h] = True
                seen[c][here] += 1
                texts[c] += 1
        # a few buckets a row: the driver then holds no more of a task's counts at a time
        for at in range(0, width, SENT):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seen[:, at:at + SENT].tobytes()], pa.binary()),
                                              pa.array([texts.tolist() if at == 0 else [0, 0]])], names=["first", "seen", "texts"])

    seen, n = np.zeros((2, width), np.int32), np.zeros(2, np.int64)
    for r in sample.mapInArrow(count, "first int, seen binary, texts array<long>").toLocalIterator():
        part = np.frombuffer(r["seen"], np.int32).reshape(2, -1)
        seen[:, r["first"]:r["first"] + part.shape[1]] += part
        n += np.array(r["texts"])
    slot = np.full(width, -1, np.int16)
    share = (sizes.get(1, 0) + 1.0) / (sum(sizes.values()) + 2.0)
    if not n.all():
        return Model(slot, np.zeros(1), float(np.log(share / (1 - share))), s)
    often = np.flatnonzero(seen.sum(0) >= s.least)
    good, bad = seen[0, often], seen[1, often]
    mean = (good + bad) / n.sum()
    clear = np.abs(bad / n[1] - good / n[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n[0] + 1 / n[1]))
    kept = np.argsort(-clear, kind="stable")[:s.features]
    kept = kept[clear[kept] > 0]
    slot[often[kept]] = np.arange(len(kept))
    p, q = ((part[kept] + s.smoothing) / (seen[c].sum() + s.smoothing * width) for c, part in ((1, bad), (0, good)))
    ratio = np.log(p / q)

    plain = Model(slot, np.zeros(len(kept)), 0.0, s)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array(b.column(0).to_pylist(), pa.int32()),
                pa.array([plain.hits(t).astype(np.int16).tobytes() for t in texts_of(b.column(1))], pa.binary())],
                names=["toxic", "hits"])

    seen = often = good = bad = mean = clear = None  # the fit needs none of them
    rows = ((r["toxic"], bytes(r["hits"])) for r in sample.mapInArrow(hits, "toxic int, hits binary").toLocalIterator())
    weight, bias = logistic(rows, ratio, s)
    # the sample holds the classes in shares of its own
    bias += np.log(sizes[1] / sizes[0]) - np.log(n[1] / n[0])
    return Model(slot, weight * ratio, float(bias), s)


def logistic(rows: Iterable[tuple[int, bytes]], value: np.ndarray, s: Settings, block: int = 500) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by full-batch Adam steps.

    ``rows`` holds (class, features present as 16-bit numbers) and ``value``
    what each feature counts.  Gradients add up over blocks of rows, so the
    driver holds the feature numbers, once, and one block's floats.  The last
    weight is the bias, which carries no penalty.
    """
    width, total, rows = len(value), 0, iter(rows)
    blocks = []
    while some := list(islice(rows, block)):
        part = [np.frombuffer(h, np.int16) for _, h in some]
        blocks.append((np.array([len(h) for h in part]), np.concatenate(part), np.array([c for c, _ in some], np.float64)))
        total += len(some)
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for i in range(1, s.rounds + 1):
        g = np.zeros(width + 1)
        for sizes, col, y in blocks:
            row = np.repeat(np.arange(len(y), dtype=np.int16), sizes)
            v = value[col]
            z = np.bincount(row, v * w[col], len(y)) + w[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
            g[:-1] += np.bincount(col, v * miss[row], width)
            g[-1] += miss.sum()
        g /= total
        g[:-1] += s.penalty * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= s.rate * (first / (1 - 0.9 ** i)) / (np.sqrt(second / (1 - 0.999 ** i)) + 1e-8)
    return w[:-1], float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, fold: int = 0, mod: int = 5, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``labels`` has (doc_id, toxic); its rows with crc32(doc_id as text) mod
    ``mod`` equal to ``fold`` are held out of the fit, null labels and others
    than 0 and 1 are no labels.  The fit reads at most ``settings.per_class``
    rows of each class; every whole text is scored.

    Null and empty texts hold no n-grams and get the bias alone; without
    training rows of both classes every score is one smoothed share.  Repeated
    rows are scored alike; a null id is never held out; an empty table gives no
    rows; other columns are not read.
    """
    model = fit(docs, labels, fold, mod, settings or Settings())

    def score(texts: list[str], _) -> list[pa.Array]:
        got = [model.score(t) for t in texts]
        return [pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())]

    out = map_texts(docs, ["doc_id"], score, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == fold, F.lit(False)).alias("held_out"), "score", "predicted")
