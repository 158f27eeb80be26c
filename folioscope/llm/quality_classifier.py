"""Quality as a regularised quadratic discriminant over document statistics.

One pass over the texts makes a short vector of transformed counts per
document.  Per class, the means and covariances are sums of all labelled
training rows, shrunk towards the pooled covariance and its diagonal; a score
is the logistic of the difference of the two log densities, each a Mahalanobis
distance under a Cholesky factor that is computed once and sent with the task.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, stored

FEATURES = ("words", "word length", "spread of word lengths", "distinct words", "top word", "neighbours alike", "letters",
            "digits", "symbols", "punctuation", "line ends", "upper case", "not ASCII", "repeated lines", "byte entropy")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = raw.split(b"\n")
    counts = Counter(words)
    shares = by[by > 0] / max(size, 1)

    def rate(part: float, whole: float) -> float:
        return float(np.log((part + 1.0) / (whole + 2.0)))

    symbols, marks = by[list(b"#*$%&|<>@^_=~{}[]\\/")].sum(), by[list(b".,;:!?")].sum()
    return [
        float(np.log1p(n)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        rate(len(counts), n), rate(max(counts.values(), default=0), n),
        rate(sum(map(operator.eq, words, words[1:])), n),
        rate(by[65:91].sum() + by[97:123].sum() + by[128:].sum(), size), rate(by[48:58].sum(), size),
        rate(symbols, size), rate(marks, size), rate(by[10], size), rate(by[65:91].sum(), size),
        rate(by[128:].sum(), size), rate(len(lines) - len(set(lines)), len(lines)), float(-(shares * np.log2(shares)).sum())]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text; a null text is an empty one."""
    def run(texts: list[str], _) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]
    return map_texts(docs, ["doc_id"], run, [T.StructField("x", T.ArrayType(T.DoubleType()))])


def remainder(doc_id: str, mod: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


class Discriminant:
    """Two Gaussians with shrunk covariances.  ``one_sided`` holds a constant
    score where the training rows lack a class."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooling: float, ridge: float):
        d = len(FEATURES)
        n = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
        self.one_sided = None if min(n.values()) else (n[1] + 1.0) / (n[0] + n[1] + 2.0)
        if self.one_sided is not None:
            return
        mean = {c: s / k for c, (k, s, _) in moments.items()}
        scatter = {c: q - k * np.outer(mean[c], mean[c]) for c, (k, _, q) in moments.items()}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
        self.mean, self.inverse, self.log_weight = mean, {}, {}
        for c in (0, 1):
            a = max(pooling, d / (n[c] + d))
            cov = (1 - a) * scatter[c] / n[c] + a * pooled
            factor = np.linalg.cholesky((1 - ridge) * cov + ridge * diagonal)
            self.inverse[c] = np.linalg.inv(factor)
            self.log_weight[c] = np.log(n[c]) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.one_sided is not None:
            return np.full(len(x), self.one_sided)
        log = [self.log_weight[c] - ((x - self.mean[c]) @ self.inverse[c].T).__pow__(2).sum(1) / 2 for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(seen: DataFrame, labels: DataFrame, fold: int, mod: int, pooling: float, ridge: float) -> Discriminant:
    """Class moments of all labelled training rows, summed where the rows lie."""
    d = len(FEATURES)
    known = labels.filter(remainder("doc_id", mod) != fold).filter("quality in (0, 1)").select(
        "doc_id", F.col("quality").cast("int").alias("c"))
    rows = seen.join(known, "doc_id").select("c", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    moments = {}
    for r in rows.groupBy("c").agg(*sums).collect():
        q = np.array([[r[f"q{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r["c"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), q)
    return Discriminant(moments, pooling, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 1, mod: int = 3, pooling: float = 0.05,
                   ridge: float = 0.02) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``labels`` has (doc_id, quality); its rows with crc32(doc_id as text) mod
    ``mod`` equal to ``fold`` are held out of the fit, null labels and others
    than 0 and 1 are no labels.  ``pooling`` and ``ridge`` are the least weights
    of the pooled covariance and of its diagonal.

    Null and empty texts are scored like any other; without training rows of
    both classes every score is one smoothed share (0.5 without any).  Repeated
    rows are scored alike and train as often as they come; a null id is never
    held out; an empty table gives no rows; other columns are not read.
    """
    seen = stored(features(docs), "features")
    model = fit(seen, labels, fold, mod, pooling, ridge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                score = model.score(np.stack(b["x"].to_numpy()))
                yield b.drop(columns="x").assign(score=score, predicted=(score >= 0.5).astype("int32"))

    out = seen.select("doc_id", F.coalesce(remainder("doc_id", mod) == fold, F.lit(False)).alias("held_out"), "x")
    schema = T.StructType([f for f in out.schema.fields if f.name != "x"] + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return out.mapInPandas(run, schema)
