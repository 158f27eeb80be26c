"""Vectors in blocks that a search can skip, without losing a pair.

Vectors are scaled to length one, turned so that most of their energy lies in
the first coordinates, dealt to cells around centres learned from a bounded
sample, and packed into blocks of bounded size, one row each.  Next to its
vectors a block keeps its mean and, for each segment of coordinates (up to 8, up
to 16, up to 32, the rest), the largest energy of what a member adds to that mean.
By Cauchy-Schwarz on every segment no member z is closer to q than

    <q, mean> + sum over segments of |q_s| * radius_s

and the same holds between two blocks with both radii.  A block whose bound is
below what a probe asks for is skipped; what is asked for is a floor or, for a
top-k, the k-th score a probe has found in the block around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a block at 64 coordinates; wider vectors make smaller blocks of the same bytes.
BLOCK = 2048
#: At most this many cells, learned from at most SAMPLE vectors, are held by the driver and the tasks.
CELLS, SAMPLE = 1024, 16_384
#: Borders of the segments whose energy is kept.
EDGES = (8, 16, 32)
#: Slack of the bounds for the rounding of doubles.
EPS = 1e-9

PACKED = ("cell long, block string, n int, ids array<string>, words array<array<string>>, hot array<array<string>>, vecs binary, "
          "mean array<double>, radius array<double>, seen array<string>")


@dataclass(frozen=True)
class Space:
    """What is learned once: a rotation (d, d) and the centres of cells (cells, d) in rotated coordinates."""

    rotation: np.ndarray
    centres: np.ndarray
    bits: int

    @property
    def width(self) -> int:
        return self.rotation.shape[0]


def unit(vecs: pd.Series) -> np.ndarray:
    """Rows of length one; a zero vector stays zero."""
    m = np.array(vecs.tolist(), dtype=np.float64).reshape(len(vecs), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def segments(z: np.ndarray) -> np.ndarray:
    """Lengths (rows, segments) of the segments of rotated rows."""
    borders = [e for e in EDGES if e < z.shape[1]]
    return np.sqrt(np.add.reduceat(z * z, [0, *borders], axis=1))


def block_bound(mean: np.ndarray, radius: np.ndarray, means: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest cosine any two members of a block and of each of many blocks can have."""
    a, b = segments(mean[None]), segments(means)
    return means @ mean + ((a + radius) * (b + radii) - a * b).sum(1)


def row_bound(z: np.ndarray, mean: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Largest cosine each rotated row can have with any member of a block."""
    return z @ mean + segments(z) @ radius


def _far_apart(z: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from all before it."""
    picked, away = [0], np.full(len(z), np.inf)
    while len(picked) < min(n, len(z)):
        away = np.minimum(away, ((z - z[picked[-1]]) ** 2).sum(1))
        picked.append(int(away.argmax()))
    return z[picked].copy()


def learn(members: DataFrame, rows: int, block: int) -> Space:
    """Rotation to principal axes and k-means centres, from a sample in hash order."""
    cells = max(1, min(CELLS, 2 * rows // block))  # smaller than blocks: a block of two clusters is near to both
    picked = members.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 16 * cells + 256)).select("vec").toPandas()  # bounded
    u = unit(picked.vec)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    z = u @ axes
    centres = _far_apart(z, cells)
    for _ in range(4):
        own = (z @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, z)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    bits = max(0, int(np.ceil(np.log2(max(1, rows / (len(centres) * block))))) if rows > CELLS * block else 0)
    return Space(np.ascontiguousarray(axes), centres, bits)


def _placed(df: DataFrame, space: Space) -> DataFrame:
    """Rows with the cell of the nearest centre and, in large tables, the signs of the leading coordinates around it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = unit(b.vec) @ space.rotation
            cell = (z @ space.centres.T - (space.centres ** 2).sum(1) / 2).argmax(1)
            side = (z - space.centres[cell])[:, :space.bits] > 0
            yield b.assign(cell=cell.astype(np.int64), side=(side @ (1 << np.arange(side.shape[1]))).astype(np.int64))
    return df.mapInPandas(run, "id string, vec array<double>, words array<string>, hot array<string>, cell long, side long")


def pack(df: DataFrame, space: Space, block: int) -> DataFrame:
    """One row per block of ``df(id, vec, words, hot)``; written once, as every step of a search reads it."""
    placed = _placed(df, space)
    parts = placed.groupBy("cell", "side").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = placed.join(parts, ["cell", "side"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        u = unit(rows.vec)
        z = u @ space.rotation
        mean = z.mean(0)
        return pd.DataFrame([{
            "cell": key[0], "block": "-".join(map(str, key)), "n": len(rows), "ids": rows.id.tolist(), "words": rows.words.tolist(),
            "hot": rows.hot.tolist(), "vecs": u.tobytes(), "mean": mean, "radius": segments(z - mean).max(0),
            "seen": sorted({w for s in rows.hot for w in s})}])

    return cut_lineage(placed.groupBy("cell", "side", "part").applyInPandas(run, PACKED))


def _cells(summaries: DataFrame) -> pd.DataFrame:
    """One ball for each cell, around the mean of the means of its blocks: at most CELLS rows."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        means, radii = np.stack(rows["mean"]), np.stack(rows.radius)
        mean = means.mean(0)
        return pd.DataFrame([{"cell": key[0], "mean": mean, "radius": (segments(means - mean) + radii).max(0)}])
    return summaries.groupBy("cell").applyInPandas(run, "cell long, mean array<double>, radius array<double>").toPandas()


def visits(probes: DataFrame, members: DataFrame, lift: float) -> DataFrame:
    """(probe, member, probe_rows, member_rows, bound): the pairs of blocks a search has to look into.

    ``probes(block, n, mean, radius, seen, need)`` and ``members(cell, block, n,
    mean, radius, seen)`` are block summaries; need is the least score any probe
    of the block asks for, ``lift`` what common frequent title words can add.
    Cells are tested first, so blocks meet only inside cells that may matter.
    """
    cells = _cells(members.select("cell", "mean", "radius"))
    means, radii, names = np.stack(cells["mean"]), np.stack(cells.radius), cells.cell.to_numpy()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [names[block_bound(np.asarray(m), np.asarray(r), means, radii) + (lift if len(s) else 0.0) + EPS >= need]
                    for m, r, s, need in zip(b["mean"], b.radius, b.seen, b.need)]
            at = np.repeat(np.arange(len(b)), [len(h) for h in hits])
            if not len(at):
                continue
            yield pd.DataFrame({c: b[c].to_numpy(dtype=object)[at] for c in b.columns} | {
                "cell": np.concatenate(hits)})

    side = "block string, n int, mean array<double>, radius array<double>, seen array<string>, need double"
    near_cells = probes.mapInPandas(near, f"{side}, cell long")
    m = members.select("cell", F.col("block").alias("member"), F.col("n").alias("member_rows"), F.col("mean").alias("m_mean"),
                       F.col("radius").alias("m_radius"), F.col("seen").alias("m_seen"))
    both = near_cells.join(m, "cell").withColumn("lift", F.when(F.arrays_overlap("seen", "m_seen"), F.lit(lift)).otherwise(0.0))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            p, q = np.stack(b["mean"]), np.stack(b["m_mean"])
            a, c = segments(p), segments(q)
            bound = (p * q).sum(1) + ((a + np.stack(b.radius)) * (c + np.stack(b.m_radius)) - a * c).sum(1)
            ok = bound + b["lift"].to_numpy() + EPS >= b.need.to_numpy()
            if not ok.any():
                continue
            kept = {"probe": "block", "member": "member", "probe_rows": "n", "member_rows": "member_rows"}
            yield pd.DataFrame({to: b[c].to_numpy(dtype=object)[ok] for to, c in kept.items()} | {"bound": bound[ok]})

    return both.mapInPandas(tested, "probe string, member string, probe_rows int, member_rows int, bound double")


def shared(left: list, right: list) -> np.ndarray:
    """How many words the sets of two lists share, for all pairs."""
    words = {w: i for i, w in enumerate(sorted({w for s in left for w in s} & {w for s in right for w in s}))}
    if not words:
        return np.zeros((len(left), len(right)), dtype=np.float32)

    def marked(side: list) -> np.ndarray:
        m = np.zeros((len(side), len(words)), dtype=np.float32)
        for i, s in enumerate(side):
            m[i, [words[w] for w in s if w in words]] = 1
        return m
    return marked(left) @ marked(right).T


def overlap(left: list, right: list) -> np.ndarray:
    """Shared words over the smaller word set, for all pairs of two lists of word sets."""
    a, b = (np.array([len(s) for s in side], dtype=np.float64) for side in (left, right))
    small = np.minimum(a[:, None], b[None, :])
    return np.divide(shared(left, right).astype(np.float64), small, out=np.zeros((len(left), len(right))), where=small > 0)


def summary(packed: DataFrame, need: Column | None = None) -> DataFrame:
    """Packed blocks without their rows."""
    cols = ["cell", "block", "n", "mean", "radius", "seen"]
    return packed.select(*cols) if need is None else packed.select(*cols[1:], need.alias("need"))
