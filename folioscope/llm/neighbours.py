"""Nearest vectors by multi-index hashing of learned binary codes.

Codes are the signs of principal components under a rotation learned on a
bounded sample (iterative quantisation).  A code is cut into substrings; by the
pigeonhole principle a code within Hamming radius r of a query lies within r
div m of it in at least one of m substrings.  So each substring has an index of
its own, partitioned by leading bits, a query is sent to the partitions its
probes can reach, probes the postings there, keeps every code within r and
reranks those by the exact distance of the original vectors.

The radius is learned too: the Hamming distance that covers ``cover`` of the
true neighbours of sample rows within the sample.  Neighbours in the whole
table are nearer than in a sample of it, so the radius errs on the safe side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import stored


@dataclass
class Codec:
    mean: np.ndarray
    turn: np.ndarray  # principal directions times the learned rotation: one column for each bit
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        on = ((x - self.mean) @ self.turn) > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def learn(x: np.ndarray, bits: int, k: int, cover: float, probes: int, seed: int = 7, rounds: int = 30) -> Codec:
    """Rotation and radius from the sample ``x``."""
    mean = x.mean(0)
    centred = x - mean
    bits = min(bits, x.shape[1])
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    codec = Codec(mean, axes @ turn, bits)
    codes, seen = codec.encode(x), []
    for i in range(min(probes, len(x))):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        seen.append(np.bitwise_count(codes[near] ^ codes[i]))
    if seen and len(seen[0]):
        codec.radius = int(np.quantile(np.concatenate(seen), cover, method="higher"))
    return codec


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors of the most frequent length, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null and exists(v, x -> x <> 0) and "
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return v.filter(F.size("v") == (sizes["d"] if sizes else 0))


def radii(radius: int, m: int) -> list[int]:
    """Radius of each substring so that one of them must hold: their sum plus m - 1 reaches ``radius``."""
    return [radius // m if i <= radius % m else radius // m - 1 for i in range(m)]


def probe(index: pd.DataFrame, queries: pd.DataFrame, table: int, tables: int, width: int, radius: int, k: int) -> pd.DataFrame:
    """The k best rows of one index partition for each of its queries."""
    mask = np.uint64((1 << width) - 1)
    near = radii(radius, tables)

    def part(codes, i: int):
        return codes >> np.uint64(i * width) & mask

    index = index.sort_values("vec_id")
    codes = index["code"].to_numpy().astype(np.uint64)
    keys = part(codes, table)
    order = np.argsort(keys, kind="stable")
    values, first = np.unique(keys[order], return_index=True)
    lengths = np.diff(np.append(first, len(order)))
    ids, x = index["vec_id"].to_numpy(), np.stack(index["v"].to_numpy())
    out = []
    for q_id, q_code, q in zip(queries["vec_id"].to_numpy(), queries["code"].to_numpy().astype(np.uint64), queries["v"]):
        hit = np.bitwise_count(values ^ part(q_code, table)) <= near[table]
        rows = order[np.repeat(hit, lengths)]
        apart = codes[rows] ^ q_code
        good = (np.bitwise_count(apart) <= radius) & (ids[rows] != q_id)
        for earlier in range(table):  # the first substring that reaches a code reports it
            good &= np.bitwise_count(part(apart, earlier)) > max(near[earlier], -1)
        rows = np.sort(rows[good])
        d = np.sqrt(((x[rows] - q) ** 2).sum(1))
        best = np.argsort(d, kind="stable")[:k]
        out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[rows[best]], "score": d[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, queries: DataFrame, codec: Codec, radius: int, k: int, substring: int, block: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each index partition for each query."""
    m = max(1, -(-codec.bits // substring))
    width = -(-codec.bits // m)
    n, n_queries = rows.count(), queries.count()
    lead = max(0, min(width, int(np.ceil(np.log2(max(n, 1) / block)))))  # leading bits that make partitions of about a block
    spread = max(1, -(-n_queries // block))
    near = radii(radius, m)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        sub = F.expr(f"shiftrightunsigned(code, t * {width}) & {(1 << width) - 1 if width < 64 else -1}L")
        # the JVM takes shifts modulo 64: a shift by the whole width of 64 would leave the code as it is
        return df.withColumn("lead", F.shiftrightunsigned(sub, width - lead).cast("int") if lead else F.lit(0))

    index = placed(rows)
    # a partition that many equal leading bits overfill is cut further; every query of it visits all cuts
    sizes = index.groupBy("t", "lead").agg(F.count("*").alias("n")).select(
        F.col("t").alias("t2"), F.col("lead").alias("lead2"), F.ceil(F.col("n") / block).cast("int").alias("cuts"))
    cut = sizes.select("t2", "lead2", "cuts")
    on = (F.col("t") == F.col("t2")) & (F.col("lead") == F.col("lead2"))
    index = index.join(cut, on).withColumn("cut", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    reach = F.element_at(F.array(*[F.lit(r) for r in near]), F.col("t2") + 1)
    asked = placed(queries).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int"))
    asked = asked.join(cut, (F.col("t") == F.col("t2")) & (F.bit_count(F.col("lead").bitwiseXOR(F.col("lead2"))) <= reach)
                       ).withColumn("lead", F.col("lead2")).withColumn(
        "cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    key = ["t", "lead", "cut", "b"]

    def run(group, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return probe(index, queries, int(group[0]), m, width, radius, k)

    fields = [*key, "vec_id", "code", "v"]
    schema = T.StructType([T.StructField("query_id", rows.schema["vec_id"].dataType),
                           T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    return index.select(*fields).groupBy(*key).cogroup(asked.select(*fields).groupBy(*key)).applyInPandas(run, schema)


def nearest_neighbours(vectors: DataFrame, is_query: F.Column | str, k: int = 10, bits: int = 64, sample: int = 20_000,
                       cover: float = 0.975, probes: int = 200, substring: int = 16, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that meets ``is_query``.

    ``sample`` rows, the first by a hash of their id, fit the codes and (on
    ``probes`` of them) the radius; every row is indexed.  ``block`` bounds the
    rows and the queries of one task.  Of equal vectors only the k + 1 smallest
    ids can be among anyone's neighbours, so a vector that fills a third of the
    table is indexed k + 1 times.  A query that finds fewer than k rows within
    the radius is asked again without one.

    Null vectors, zero vectors, vectors with null or non-finite components and
    vectors of another length than most take no part; nor do null ids.  Ties go
    to the smaller id; rows that repeat an id are one row, whichever has the
    lesser components; a table without usable rows gives no rows; other columns
    are not read.
    """
    good = usable(vectors)
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    few = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    schema = T.StructType([T.StructField("query_id", good.schema["vec_id"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("vec_id", good.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    if not len(few):
        return vectors.sparkSession.createDataFrame([], schema)
    codec = learn(np.stack(few["v"].to_numpy()), bits, k, cover, probes)
    coded_schema = T.StructType([*good.schema.fields, T.StructField("code", T.LongType())])

    def encode(batches):
        for b in batches:
            if len(b):
                yield b.assign(code=codec.encode(np.stack(b["v"].to_numpy())).astype(np.int64))

    coded = stored(good.mapInPandas(encode, coded_schema), "codes")
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = coded.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    rows = stored(rows, "index")
    queries = coded.filter(is_query)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(schema.names)

    found = stored(best(search(rows, queries, codec, codec.radius, k, substring, block)), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") == k)
    short = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    if short.isEmpty():
        return found
    again = best(search(rows, short, codec, codec.bits, k, codec.bits, block))
    return found.join(full.select("query_id"), "query_id", "left_semi").select(schema.names).unionByName(again)
