"""Prefix trie of conversations by van Emde Boas recursion.

A range of depths is cut at half: the part of every sequence above the cut gets
a name, sequences of one name go on together below it.  The upper trie and the
lower forests are then independent of each other, whatever their depth, so all
ranges of one size are worked on in one pass, and a trie of depth D takes log2 D
passes, not D.

*Names.*  The name of a block of 2**j turns is made from the names of its
halves; the name of a prefix from the name at the cut above it and the blocks in
between.  A sequence is kept as chunks of ``chunk`` turns, so that no row grows
with a conversation; inside a chunk the recursion is arithmetic on arrays,
between chunks it is one join for each halving, over the chunks alone.

*Totals.*  Every lower forest has its totals before the range around it is
closed.  They are then grafted upward: the total of each lower root, met at depth
odd * 2**j, is added to the 2**j nodes of the upper trie it hangs from, which its
smallest member names.  Over a level that is at most one row for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import numbered

from .batches import stored
from .mixing import word_count

#: Rows of one conversation that meet the row of its rebuilding in one group.
SPAN = 4096
#: Bytes of ids that travel as one row on their way into a digest.
RUN = 1 << 16

C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


# -- sequences ---------------------------------------------------------------------------------

def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, words): turns numbered from 1 in the order of ``turn``, null first.

    (k1, k2) stands for (role, text).  Turns of one number follow each other in
    the order of k1, k2.  Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    keyed = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("k1"), F.xxhash64(F.lit(2), role, text).alias("k2"),
        word_count("text").alias("words"))
    return numbered(keyed, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("k1"), F.asc("k2")], "pos").drop("turn")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Sequences that share openings: (conv_id, depth) and (conv_id, depth, t, k1, k2, words).

    Conversation c starts with the first h = crc32(c) % heads turns of
    conversation c - c % group, followed by its own turns after the first h; t
    counts from 1, depth is the length of the whole.
    """
    own = stored(ordered_turns(turns), "turns")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    taken = F.least("h", F.coalesce("bn", F.lit(0)))
    ids = ids.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("bn")), "base", "left").select(
        "conv_id", "base", "n", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    ids = stored(ids, "sequences")
    opening = own.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    first = ids.join(opening, "base").filter("pos <= h").select("conv_id", "depth", F.col("pos").alias("t"), "k1", "k2", "words")
    # a conversation of any length meets its row in groups of SPAN turns
    parts = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n div {SPAN} as int)")))).drop("base", "n")
    rest = own.withColumn("part", F.expr(f"cast(pos div {SPAN} as int)")).join(parts, ["conv_id", "part"]).filter("pos > h").select(
        "conv_id", "depth", (F.col("pos") - F.col("h") + F.col("m")).alias("t"), "k1", "k2", "words")
    return ids.select("conv_id", "depth"), first.unionByName(rest)


# -- names -------------------------------------------------------------------------------------

def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit names (..., 2) from those of a part and what follows it."""
    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def stir(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * C[4]
        x = (x ^ (x >> np.uint64(29))) * C[3]
        return x ^ (x >> np.uint64(32))
    with np.errstate(over="ignore"):
        u = a[..., 0] * C[0] + turn(b[..., 0], 31) * C[1] + C[2]
        v = a[..., 1] * C[2] + turn(b[..., 1], 29) * C[3] + C[0]
        u = stir(u + turn(v, 17))
        v = stir(v + u * C[1])
    return np.stack([u, v], axis=-1)


def prefix_names(start: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Names of all prefixes of the rows of ``keys`` (rows, width, 2), each begun at ``start`` (rows, 2).

    width is a power of two; a name depends on nothing to the right of its prefix.
    """
    blocks = [keys]  # blocks[j]: names of blocks of 2**j
    while blocks[-1].shape[1] > 1:
        blocks.append(_mixed(blocks[-1][:, 0::2], blocks[-1][:, 1::2]))
    at = np.arange(keys.shape[1])
    above = np.repeat(start[:, None, :], len(at), axis=1)
    for j in range(len(blocks) - 2, -1, -1):  # from the widest cut down: who is below it takes the name of what lies above
        below = np.flatnonzero(at >> j & 1)
        above[:, below] = _mixed(above[:, below], blocks[j][:, (at[below] >> j) - 1])
    return _mixed(above, keys)


def _names(sx: Column, sy: Column, k1: Column, k2: Column) -> Column:
    """array<struct<x, y>>: the name of every prefix of a chunk."""
    @F.arrow_udf("array<struct<x: long, y: long>>")
    def run(sx: pa.Array, sy: pa.Array, k1: pa.Array, k2: pa.Array) -> pa.Array:
        n = k1.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(n) - n
        flat = np.stack([k.flatten().to_numpy(zero_copy_only=False) for k in (k1, k2)], axis=-1).astype(np.int64).view(np.uint64)
        start = np.stack([s.to_numpy(zero_copy_only=False) for s in (sx, sy)], axis=-1).astype(np.int64).view(np.uint64)
        out = np.empty_like(flat)
        width = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            cells = begin[rows, None] + np.minimum(np.arange(w), n[rows, None] - 1)  # past the end the last turn again
            found = prefix_names(start[rows], flat[cells])
            keep = np.arange(w) < n[rows, None]
            out[cells[keep]] = found[keep]
        x, y = np.ascontiguousarray(out.T).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()),
                                        pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    return run(sx, sy, k1, k2)


def _joined(*columns: str) -> list[Column]:
    """Names of two parts put together, between chunks."""
    return [F.xxhash64(F.lit(seed), *columns).alias(out) for seed, out in ((1, "x"), (2, "y"))]


def _chunk_starts(chunks: DataFrame, chunk: int, last: int) -> DataFrame:
    """(conv_id, q, x, y): the name of everything above chunk q >= 1, for every q a full chunk ends at.

    Blocks of chunks are named pairwise upward; then each start takes, from the
    widest cut down, the name of the block above the cut.
    """
    full = chunks.filter(F.size("k1") == chunk)
    blocks = [stored(full.select("conv_id", "q", *_joined("k1", "k2")), "blocks")]
    while 2 ** len(blocks) <= last + 1:
        odd = F.col("q") % 2 == 1
        pair = blocks[-1].groupBy("conv_id", F.expr("q div 2").alias("q")).agg(F.count("*").alias("n"), *[
            F.max(F.when(o, F.col(c))).alias(f"{c}{i}") for i, o in enumerate((~odd, odd)) for c in ("x", "y")])
        blocks.append(stored(pair.filter("n = 2").select("conv_id", "q", *_joined("x0", "y0", "x1", "y1")), "blocks"))
    starts = full.select("conv_id", (F.col("q") + 1).alias("q"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    for j in range(len(blocks) - 1, -1, -1):
        below = F.expr(f"shiftright(q, {j}) % 2 = 1")
        above = blocks[j].select("conv_id", F.col("q").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        met = starts.filter(below).withColumn("b", F.expr(f"shiftright(q, {j}) - 1")).join(above, ["conv_id", "b"])
        starts = stored(met.select("conv_id", "q", *_joined("x", "y", "bx", "by")).unionByName(starts.filter(~below)), "starts")
    return starts


def named_chunks(ids: DataFrame, turns: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """(conv_id, depth, q, sx, sy, names, words) of every chunk of every sequence, and the greatest depth.

    The root, at depth 0, is the first turn of all sequences; (sx, sy) names what
    lies above a chunk, and the last name of a full chunk is that of the next start.
    """
    root = ids.select("conv_id", "depth", F.lit(0).cast("long").alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "words")])
    rows = turns.select("conv_id", "depth", F.col("t").cast("long").alias("t"), "k1", "k2", F.col("words").cast("long").alias("words")).unionByName(root)
    chunks = rows.groupBy("conv_id", F.expr(f"cast(t div {chunk} as int)").alias("q")).agg(
        F.max("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("t", "k1", "k2", "words"))).alias("all"))
    chunks = stored(chunks.select("conv_id", "q", "depth", F.col("all.k1").alias("k1"), F.col("all.k2").alias("k2"),
                                  F.col("all.words").alias("words")), "chunks")
    deepest = ids.agg(F.max("depth")).first()[0] or 0
    zero = F.lit(0).cast("long")
    lone = chunks.withColumns({"sx": zero, "sy": zero, "ex": F.lit(None).cast("long"), "ey": F.lit(None).cast("long")})
    if deepest + 1 >= chunk:
        starts = _chunk_starts(chunks, chunk, deepest // chunk)
        ends = starts.select("conv_id", (F.col("q") - 1).alias("q"), F.col("x").alias("ex"), F.col("y").alias("ey"))
        starts = starts.withColumnsRenamed({"x": "sx", "y": "sy"})
        far = chunks.filter((F.col("q") > 0) | (F.size("k1") == chunk)).join(starts, ["conv_id", "q"], "left").join(
            ends, ["conv_id", "q"], "left").withColumns({"sx": F.coalesce("sx", zero), "sy": F.coalesce("sy", zero)})
        lone = lone.filter((F.col("q") == 0) & (F.size("k1") < chunk)).unionByName(far)
    d = lone.withColumn("names", _names(F.col("sx"), F.col("sy"), F.col("k1"), F.col("k2")))
    d = d.withColumn("names", F.when(F.col("ex").isNull(), F.col("names")).otherwise(F.concat(
        F.slice("names", 1, F.size("names") - 1), F.array(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))))))
    return stored(d.select("conv_id", "depth", "q", "sx", "sy", "names", "words"), "names"), deepest


# -- totals ------------------------------------------------------------------------------------

def _nodes(chunks: DataFrame, chunk: int) -> DataFrame:
    """(x, y, px, py, conv_id, depth, n_convs, n_children, leaves, saved): nodes with their own share of the totals."""
    above = F.concat(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))), F.slice("names", 1, F.size("names") - 1))
    turns = chunks.select("conv_id", "q", F.posexplode(F.arrays_zip(F.col("names").alias("n"), above.alias("p"), F.col("words").alias("w"))))
    turns = turns.select("conv_id", (F.col("q") * chunk + F.col("pos")).alias("t"), "col.n.x", "col.n.y",
                         F.col("col.p.x").alias("px"), F.col("col.p.y").alias("py"), F.col("col.w").alias("w"))
    nodes = stored(turns.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.min("t").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.min("w").alias("w"), F.count("*").alias("n_convs")), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    count = F.coalesce("n_children", F.lit(0))
    return stored(nodes.join(kids, ["x", "y"], "left").select(
        "x", "y", "px", "py", "conv_id", "depth", "n_convs", count.alias("n_children"), (count == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("w")).alias("saved")), "nodes")


def _grafts(nodes: DataFrame, chunks: DataFrame, chunk: int, deepest: int) -> list[DataFrame]:
    """(x, y, depth, leaves, saved, again): for each halving what lower roots add to the nodes above them."""
    grafts: list[DataFrame] = []
    paths = chunks.select("conv_id", "q", "names")
    half = 1
    while half <= deepest:
        roots = nodes.filter(F.col("depth") % (2 * half) == half).select("x", "y", "conv_id", "depth", "leaves", "saved")
        for g in grafts:  # what deeper forests have added to these roots
            more = g.filter(F.col("again") & (F.col("depth") % (2 * half) == half))
            roots = roots.unionByName(more.select("x", "y", F.lit(None).cast("long").alias("conv_id"), "depth", "leaves", "saved"))
        if grafts:
            roots = roots.groupBy("x", "y").agg(F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
                                                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        top = F.col("depth") - half
        parts = roots.select("conv_id", "depth", "leaves", "saved", F.explode(F.sequence(
            F.expr(f"cast((depth - {half}) div {chunk} as int)"), F.expr(f"cast((depth - 1) div {chunk} as int)"))).alias("q"))
        parts = parts.groupBy("conv_id", "q").agg(F.collect_list(F.struct(
            F.greatest(top, F.col("q") * chunk).alias("from"), F.least("depth", (F.col("q") + 1) * chunk).alias("to"),
            "leaves", "saved")).alias("roots"))  # at most chunk / (2 * half) of them, or one
        up = parts.join(paths, ["conv_id", "q"]).select(F.inline(F.flatten(F.transform("roots", lambda r: F.transform(
            F.slice("names", (r["from"] - F.col("q") * chunk + 1).cast("int"), (r["to"] - r["from"]).cast("int")),
            lambda v, i: F.struct(v["x"].alias("x"), v["y"].alias("y"), (r["from"] + i).alias("depth"),
                                  r["leaves"].alias("leaves"), r["saved"].alias("saved")))))))
        up = up.groupBy("x", "y").agg(F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        grafts.append(stored(up.withColumn("again", F.col("depth") % (2 * half) == 0), "grafts", by=["again"]))
        half *= 2
    return grafts


def _digests(ends: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of ``ends(x, y, conv_id)``: ids in ascending order, comma-joined.

    A digest is made in order, so the ids of one node pass through one task; as
    runs of up to RUN bytes made wherever the sorted ids lie, they are few rows,
    and only the state of one digest is held.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for x, y, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (x, y) != node or size >= RUN:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (x, y), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("x", "y", "first", "ids"), r)) for r in out], kinds)
            out = []
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(("x", "y", "first", "ids"), (*node, first, ",".join(ids))))], kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            out = []
            for x, y, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (x, y) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("x", "y", "ends_sha256"), r)) for r in out], done)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(("x", "y", "ends_sha256"), (*node, state.hexdigest())))], done)

    kinds = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    done = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    order = ["x", "y", "conv_id"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        runs, "x long, y long, first long, ids string")
    return parts.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(digest, "x long, y long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame, chunk: int = 256) -> DataFrame:
    """The trie of the sequences ``ids(conv_id, depth)`` with ``turns(conv_id, depth, t, k1, k2, words)``, t from 1.

    One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).  A node is a distinct sequence of first
    turns; conv_id is its smallest member, n_convs counts its members, n_leaves
    the childless nodes at and below it, saved_tokens the words of a turn times
    the members that share it beyond the first, over it and all below it.
    Copies of a conversation share all their nodes and each counts as a member;
    an empty table has no members and gives no rows.  ``chunk`` is a power of two.
    """
    chunks, deepest = named_chunks(ids, turns, chunk)
    nodes = _nodes(chunks, chunk)
    totals = [g.select("x", "y", "leaves", "saved") for g in _grafts(nodes, chunks, chunk, deepest)]
    more = totals[0] if totals else nodes.select("x", "y", "leaves", "saved").limit(0)
    for g in totals[1:]:
        more = more.unionByName(g)
    more = more.groupBy("x", "y").agg(F.sum("leaves").alias("ml"), F.sum("saved").alias("ms"))
    ends = chunks.filter(f"q = depth div {chunk}").select("conv_id", F.element_at("names", -1).alias("n")).select("n.x", "n.y", "conv_id")
    d = nodes.join(more, ["x", "y"], "left").join(_digests(ends), ["x", "y"], "left")
    d = d.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("px")).alias("px"), F.when(F.col("depth") > 0, F.col("py")).alias("py"),
                 "n_convs", "n_children", (F.col("leaves") + F.coalesce("ml", F.lit(0))).alias("n_leaves"),
                 (F.col("saved") + F.coalesce("ms", F.lit(0))).alias("saved_tokens"),
                 F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    inner = nodes.filter("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    return d.join(inner, ["px", "py"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, group: int = 20, heads: int = 4, chunk: int = 256) -> DataFrame:
    """The prefix trie of :func:`rebuilt` conversations.

    A null role or text is empty; turns go by their number, null first, turns of
    one number in a fixed order of their content; rows without a conv_id belong to
    no conversation; other columns are not read.
    """
    return prefix_trie(*rebuilt(conversations, group, heads), chunk)


#: DuckDB: nodes as lists of turns, totals over all nodes that begin with them.
ORACLE = r"""WITH c AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([1, 1, 1, 1, 1, 1, 1, 1] AS BIGINT[])), lambda v, o: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h FROM c),
  r AS (SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
  n AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM r),
  v AS (SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256 FROM n GROUP BY ALL),
  k AS (SELECT v.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM v w WHERE w.depth = v.depth + 1 AND w.p[1:v.depth] = v.p) AS n_children,
    (v.n_convs - 1) * CASE WHEN v.depth = 0 THEN 0 ELSE len(regexp_extract_all(v.p[v.depth].t, '[^\x20\x09-\x0D]+')) END AS own
    FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND v.p[1:u.depth] = u.p)
  SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
    CAST(count(*) FILTER (d.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(d.own) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
  FROM k a JOIN k d ON d.depth >= a.depth AND d.p[1:a.depth] = a.p GROUP BY a.p, a.conv_id, a.depth"""
