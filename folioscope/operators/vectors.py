"""Cosine search and near-duplicate clusters over stored vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, spread
from . import vector_blocks as B
from .graph import components

# fixed values
ZONE_MERGE, ZONE_FLAG = 0.90, 0.72
TITLE_WEIGHT, TITLE_MIN = 0.3, 0.5
RERANK_POOL, RERANK_CHARS = 30, 400
MUTUAL_TOP, TOP_K = 4, 8

#: rows of a block of 64 coordinates; a pair of blocks is the unit of work
BLOCK = B.BLOCK
#: titles meet at a shared word of at most so many members; a word of more loosens the bounds of blocks
RARE = 256
#: a tile of probes, the unit of work: so many tiles where there are enough blocks, more if a tile had more rows than this
TILES, TILE = 24, 65_536


def title_words(a: Column, b: Column) -> tuple[Column, Column]:
    """How many words two titles share, and the size of the smaller word set."""
    ta, tb = T.token_set(a), T.token_set(b)
    return F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set."""
    shared, small = title_words(a, b)
    return F.when(small > 0, shared / small).otherwise(0.0)


def combined(cos: Column, sim: Column) -> Column:
    return F.least(F.lit(1.0), cos + F.when(sim >= TITLE_MIN, TITLE_WEIGHT * sim).otherwise(0.0))


def zone(score: Column, merge: float = ZONE_MERGE, flag: float = ZONE_FLAG) -> Column:
    return F.when(score >= merge, "merge").when(score >= flag, "flag").otherwise("new")


def cosine(a: Column, b: Column) -> Column:
    """Built-in form for given pairs; zero when a norm is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda acc, v: acc + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


_PAIRS = "id string, other string, cos double, title_sim double, combined double, same boolean"


def _prepare(df: DataFrame, titles: bool) -> DataFrame:
    words = F.array_sort(T.token_set(F.coalesce("title", F.lit("")))) if titles and "title" in df.columns else F.array().cast("array<string>")
    return df.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"), words.alias("words"))


def _ranked(df: DataFrame, counts: DataFrame | None, rare: int) -> DataFrame:
    """``df`` with the frequent words of each title and the rest, rarest first.

    Titles are looked up by their word set, so a title any share of the table has
    meets the counts once.
    """
    none = F.array().cast("array<string>")
    if counts is None:
        return df.withColumns({"hot": none, "rare": none})
    sets = df.select("words").distinct()
    ranked = sets.select("words", F.explode("words").alias("word")).join(counts, "word").groupBy("words").agg(
        F.sort_array(F.collect_list(F.struct("rows", "word"))).alias("ranked"))
    pick = lambda test: F.transform(F.filter("ranked", test), lambda r: r["word"])
    ranked = ranked.select("words", pick(lambda r: r["rows"] > rare).alias("hot"), pick(lambda r: r["rows"] <= rare).alias("rare"))
    return df.join(ranked, "words", "left").select(*df.columns, F.coalesce("hot", none).alias("hot"), F.coalesce("rare", none).alias("rare"))


def _kinds(words: list) -> tuple[list, np.ndarray]:
    """The different word sets of a list, and which of them each row has."""
    at: dict[tuple, int] = {}
    own = np.array([at.setdefault(tuple(w), len(at)) for w in words], dtype=np.int64)
    return list(at), own


def _scores(u: np.ndarray, pw: list, v: np.ndarray, mw: list, titles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine, title similarity and combined score of all rows of two blocks; word sets are compared once."""
    cos = u @ v.T
    if not titles:
        return cos, np.broadcast_to(0.0, cos.shape), np.minimum(1.0, cos)
    (a, own_a), (b, own_b) = _kinds(pw), _kinds(mw)
    sim = B.overlap(a, b)
    lift = np.where(sim >= TITLE_MIN, TITLE_WEIGHT * sim, 0.0)
    pick = np.ix_(own_a, own_b)
    score = lift[pick]
    score += cos
    return cos, sim[pick], np.minimum(1.0, score, out=score)


def _vectors(met) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(x).reshape(n, -1) for x, n in ((met.p_vecs, len(met.p_ids)), (met.vecs, len(met.ids))))


def _listed(names: np.ndarray, other: np.ndarray, ok: np.ndarray, scores: tuple, k: int | None, same: bool) -> pd.DataFrame:
    """The pairs ``ok`` of two blocks, of each probe the k best."""
    cos, sim, score = scores
    row, col = np.nonzero(ok)
    # best first in each row; ties go to the later name
    later = np.empty(len(other), np.int64)
    later[np.argsort(other)[::-1]] = np.arange(len(other))
    best = np.lexsort((later[col], -sim[row, col], -cos[row, col], -score[row, col], row))
    row, col = row[best], col[best]
    if k is not None:
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[keep], col[keep]
    return pd.DataFrame({"id": names[row], "other": other[col], "cos": cos[row, col], "title_sim": sim[row, col],
                         "combined": score[row, col], "same": same})


def _block_pairs(p, m, rotation: np.ndarray, needs: np.ndarray, k: int | None, titles: bool) -> pd.DataFrame | None:
    """What a block of probes finds in a block of members: all that is asked for, or the k best of each probe."""
    u, v = (np.frombuffer(x.vecs).reshape(len(x.ids), -1) for x in (p, m))
    lift = np.zeros(len(u))
    if len(m.seen):
        seen = set(m.seen)
        lift = np.array([TITLE_WEIGHT if seen.intersection(h) else 0.0 for h in p.hot])
    rows = np.flatnonzero(B.row_bound(u @ rotation, np.asarray(m.mean), np.asarray(m.radius)) + lift + B.EPS >= needs)
    if not len(rows):
        return None
    scores = _scores(u[rows], [p.words[i] for i in rows], v, m.words, titles)
    return _listed(np.asarray(p.ids)[rows], np.asarray(m.ids), scores[2] >= needs[rows, None], scores, k, p.block == m.block)


def _one_way(p: str, m: str) -> bool:
    """Whether a block of probes or that of members looks at a pair of blocks; either does for half of the others."""
    return p == m or (p < m) == ((zlib.crc32(p.encode()) ^ zlib.crc32(m.encode())) & 1 == 0)


class _Tile:
    """Blocks of probes one task holds, and what the members that stream by have given them so far.

    Of a top-k at most a few times k rows of each probe are kept, and the k-th
    score found raises what the probe asks for.
    """

    def __init__(self, rotation: np.ndarray, k: int | None, titles: bool, once: bool):
        self.rotation, self.k, self.titles, self.once = rotation, k, titles, once
        self.probes, self.needs, self.found, self.rows = [], [], [], []

    def add(self, p) -> None:
        self.probes.append(p)
        self.needs.append(np.array(p.needs, dtype=np.float64))
        self.found.append([])
        self.rows.append(0)

    def meet(self, m) -> Iterator[pd.DataFrame]:
        for i, p in enumerate(self.probes):
            if self.once and not _one_way(p.block, m.block):
                continue
            out = _block_pairs(p, m, self.rotation, self.needs[i], self.k, self.titles)
            if out is None or not len(out):
                continue
            if self.k is None:
                yield out
                continue
            self.found[i].append(out)
            self.rows[i] += len(out)
            if self.rows[i] > 4 * self.k * len(p.ids):
                self._cut(i)

    def _cut(self, i: int) -> None:
        d = pd.concat(self.found[i], ignore_index=True)
        d = d.sort_values(["id", "combined", "cos", "title_sim", "other"], ascending=[True, False, False, False, False])
        rank = d.groupby("id").cumcount()
        d, last = d[rank < self.k], d[rank == self.k - 1]
        self.found[i], self.rows[i] = [d], len(d)
        kth = dict(zip(last.id, last.combined))
        asked = np.array([kth.get(x, -2.0) for x in self.probes[i].ids]) - B.EPS
        self.needs[i] = np.maximum(self.needs[i], asked)

    def best(self) -> Iterator[pd.DataFrame]:
        for i, rows in enumerate(self.found):
            if rows:
                self._cut(i)
                yield self.found[i][0]


def _word_pairs(word: str, rows: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """Pairs of the probes and members of one title word that share no rarer and no frequent word."""
    p, m = rows[rows.probe], rows[~rows.probe]
    before = lambda side: [list(r)[:list(r).index(word)] for r in side.rare]
    scores = _scores(B.unit(p.vec), list(p.words), B.unit(m.vec), list(m.words), True)
    first = (B.shared(before(p), before(m)) == 0) & (B.shared(list(p.hot), list(m.hot)) == 0)
    ok = first & (scores[1] >= TITLE_MIN) & (scores[2] >= p.need.to_numpy()[:, None])
    return _listed(p.id.to_numpy(dtype=object), m.id.to_numpy(dtype=object), ok, scores, k, False)


class Search:
    """One search: every pair of a probe and a member whose combined score is at least what the probe asks for.

    Blocks of vectors are skipped by their bounds (:mod:`.vector_blocks`).  A
    title can lift a pair above the floor whose vectors alone are below it; such
    a pair shares a title word.  Words that more than RARE members have
    loosen the bounds of blocks that share them; all others are an equi-join on
    the rarest word two titles share.
    """

    def __init__(self, probes: DataFrame, members: DataFrame, titles: bool, block: int | None = None):
        self.titles = titles and "title" in members.columns and "title" in probes.columns
        m = _prepare(members, self.titles)
        rows, width = m.agg(F.count("*"), F.max(F.size("vec"))).first()
        self.empty = rows == 0
        if self.empty:
            return
        self.block = block or max(64, BLOCK * 64 // max(64, width))
        counts = m.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("rows")) if self.titles else None
        rare = min(RARE, self.block)
        self.rare = self.titles and not counts.filter(F.col("rows") <= rare).isEmpty()
        self.members = _ranked(m, counts, rare)
        self.probes = self.members if probes is members else _ranked(_prepare(probes, self.titles), counts, rare)
        self.space = B.learn(m, rows, self.block)
        self.lift = TITLE_WEIGHT if self.titles else 0.0
        narrow = ["id", "vec", "words", "hot"]
        self.packed = B.pack(self.members.select(*narrow), self.space, self.block)
        self.asking = self.packed if probes is members else B.pack(self.probes.select(*narrow), self.space, self.block)

    def _met(self, pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """Pairs of blocks with their rows."""
        p = asking.select(F.col("block").alias("probe"), F.col("ids").alias("p_ids"), F.col("words").alias("p_words"), F.col("hot").alias("p_hot"),
                          F.col("vecs").alias("p_vecs"), *[c for c in ("needs",) if c in asking.columns])
        m = self.packed.select(F.col("block").alias("member"), "ids", "words", "vecs", "mean", "radius", "seen")
        # a few rows of megabytes: dealt out by number, as their bytes say nothing of the work in a pair
        return spread(pairs.select("probe", "member").join(p, "probe").join(m, "member"))

    def _needs(self, k: int) -> DataFrame:
        """The k-th score every probe has in the member block around it, as a column of its block."""
        near = self.asking.select("cell", F.col("block").alias("probe"), F.col("mean").alias("pm")).join(
            self.packed.select("cell", F.col("block").alias("member"), F.col("mean").alias("mm")), "cell")
        dot = F.aggregate(F.zip_with("pm", "mm", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        home = near.groupBy("probe").agg(F.max_by("member", dot).alias("member"))
        titles = self.titles

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples():
                    u, v = _vectors(r)
                    score = _scores(u, r.p_words, v, r.words, titles)[2]
                    enough = score.shape[1] >= k
                    out.append((r.probe, np.partition(score, -k, axis=1)[:, -k] - B.EPS if enough else np.full(len(u), -2.0)))
                yield pd.DataFrame(out, columns=["block", "needs"])

        found = self._met(home, self.asking).mapInPandas(run, "block string, needs array<double>")
        return cut_lineage(self.asking.join(found, "block", "left").withColumn(
            "needs", F.coalesce("needs", F.transform("ids", lambda i: F.lit(-2.0)))))

    def _ask(self, k: int | None, floor: float | None) -> DataFrame:
        if floor is None:
            return self._needs(k)
        return self.asking.withColumn("needs", F.transform("ids", lambda i: F.lit(float(floor))))

    def visits(self, asking: DataFrame) -> DataFrame:
        return B.visits(B.summary(asking, F.array_min("needs")), B.summary(self.packed), self.lift)

    def found(self, k: int | None, floor: float | None, once: bool = False) -> DataFrame:
        """(id, other, cos, title_sim, combined, same): for top-k searches a list that holds the k best of every
        probe, else all pairs from the floor on; with ``once`` only one of (a, b) and (b, a) of a self-join."""
        asking = self._ask(k, floor)
        found = self._streamed(asking, k, once)
        if once:
            a, b = F.least("id", "other"), F.greatest("id", "other")
            found = found.filter("not same or id < other").withColumns({"id": a, "other": b})
        if not self.rare:
            return found
        need = None
        if floor is None:
            need = asking.select(F.explode(F.arrays_zip("ids", "needs")).alias("r")).select(
                F.col("r.ids").alias("id"), F.col("r.needs").alias("need"))
        return found.unionByName(self._by_rare_word(k, floor, need, once)).dropDuplicates(["id", "other"])

    def _streamed(self, asking: DataFrame, k: int | None, once: bool) -> DataFrame:
        """Every block of probes against every block of members its bounds do not rule out.

        Blocks of probes are dealt to tiles, a partition each; a task holds the
        probes of its tile while all members stream by, one block at a time.  So
        members are sent once for each tile, however many pairs of blocks meet,
        and a top-k leaves k rows for each probe.
        """
        rows = asking.agg(F.sum("n")).first()[0] or 0
        tiles = max(1, -(-rows // TILE), min(TILES, -(-rows // self.block)))
        cols = ["block", "ids", "words", "hot", "vecs", "mean", "radius", "seen"]
        p = asking.select(F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), *cols, "needs")
        m = self.packed.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("side"), *cols,
                               F.lit(None).cast("array<double>").alias("needs"))
        met = p.unionByName(m).repartitionById(tiles, F.col("tile")).sortWithinPartitions("tile", "side", "block")
        rotation, titles = self.space.rotation, self.titles

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, tile = None, None
            for b in batches:
                for r in b.itertuples():
                    if r.tile != at:
                        if tile is not None:
                            yield from tile.best()
                        at, tile = r.tile, _Tile(rotation, k, titles, once)
                    if r.side == 0:
                        tile.add(r)
                    elif tile.probes:
                        yield from tile.meet(r)
            if tile is not None:
                yield from tile.best()

        return met.mapInPandas(run, _PAIRS)

    def _by_rare_word(self, k: int | None, floor: float | None, need: DataFrame | None, once: bool) -> DataFrame:
        """Pairs whose titles share no frequent word and enough others, met at the rarest one they share.

        A word has at most RARE members; its probes come in parts of a block.
        """
        cols = ["id", "vec", "words", "hot", "rare"]
        p = self.probes.select(*cols, F.lit(floor).alias("need")) if need is None else self.probes.join(need, "id").select(*cols, "need")
        p = p.select("*", F.explode("rare").alias("word"), F.lit(True).alias("probe"))
        m = self.members.select(*cols, F.lit(None).cast("double").alias("need"), F.explode("rare").alias("word"), F.lit(False).alias("probe"))
        if self.probes is self.members:
            p, m = p.withColumn("part", F.lit(0).cast("long")), m.withColumn("part", F.lit(0).cast("long"))
        else:
            parts = p.groupBy("word").agg(F.ceil(F.count("*") / self.block).alias("parts"))
            p = p.join(parts, "word").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
            m = m.join(parts, "word").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = _word_pairs(key[0], rows, k) if rows.probe.nunique() == 2 else []
            return out if len(out) else pd.DataFrame()

        found = p.unionByName(m).groupBy("word", "part").applyInPandas(run, _PAIRS)
        return found.filter("id < other") if once else found


def nearest(probes: DataFrame, members: DataFrame, k: int, floor: float | None = None,
            cos_floor: float | None = None, titles: bool = True, block: int | None = None) -> DataFrame:
    """Exact top-k of each probe by combined score, (id, other, cos, title_sim,
    combined, pos); of those k, the ones below ``cos_floor`` are left out."""
    search = Search(probes, members, titles, block)
    if search.empty:
        return members.sparkSession.createDataFrame([], f"{_PAIRS}, pos int").drop("same")
    w = Window.partitionBy("id").orderBy(F.desc("combined"), F.desc("cos"), F.desc("title_sim"), F.desc("other"))
    top = search.found(k, floor).drop("same").withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    return top if cos_floor is None else top.filter(F.col("cos") >= cos_floor)


def visited_share(probes: DataFrame, members: DataFrame, k: int | None = None, floor: float | None = None, titles: bool = True,
                  block: int | None = None) -> float:
    """The part of all (probe, member) pairs that lie in blocks a search looks into."""
    search = Search(probes, members, titles, block)
    seen = search.visits(search._ask(k, floor)).agg(F.sum(F.col("probe_rows").cast("double") * F.col("member_rows"))).first()[0]
    return (seen or 0.0) / (probes.count() * members.count())


def neighbours(notes: DataFrame, k: int = TOP_K, merge: float = ZONE_MERGE, flag: float = ZONE_FLAG) -> DataFrame:
    """Top-k list of every note against all notes, itself included in the k.

    Notes with the same vector and title words share one search.  Of such a
    group only the last ``k`` names can be in anybody's list, so only they are
    members; the group may be any share of the table.
    """
    titles = "title" in notes.columns
    words = F.array_sort(T.token_set(F.coalesce("title", F.lit("")))) if titles else F.array().cast("array<string>")
    keyed = notes.withColumn("g", F.sha2(F.concat_ws("|", F.col("vec").cast("string"), F.array_join(words, " ")), 256))
    keyed = keyed.withColumn("id", F.col("id").cast("string"))
    w = Window.partitionBy("g").orderBy(F.desc("id"))
    few = cut_lineage(keyed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))
    probes = few.filter("rn = 1").withColumn("id", F.col("g"))
    found = nearest(probes, few, k, flag, titles=titles)
    return (keyed.select(F.col("id").alias("note"), "g").join(found.withColumnRenamed("id", "g"), "g")
            .filter("note <> other").select("note", "other", "pos", "cos", "title_sim", "combined",
                                            zone(F.col("combined"), merge, flag).alias("zone")))


def pairs(notes: DataFrame, floor: float = ZONE_FLAG, block: int | None = None) -> DataFrame:
    """All unordered pairs at or above a combined score, best first in value.

    Exact over the whole batch; only qualifying pairs are emitted.
    """
    ids = notes.withColumn("id", F.col("id").cast("string"))
    search = Search(ids, ids, "title" in notes.columns, block)
    found = notes.sparkSession.createDataFrame([], _PAIRS) if search.empty else search.found(None, floor, once=True)
    return found.select(F.col("id").alias("a"), F.col("other").alias("b"), "cos", "title_sim",
                        "combined", zone(F.col("combined")).alias("zone"))


def best_edges(lists: DataFrame) -> DataFrame:
    """One edge per unordered pair, the better of the two directions."""
    a, b = F.least("note", "other").alias("a"), F.greatest("note", "other").alias("b")
    row = F.struct("combined", "cos", "title_sim", "zone")
    return (lists.filter(F.col("zone") != "new").groupBy(a, b).agg(F.max(row).alias("r"))
            .select("a", "b", "r.combined", "r.cos", "r.title_sim", "r.zone"))


def mutual(edges: DataFrame, top: int = MUTUAL_TOP) -> DataFrame:
    """Edges that rank among the best ``top`` of both their ends."""
    ends = edges.select("a", "b", "combined", F.explode(F.array("a", "b")).alias("end"))
    w = Window.partitionBy("end").orderBy(F.desc("combined"), "a", "b")
    kept = ends.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top)
    both = kept.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b")
    return edges.join(both, ["a", "b"])


def clusters(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, component) and zones (component, zone) of kept edges."""
    pairs_ = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = pairs_.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    member = components(nodes, pairs_)
    zones = (edges.join(member, edges["a"] == member["id"]).groupBy("component")
             .agg(F.when(F.bool_or(F.col("zone") == "merge"), "merge").otherwise("flag").alias("zone")))
    return member, zones


def canonical(member: DataFrame, meta: DataFrame) -> DataFrame:
    """(component, size, canon): newest date, then longest, then first name.

    An aggregate, not a window: a cluster of any size is combined on the way.
    """
    d = member.join(meta, "id")
    newest = F.struct(F.col("date"), F.col("chars"))
    best = d.groupBy("component").agg(F.count("*").alias("size"), F.max(newest).alias("_m"))
    tied = d.join(best, "component").filter((F.col("date") == F.col("_m.date")) & (F.col("chars") == F.col("_m.chars")))
    canon = tied.groupBy("component").agg(F.min("id").alias("canon"), F.max("date").alias("date"), F.max("chars").alias("chars"))
    return best.select("component", "size").join(canon, "component")


def duplicate_report(notes: DataFrame, meta: DataFrame, k: int = TOP_K, merge: float = ZONE_MERGE,
                     flag: float = ZONE_FLAG) -> DataFrame:
    """Clusters of near duplicates, merge zone first, larger first.

    A note without a usable vector would silently miss its duplicates, so it
    voids the report.
    """
    bad = notes.filter(F.col("vec").isNull() | (F.size("vec") == 0)).limit(1)
    if not bad.isEmpty():
        raise ValueError("a note has no vector; the report would be incomplete")
    # both are read several times, and are small beside the search that made them
    kept = cut_lineage(mutual(cut_lineage(best_edges(neighbours(notes, k, merge, flag)))))
    member, zones = clusters(kept)
    out = canonical(member, meta).join(zones, "component")
    return out.orderBy(F.when(F.col("zone") == "merge", 0).otherwise(1), F.desc("size"), "component")


def rerank(queries: DataFrame, docs: DataFrame, pool: int = RERANK_POOL, keep: int = 5) -> DataFrame:
    """Cosine pool, then order by the share of query stems in title and opening.

    ``queries(id, vec, text)``, ``docs(id, vec, title, text)``.
    """
    found = nearest(queries.select("id", "vec"), docs.select("id", "vec"), pool, titles=False)
    q = queries.select(F.col("id").cast("string").alias("id"), T.stem_set(F.col("text")).alias("qs"))
    head = F.concat_ws("\n", "title", F.substring("text", 1, RERANK_CHARS))
    d = docs.select(F.col("id").cast("string").alias("other"), T.stem_set(head).alias("ds"))
    share = F.when(F.size("qs") > 0, F.size(F.array_intersect("qs", "ds")) / F.size("qs")).otherwise(0.0)
    scored = found.join(q, "id").join(d, "other").withColumn("share", share)
    w = Window.partitionBy("id").orderBy(F.desc("share"), "pos")
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
            .select("id", "rank", "other", "cos", "share"))


def last_write_wins(index: DataFrame, added: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """Append to a vector index: the newest batch of a key replaces the rest."""
    both = index.unionByName(added)
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
