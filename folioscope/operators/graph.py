"""Concept graphs as two tables: nodes(id, label, file_type, source_file) and
edges(source, target, relation, type, label, source_file[, nodes])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..session import cut_lineage

EDGE_KEY = ["source", "target", "relation", "type", "label", "source_file"]


def bare_id(v: Column) -> Column:
    return F.regexp_replace(F.coalesce(v, F.lit("")), r"^([^:]+::)+", "")


def known_type(v: Column) -> Column:
    t = F.trim(F.coalesce(v, F.lit("")))
    return F.when(t.isin(rules.FILE_TYPES), t).otherwise("concept")


def norm_label(v: Column) -> Column:
    return T.sub(F.lower(T.strip(v)), r"\s+", " ")


def _edge_key(edges: DataFrame) -> list[Column]:
    cols = [F.coalesce(F.col(c), F.lit("")) for c in EDGE_KEY]
    return cols + ([F.coalesce(F.array_join("nodes", "\u0000"), F.lit(""))] if "nodes" in edges.columns else [])


def union_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """One row per id; each field takes its first non-blank value in order.

    ``min_by`` over the order is a partial aggregate, so an id that occurs in a
    third of all rows is combined before the shuffle.
    """
    ordering = F.struct(*order)

    def first(c: str) -> Column:
        ok = F.col(c).isNotNull() & (F.col(c) != "")
        return F.min_by(F.when(ok, F.col(c)), F.when(ok, ordering)).alias(c)
    fields = [c for c in nodes.columns if c != "id" and c not in order]
    fields += [c for c in order if c in ("label", "source_file", "file_type") and c not in fields]
    return nodes.groupBy("id").agg(*[first(c) for c in fields])


def union_edges(edges: DataFrame) -> DataFrame:
    """One row per edge key, blanks as empty strings."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in EDGE_KEY]
    extra = ["nodes"] if "nodes" in edges.columns else []
    return edges.select(*blank, *extra).distinct()


def normalise(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Namespace prefixes cut, file types closed, duplicates united; a column ``seq`` of the nodes settles ties."""
    seq = F.col("seq") if "seq" in nodes.columns else F.lit(0)
    n = nodes.select(bare_id(F.col("id")).alias("id"), "label", known_type(F.col("file_type")).alias("file_type"),
                     "source_file", F.col("id").alias("_ord"), seq.alias("seq"))
    e = edges.withColumn("source", bare_id(F.col("source"))).withColumn("target", bare_id(F.col("target")))
    if "nodes" in edges.columns:
        e = e.withColumn("nodes", F.transform("nodes", bare_id))
    merged = union_nodes(n, ["_ord", "label", "source_file", "seq"]).select("id", "label", "file_type", "source_file")
    return merged, union_edges(e)


def normalise_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id", bare_id(F.col("id")).alias("nid"), "file_type")
    raw = F.coalesce(F.col("file_type"), F.lit(""))
    a = n.agg(F.count_if(F.col("nid") != F.col("id")).alias("stripped_namespaces"),
              F.count_if((raw != "") & ~raw.isin(rules.FILE_TYPES)).alias("normalised_file_types"),
              (F.count("*") - F.count_distinct("nid")).alias("merged_nodes"))
    e = edges.withColumn("source", bare_id(F.col("source"))).withColumn("target", bare_id(F.col("target")))
    b = e.agg((F.count("*") - F.count_distinct(F.struct(*_edge_key(e)))).alias("dropped_edges"))
    return a.crossJoin(b)  # one row each


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long table (measure, value): sizes, bad file types, namespace prefixes."""
    prefix = F.regexp_extract("id", r"^([^:]+)::", 1)
    raw = F.coalesce(F.col("file_type"), F.lit(""))
    return (nodes.agg(F.count("*").alias("nodes"),
                      F.count_if((raw != "") & ~raw.isin(rules.FILE_TYPES)).alias("bad_file_types"))
            .select(F.inline(F.array(F.struct(F.lit("nodes").alias("measure"), F.col("nodes").alias("value")),
                                     F.struct(F.lit("bad_file_types").alias("measure"), F.col("bad_file_types").alias("value")))))
            .unionByName(edges.agg(F.lit("edges").alias("measure"), F.count("*").alias("value")))
            .unionByName(nodes.filter(prefix != "").groupBy(F.concat(F.lit("prefix:"), prefix).alias("measure"))
                         .agg(F.count("*").alias("value"))))


def rewrite_ends(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Edge ends, and the members of hyper-edges (an array column ``nodes``), through ``id_map(old, new)``."""
    if "nodes" in edges.columns:
        row = edges.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode_outer("nodes").alias("_at", "_old"))
        m = id_map.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        part = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_new", "_old").alias("id")))
        keep = [c for c in edges.columns if c != "nodes"]
        edges = row.join(m, "_old", "left").groupBy("_row").agg(
            *[F.first(c).alias(c) for c in keep], F.first("nodes").alias("_was"), F.array_sort(F.collect_list(part)).alias("_now")).select(
            *[F.when(F.col("_was").isNotNull(), F.transform("_now", lambda x: x["id"])).alias(c) if c == "nodes" else c for c in edges.columns])
    s = id_map.select(F.col("old").alias("source"), F.col("new").alias("_s"))
    t = id_map.select(F.col("old").alias("target"), F.col("new").alias("_t"))
    out = (edges.join(s, "source", "left").join(t, "target", "left")
           .withColumn("source", F.coalesce("_s", "source")).withColumn("target", F.coalesce("_t", "target"))
           .drop("_s", "_t"))
    return out.select(*edges.columns)


# -- cleaning --------------------------------------------------------------------------

def is_template(label: Column, file_type: Column) -> Column:
    low = norm_label(label)
    part = F.lit(False)
    for s in rules.STRUCTURAL_PARTS:
        part = part | low.contains(s)
    return (F.coalesce(file_type, F.lit("")) != "code") & (low.isin(rules.TEMPLATE_LABELS) | part)


def drop_templates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining nodes, remaining edges, dropped nodes."""
    test = is_template(F.coalesce("label", "id"), F.col("file_type"))
    gone = nodes.filter(test)
    ids = gone.select("id").distinct()
    kept = (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
            .join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))
    return nodes.filter(~test), kept.select(*edges.columns), gone


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs without self-loops."""
    return edges.filter("source <> target").select(F.least("source", "target").alias("u"),
                                                   F.greatest("source", "target").alias("v")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = undirected(edges)
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id")))
    return nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def merge_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-code nodes with one normalised label become the best-connected one.

    Returns nodes, distinct unordered edges and the map of merged-away ids.
    """
    d = nodes.join(degrees(nodes, edges), "id").withColumn("_l", norm_label(F.coalesce("label", "id")))
    loose = d.filter(F.coalesce("file_type", F.lit("")) != "code")
    # highest degree, then the smallest id: negate the degree and take the least
    canon = loose.groupBy("_l").agg(F.min_by("id", F.struct((-F.col("degree")).alias("nd"), F.col("id"))).alias("new"))
    id_map = loose.join(canon, "_l").filter("id <> new").select(F.col("id").alias("old"), "new")
    left = nodes.join(id_map.select(F.col("old").alias("id")), "id", "left_anti")
    pairs = undirected(rewrite_ends(edges.select("source", "target"), id_map))
    return left, pairs, id_map


def frequent_labels(nodes: DataFrame, floor: int = 4) -> DataFrame:
    """Labels frequent enough to review that no list covers yet."""
    low = norm_label(F.coalesce("label", "id"))
    part = F.lit(False)
    for s in rules.STRUCTURAL_PARTS:
        part = part | F.col("label").contains(s)
    return (nodes.filter(F.coalesce("file_type", F.lit("")) != "code").groupBy(low.alias("label"))
            .agg(F.count("*").alias("n")).filter((F.col("n") >= floor) & ~F.col("label").isin(rules.TEMPLATE_LABELS) & ~part))


# -- components and communities -----------------------------------------------------------

def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): every node with the smallest id of its component.

    Alternates two contractions: each node hands its larger neighbours the
    smallest neighbour it knows, then its smaller ones.  Both are one minimum
    per node (combined before the shuffle) and one join, and the pair table
    shrinks to one pair per node.  A round ends in the checkpoint folder, and
    the loop stops when a round changes nothing.
    """
    e = pairs.filter("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    e = cut_lineage(e)
    before = None
    while True:
        sym = e.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(
            e.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        m = sym.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = sym.join(m, "x").filter("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        large = large.filter("hi <> lo")
        m2 = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(m2, "hi")
        small = (joined.filter("lo <> m").select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
                 .union(m2.select("hi", F.col("m").alias("lo"))).distinct())
        e = cut_lineage(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return nodes.select("id").join(e.select(F.col("hi").alias("id"), F.col("lo").alias("component")), "id", "left"
                                   ).withColumn("component", F.coalesce("component", "id"))


def extend_components(labels: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component) after more nodes and links, from a stored label table.

    Old links are not read again: the ends of new ones become the components
    they lie in, and the rounds run over those components alone.  A component
    is named after its smallest node, so the smallest name stays right.  Ends
    that are in neither table, null ends and links inside one component change
    nothing; links are only ever added.
    """
    fresh = nodes.select("id").distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id"))
    every = cut_lineage(labels.select("id", "component").unionByName(fresh))
    u, v = (every.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in ("u", "v"))
    between = cut_lineage(pairs.select("u", "v").distinct().join(u, "u").join(v, "v").filter("cu <> cv").select(
        F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    if between.isEmpty():
        return every
    heads = between.select(F.col("u").alias("id")).union(between.select(F.col("v").alias("id"))).distinct()
    top = components(heads, between).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return every.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def component_stats(comp: DataFrame) -> DataFrame:
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def communities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, community) by label propagation until the labels settle.

    In every round a node takes the label most of its neighbours carry, the
    smallest on ties.  All nodes move at once, so two sides of an edge may keep
    swapping labels: the rounds end as soon as the labels as a whole are those
    of any earlier round, which the finite number of states guarantees.  This
    is our own deterministic rule; the tool it stands for does not state one.
    """
    lab = nodes.select("id", F.col("id").alias("community"))
    sym = cut_lineage(pairs.select(F.col("u").alias("id"), F.col("v").alias("nb")).union(
        pairs.select(F.col("v").alias("id"), F.col("u").alias("nb"))))
    seen = set()
    while True:
        votes = (sym.join(lab.select(F.col("id").alias("nb"), "community"), "nb")
                 .groupBy("id", "community").agg(F.count("*").alias("n")))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct((-F.col("n")).alias("k"), "community")).alias("c"))
        lab = cut_lineage(lab.join(best, "id", "left").select("id", F.coalesce("c", "community").alias("community")))
        state = lab.agg(*[F.sum(F.xxhash64(F.lit(i), "id", "community").cast("decimal(38,0)")) for i in (0, 1)]).first()
        if tuple(state) in seen:
            return lab
        seen.add(tuple(state))


def community_labels(comm: DataFrame, nodes: DataFrame, edges: DataFrame, width: int = 30) -> DataFrame:
    """Each community named after its best-connected member."""
    d = comm.join(degrees(nodes, edges), "id").join(nodes.select("id", "label"), "id")
    return d.groupBy("community").agg(
        F.count("*").alias("n"), T.short_label(F.min_by(F.coalesce("label", "id"), F.struct(
            (-F.col("degree")).alias("k"), "id")), width).alias("label"))


def hubs(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    return (degrees(nodes, edges).join(nodes.select("id", "label"), "id")
            .orderBy(F.desc("degree"), "id").limit(top))


def clean_ledger(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes and components before and after cleaning, one row per state.

    Both states are one graph whose ids begin with the digit of their state, so
    the rounds of :func:`components` run once for the two.
    """
    kept, kept_edges, gone = drop_templates(nodes, edges)
    after, after_pairs, id_map = merge_duplicates(kept, kept_edges)
    states = [("0", nodes, undirected(edges)), ("1", after, after_pairs)]
    tagged = lambda d, tag, *cols: d.select(*[F.concat(F.lit(tag), c).alias(c) for c in cols])
    n = cut_lineage(tagged(states[0][1], "0", "id").union(tagged(states[1][1], "1", "id")))
    p = cut_lineage(tagged(states[0][2], "0", "u", "v").union(tagged(states[1][2], "1", "u", "v")))
    sizes = components(n, p).groupBy("component").agg(F.count("*").alias("n")).groupBy(F.substring("component", 1, 1).alias("tag")).agg(
        F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"))
    links = p.groupBy(F.substring("u", 1, 1).alias("tag")).agg(F.count("*").alias("edges"))
    rows = nodes.sparkSession.range(2).select(F.col("id").cast("string").alias("tag"), F.when(F.col("id") == 0, "before").otherwise("after").alias("state"))
    out = rows.join(sizes, "tag", "left").join(links, "tag", "left").fillna(0).select(
        "state", "nodes", "edges", "components", "largest",
        F.floor(F.col("largest") * 100 / F.greatest("nodes", F.lit(1))).cast("bigint").alias("largest_pct"))
    extra = gone.agg(F.count("*").alias("dropped")).crossJoin(id_map.agg(F.count("*").alias("merged")))  # one row each
    return out.crossJoin(extra)


def dropped_labels(nodes: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """(label, n): the labels most template nodes carry, as the ledger lists them."""
    _, _, gone = drop_templates(nodes, edges)
    return gone.groupBy(norm_label(F.coalesce("label", "id")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


# -- unions and replacement -----------------------------------------------------------------

def merge(base: tuple[DataFrame, DataFrame], incoming: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of two normalised graphs; base fields win unless blank."""
    bn, be = normalise(*base)
    inn, ie = normalise(*incoming)
    both = bn.withColumn("_ord", F.lit(0)).unionByName(inn.withColumn("_ord", F.lit(1)))
    nodes = union_nodes(both, ["_ord", "label", "source_file"])
    return (nodes.select("id", "label", known_type(F.col("file_type")).alias("file_type"), "source_file"),
            union_edges(be.unionByName(ie)))


def replace_sources(graph: tuple[DataFrame, DataFrame], files: DataFrame,
                    incoming: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Drop the concept nodes of re-extracted files with all their edges, then
    unite with the new extraction.  Without such a node nothing is dropped."""
    nodes, edges = graph
    test = F.col("id").rlike("^[0-9a-f]{8}-") | F.coalesce("file_type", F.lit("")).isin("concept", "rationale")
    stale = nodes.join(files, "source_file", "left_semi").filter(test)
    ids = stale.select("id").distinct()
    live = files.crossJoin(stale.select(F.lit(1).alias("_any")).limit(1)).drop("_any")  # one row or none
    n = nodes.join(ids, "id", "left_anti").select(*nodes.columns)
    e = edges.join(live, "source_file", "left_anti")
    e = (e.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
         .join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))
    if "nodes" in edges.columns:
        keyed = e.select(F.struct(*_edge_key(e)).alias("k"), F.explode("nodes").alias("id"))
        touched = keyed.join(ids, "id", "left_semi").select("k").distinct()
        e = e.withColumn("k", F.struct(*_edge_key(e))).join(touched, "k", "left_anti")
    return merge((n, e.select(*edges.columns)), incoming)


def _concept_id(source_file: Column, local: Column) -> Column:
    return F.concat(F.substring(F.sha1(source_file), 1, 8), F.lit("-"), T.slug(local, 50, "node"))


def concept_nodes(extracted: DataFrame, max_nodes: int = 8) -> DataFrame:
    """Ids of extracted concepts: path digest and slug, first ``max_nodes`` of
    each file.  Input: (source_file, ord, local_id, label)."""
    w = Window.partitionBy("source_file").orderBy("ord")
    return (extracted.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_nodes)
            .select(_concept_id(F.col("source_file"), F.col("local_id")).alias("id"), "label",
                    F.lit("concept").alias("file_type"), "source_file"))


def concept_edges(extracted: DataFrame, max_edges: int = 12) -> DataFrame:
    """First ``max_edges`` relations of a file, self-loops out.  An end's id is a
    function of the file and the local name, so no join is needed.
    Input: (source_file, ord, source, target, relation)."""
    w = Window.partitionBy("source_file").orderBy("ord")
    return (extracted.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_edges)
            .select(_concept_id(F.col("source_file"), F.col("source")).alias("source"),
                    _concept_id(F.col("source_file"), F.col("target")).alias("target"),
                    "relation", F.lit("INFERRED").alias("type"), "source_file").filter("source <> target"))


# -- communities by modularity -----------------------------------------------------------------

def weighted(pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(u, v, w): how many links join two groups, u <= v; a row with u = v counts those inside.

    ``pairs(u, v[, w])``; without ``groups(id, community)`` every node is its own group.
    """
    e = pairs if "w" in pairs.columns else pairs.withColumn("w", F.lit(1).cast("long"))
    if groups is not None:
        e = _through(_through(e, groups, "u"), groups, "v")
    return e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def _through(e: DataFrame, groups: DataFrame, end: str) -> DataFrame:
    """Edge table with one end replaced by its group."""
    g = groups.select(F.col("id").alias(end), F.col("community").alias("_c"))
    return e.join(g, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")


def strengths(links: DataFrame) -> DataFrame:
    """(id, d, inside): weighted degree (an inner link counts twice) and inner weight of each group."""
    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("id"), "w", F.lit(False).alias("own")),
                                         F.struct(F.col("v").alias("id"), "w", (F.col("u") == F.col("v")).alias("own")))))
    return ends.groupBy("id").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("own"), F.col("w")).otherwise(0)).alias("inside"))


def modularity(links: DataFrame) -> DataFrame:
    """(links, gain, modularity) of a table from :func:`weighted`, one row.

    ``gain`` is 4 m² times the modularity, the sum of 4 m inside - d² over all
    groups, in exact whole numbers; a graph without links has a modularity of 0.
    """
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("links"))
    d = strengths(links).agg(F.sum("inside").alias("inside"), F.sum(_whole("d") * _whole("d")).alias("squares"))
    return d.crossJoin(total).select(  # one row each
        "links", F.coalesce(F.expr("cast(4 * cast(links as decimal(19,0)) * inside - squares as decimal(38,0))"), _whole(F.lit(0))).alias("gain"),
        F.when(F.col("links") > 0, F.col("inside") / F.col("links") - F.col("squares").cast("double") / (4.0 * F.col("links") * F.col("links")))
        .otherwise(0.0).alias("modularity"))


def _whole(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("decimal(19,0)")


def _merges(links: DataFrame, sizes: DataFrame, total: int, level: int) -> DataFrame:
    """(id, community) of the groups that one level merges into another.

    Joining two groups raises modularity if 2 m w > d d'.  Every group points
    to the neighbour of the largest such gain; ties go by a hash of the two, so
    that equal gains do not line up in chains.  Pairs that point at each other
    merge, the stronger one leads, so a level with any gain makes a merge.
    Whoever points to a leader follows it; the others are leaders or followers
    by a hash of the level.  A leader takes several followers: sorted by how
    much they may add, one may follow as long as 2 m w > d (d' + what came
    before it), which no later follower can undo.  What came before is summed
    per class of such quotients, so a leader with any number of followers is a
    few hundred rows in the window.
    """
    side = lambda x: sizes.select(F.col("id").alias(x), F.col("d").alias(f"d{x}"))
    both = links.filter("u <> v").join(side("u"), "u").join(side("v"), "v")
    room = F.expr(f"cast({2 * total} as decimal(19,0)) * cast(w as decimal(19,0)) - cast(du as decimal(19,0)) * cast(dv as decimal(19,0))")
    both = both.withColumn("gain", room).filter("gain > 0").withColumn("tie", F.xxhash64("u", "v", F.lit(level)))
    arcs = both.select(F.inline(F.array(
        F.struct(F.col("u").alias("id"), F.col("v").alias("to"), F.col("du").alias("d"), F.col("dv").alias("dto"), "w", "gain", "tie"),
        F.struct(F.col("v").alias("id"), F.col("u").alias("to"), F.col("dv").alias("d"), F.col("du").alias("dto"), "w", "gain", "tie"))))
    best = arcs.groupBy("id").agg(F.max_by(F.struct("to", "d", "dto", "w"), F.struct("gain", "tie", "to")).alias("b")).select("id", "b.*")
    best = cut_lineage(best)
    mate = best.select(F.col("id").alias("to"), F.col("to").alias("back"))
    d = best.join(mate, "to", "left").withColumn("mutual", F.coalesce(F.col("back") == F.col("id"), F.lit(False)))
    leads = F.struct("d", "id") > F.struct(F.col("dto").alias("d"), F.col("to").alias("id"))
    coin = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == 0
    role = F.when(F.col("mutual"), F.when(leads, "leader").otherwise("follower"))
    d = cut_lineage(d.select("id", "to", "d", "dto", "w", "mutual", role.alias("fixed"), coin.alias("coin")))
    of = d.select(F.col("id").alias("to"), F.col("fixed").alias("to_fixed"), F.col("to").alias("to_to"), F.col("coin").alias("to_coin"))
    lead = d.filter("fixed = 'leader'").select(F.col("id").alias("to_to"), F.lit(True).alias("to_follows"))
    seen = d.filter("fixed is null or fixed = 'follower'").join(of, "to").join(lead, "to_to", "left")
    go = (F.col("fixed") == "follower") | (F.col("to_fixed") == "leader") | (
        F.col("to_fixed").isNull() & F.col("to_follows").isNull() & ~F.col("coin") & F.col("to_coin"))
    f = seen.filter(F.coalesce(go, F.lit(False))).select("id", "to", "d", "dto", F.col("mutual").alias("first"), (
        2.0 * total * F.col("w") / F.col("d")).alias("most"), "w")
    rank = F.when(F.col("first"), F.lit(-1_000_000)).otherwise(
        -F.floor(F.log2("most") * 4).cast("long") * 16 + F.pmod(F.xxhash64("id", F.lit(level)), F.lit(16)))
    f = cut_lineage(f.withColumn("rank", rank))
    upto = Window.partitionBy("to").orderBy("rank")
    before = f.groupBy("to", "rank").agg(F.sum("d").alias("here")).select("to", "rank", F.sum("here").over(upto).alias("upto"))
    fits = F.expr(f"cast({2 * total} as decimal(19,0)) * cast(w as decimal(19,0)) > cast(d as decimal(19,0)) * cast(dto + upto - d as decimal(19,0))")
    return f.join(before, ["to", "rank"]).filter(F.col("first") | fits).select("id", F.col("to").alias("community"))


def modular_communities(nodes: DataFrame, pairs: DataFrame, tell: list | None = None) -> DataFrame:
    """(id, community): groups of high modularity, named after their smallest member.

    Level by level, groups merge where that raises modularity (:func:`_merges`)
    and the weighted graph is contracted to the groups, so each level works on
    fewer rows.  Every level raises modularity, in whole numbers, or the loop
    ends: with no gain left there is nothing to merge.  ``tell`` collects
    (groups, gain) of each level for a caller that wants to see them.

    Nodes without links stay alone; repeated pairs add weight, loops count as
    inner links; ends that are no node and null ends are left out.
    """
    known = nodes.select(F.col("id").alias("u")).distinct()
    e = pairs.filter("u is not null and v is not null").join(known, "u", "left_semi").join(known.withColumnRenamed("u", "v"), "v", "left_semi")
    links = cut_lineage(weighted(e))
    label = cut_lineage(links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).distinct().withColumn("community", F.col("id")))
    total = links.agg(F.sum("w")).first()[0]
    level, last = 0, None
    while total:
        sizes = cut_lineage(strengths(links))
        inside, squares = sizes.agg(F.sum("inside"), F.sum(_whole("d") * _whole("d"))).first()
        gain = 4 * total * inside - int(squares)
        if last is not None:
            if gain <= last:
                raise AssertionError(f"level {level} lowered modularity: {last} to {gain}")
            if tell is not None:
                tell.append((sizes.count(), gain))
        last = gain
        moved = cut_lineage(_merges(links, sizes, total, level))
        if moved.isEmpty():
            break
        links = cut_lineage(weighted(links, moved))
        label = cut_lineage(_through(label.withColumnRenamed("community", "c"), moved, "c").withColumnRenamed("c", "community"))
        level += 1
    names = label.groupBy("community").agg(F.min("id").alias("name"))
    found = label.join(names, "community").select("id", F.col("name").alias("community"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
