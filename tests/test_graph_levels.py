"""Communities by modularity against plain sums over small graphs."""

import itertools
import random

from pyspark.sql import functions as F

from folioscope.operators import graph


def frames(spark, ids, es):
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(es, "u string, v string")


def plain_modularity(es, label):
    """Over all ordered pairs of nodes, as the definition says."""
    m, deg, adj = len(es), {}, {}
    for u, v in es:
        deg[u], deg[v] = deg.get(u, 0) + 1, deg.get(v, 0) + 1
        adj[u, v] = adj.get((u, v), 0) + 1
        adj[v, u] = adj.get((v, u), 0) + 1
    return sum(adj.get((a, b), 0) - deg[a] * deg[b] / (2 * m) for a in deg for b in deg if label[a] == label[b]) / (2 * m)


def blocks(rnd, sizes, inside, across):
    ids = [f"{b}{i:02d}" for b, n in zip("abcdefgh", sizes) for i in range(n)]
    es = {tuple(sorted((x, y))) for x, y in itertools.combinations(ids, 2) if rnd.random() < (inside if x[0] == y[0] else across)}
    return ids, sorted(es)


def test_levels_raise_modularity_and_reach_label_propagation(spark):
    ids, es = blocks(random.Random(2), (12, 10, 9, 14), 0.5, 0.03)
    nodes, pairs = frames(spark, [*ids, "lonely"], es)
    told = []
    got = {r["id"]: r["community"] for r in graph.modular_communities(nodes, pairs, told).collect()}
    assert got["lonely"] == "lonely" and set(got) == {*ids, "lonely"}
    assert all(got[c] == c and c == min(i for i in got if got[i] == c) for c in got.values())
    gains = [g for _, g in told]
    assert len(gains) > 1 and gains == sorted(set(gains))
    q = plain_modularity(es, got)
    assert abs(q - float(gains[-1]) / (4 * len(es) ** 2)) < 1e-9
    labels = {r["id"]: r["community"] for r in graph.communities(nodes, pairs).collect()}
    planted = plain_modularity(es, {i: i[0] for i in ids})
    print("modularity", q, "label propagation", plain_modularity(es, labels), "planted", planted)
    assert q >= plain_modularity(es, labels) - 1e-12 and q >= 0.9 * planted


def test_best_partition_of_small_graphs(spark):
    def partitions(xs):
        if not xs:
            yield []
            return
        for rest in partitions(xs[1:]):
            for i in range(len(rest)):
                yield rest[:i] + [[xs[0], *rest[i]]] + rest[i + 1:]
            yield [[xs[0]], *rest]
    clique = lambda xs: list(itertools.combinations(xs, 2))
    two = clique("abcd") + clique("efgh") + [("d", "e")]
    ring = [(a, b) for a, b in zip("abcdef", "bcdefa")]
    for es, floor in ((two, 1.0), (ring, 0.75)):
        ids = sorted({x for e in es for x in e})
        best = max(plain_modularity(es, {i: n for n, p in enumerate(ps) for i in p}) for ps in partitions(ids))
        got = {r["id"]: r["community"] for r in graph.modular_communities(*frames(spark, ids, es)).collect()}
        assert plain_modularity(es, got) >= floor * best - 1e-12


def test_star_and_chain_contract_in_few_levels(spark):
    leaves = [f"x{i:03d}" for i in range(60)]
    chain = [f"y{i:03d}" for i in range(60)]
    es = [("hub", x) for x in leaves] + list(zip(chain, chain[1:]))
    told = []
    got = {r["id"]: r["community"] for r in graph.modular_communities(*frames(spark, ["hub", *leaves, *chain], es), told).collect()}
    # the chain falls into pieces of its own; no level goes leaf by leaf
    assert len({got[x] for x in ["hub", *leaves]}) == 1 and 3 < len({got[y] for y in chain}) < 20
    assert len(told) <= 14


def test_modularity_without_links_and_with_odd_ones(spark):
    nodes, none = frames(spark, ["a", "b"], [])
    assert {r["id"]: r["community"] for r in graph.modular_communities(nodes, none).collect()} == {"a": "a", "b": "b"}
    r = graph.modularity(graph.weighted(none)).first()
    assert (r["links"], r["gain"], r["modularity"]) == (0, 0, 0.0)
    nodes, odd = frames(spark, ["a", "b", "c"], [("a", "b"), ("b", "a"), ("c", "c"), ("a", None), ("a", "gone")])
    assert {r["id"]: r["community"] for r in graph.modular_communities(nodes, odd).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_new_links_extend_stored_components(spark):
    rnd = random.Random(4)
    ids = [f"n{i:03d}" for i in range(60)]
    es = [tuple(rnd.sample(ids, 2)) for _ in range(50)]
    nodes, pairs = frames(spark, ids, es)
    whole = {r["id"]: r["component"] for r in graph.components(nodes, pairs).collect()}
    half = nodes.filter("id < 'n040'")
    old = pairs.filter("u < 'n040' and v < 'n040'").filter(F.crc32("u") % 2 == 0)
    later = pairs.unionByName(spark.createDataFrame([("n001", None), ("n001", "gone"), ("n002", "n002")], "u string, v string"))
    got = graph.extend_components(graph.components(half, old), nodes, later)
    assert {r["id"]: r["component"] for r in got.collect()} == whole
    same = graph.extend_components(got, nodes.limit(0), pairs.limit(0))
    assert {r["id"]: r["component"] for r in same.collect()} == whole


def test_equal_nodes_take_the_type_of_the_first(spark):
    rows = [("kb::a", "A", "code", "u", 9), ("kb::a", "A", "concept", "u", 4), ("kb::a", "A", "paper", "u", 7)]
    edges = spark.createDataFrame([], "source string, target string, relation string, type string, label string, source_file string")
    for order in (rows, rows[::-1]):
        nodes = spark.createDataFrame(order, "id string, label string, file_type string, source_file string, seq long")
        assert [tuple(r) for r in graph.normalise(nodes, edges)[0].collect()] == [("a", "A", "concept", "u")]
