"""Set-based jobs against small brute force, files, sinks and streams."""

import itertools
import json
import math
import os
import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.operators import changes, coverage, graph, ledgers, links, parsing, rollups, search, substring, vectors
from folioscope.session import numbered, shared_dir
from folioscope.sources import files, sinks
from folioscope.streaming import jobs


def test_numbered_matches_plain_order(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", i) for i in range(2000)]
    rnd.shuffle(rows)
    d = numbered(spark.createDataFrame(rows, "k string, v long").repartition(7), ["k"], [F.col("v")])
    got = {(r["k"], r["v"]): r["rn"] for r in d.collect()}
    for k in {r[0] for r in rows}:
        for n, v in enumerate(sorted(v for kk, v in rows if kk == k), 1):
            assert got[(k, v)] == n


def test_fixed_parts(spark):
    d = rollups.fixed_parts(spark.range(60).select(F.lit("a").alias("k"), "id"), ["k"], [F.col("id")], 25)
    assert sorted((r["part"], r["n"], r["p"]) for r in d.groupBy("part").agg(F.count("*").alias("n"), F.max("parts").alias("p")).collect()) == [(1, 25, 3), (2, 25, 3), (3, 10, 3)]


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    for n, m in ((40, 25), (60, 70), (30, 0)):
        ids = [f"n{i:03d}" for i in range(n)]
        es = [tuple(rnd.sample(ids, 2)) for _ in range(m)] + [(ids[0], x) for x in ids[1:4] if m]
        parent = {i: i for i in ids}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in es:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = graph.components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(es, "u string, v string"))
        assert {r["id"]: r["component"] for r in got.collect()} == {i: find(i) for i in ids}


def test_long_chain_components(spark):
    es = [(f"{i:04d}", f"{i + 1:04d}") for i in range(200)]
    d = graph.components(spark.createDataFrame([(f"{i:04d}",) for i in range(201)], "id string"), spark.createDataFrame(es, "u string, v string"))
    assert d.select("component").distinct().collect()[0][0] == "0000" and d.select("component").distinct().count() == 1


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_neighbours_prune_exactly(spark, monkeypatch):
    """Many cells, copies and titles: same lists as all-pairs scoring."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rnd = random.Random(5)
    centres = [unit([rnd.gauss(0, 1) for _ in range(8)]) for _ in range(6)]
    rows = []
    for i in range(160):
        c = centres[rnd.choice([0, 0, 0, 1, 2, 3, 4, 5])]
        v = unit([x + rnd.gauss(0, 0.25) for x in c])
        rows.append((f"id{i:03d}", v, f"word{i % 4} kind{i % 3}"))
    rows += [(f"copy{i:03d}", rows[0][1], rows[0][2]) for i in range(70)]  # a third is one note
    d = spark.createDataFrame(rows, "id string, vec array<double>, title string")
    got = {}
    for r in vectors.neighbours(d, k=8).collect():
        got.setdefault(r["note"], set()).add(r["other"])

    def score(a, b):
        cos = sum(x * y for x, y in zip(a[1], b[1]))
        ta, tb = set(a[2].split()), set(b[2].split())
        sim = len(ta & tb) / 2
        return min(1.0, cos + (0.3 * sim if sim >= 0.5 else 0)), cos, sim
    for a in rows:
        best = sorted(((*map(lambda x: round(x, 9), score(a, b)), b[0]) for b in rows), reverse=True)
        want = {b[3] for b in [x for x in best if x[0] >= 0.72][:8] if b[3] != a[0]}
        assert got.get(a[0], set()) == want, a[0]


def test_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rnd = random.Random(9)
    rows = [(f"i{i:02d}", unit([rnd.gauss(0, 1) for _ in range(3)])) for i in range(60)]
    got = {(r["a"], r["b"]) for r in vectors.pairs(spark.createDataFrame(rows, "id string, vec array<double>")).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if sum(x * y for x, y in zip(a[1], b[1])) >= 0.72}
    assert got == want


def test_duplicate_report_needs_all_vectors(spark):
    d = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, vec array<double>")
    with pytest.raises(ValueError):
        vectors.duplicate_report(d, d)


def test_substring_join_is_exact(spark):
    docs = [("d1", "x report 12.md here"), ("d2", "xreport 12.md!"), ("d3", "report  12.md"), ("d4", "тест файл.pdf, да"), ("d5", "")]
    needles = ["report 12.md", "файл.pdf", "a", "re", "12.md here", "absent thing"]
    got = {(r["needle"], r["path"]) for r in substring.containing(spark.createDataFrame(docs, "path string, text string"),
                                                                  spark.createDataFrame([(n,) for n in needles], "needle string")).collect()}
    assert got == {(n, p) for n in needles for p, t in docs if n in t}


def test_search_must_hit_and_miss(spark):
    docs = spark.createDataFrame([
        ("notes/vector index.md", "approximate search over embeddings"), ("notes/tax form.md", "yearly return and deductions"),
        ("notes/long.md", "intro " * 400 + "the hidden beacon fact"), ("notes/pair.md", "green tea ceremony"), ("notes/split.md", "tea is green"),
        ("notes/none.md", "nothing of the kind")], "path string, text string")
    topics = spark.createDataFrame([("t1", "vector index"), ("t2", "green tea"), ("t3", "beacon")], "topic string, text string")
    c = search.candidates(search.lexical_scores(docs, topics))
    cases = spark.createDataFrame([("t1", "notes/vector index.md", True), ("t2", "notes/pair.md", True), ("t1", "notes/tax form.md", False),
                                   ("t3", "notes/long.md", True), ("t3", "notes/none.md", False)], "topic string, path string, must_hit boolean")
    assert search.must_and_must_not(c, cases).isEmpty()
    scores = {(r["topic"], r["path"]): r["score"] for r in c.collect()}
    assert scores[("t1", "notes/vector index.md")] == 10 and scores[("t2", "notes/pair.md")] == 2
    assert "beacon fact" in search.with_texts(c.filter("topic = 't3'"), docs, topics).select(search.evidence(F.col("text"), F.col("terms")).alias("e")).first()["e"]


def test_links_two_measures(spark):
    n = spark.createDataFrame([("a/one.md", "one.md", "a", "[[two]] [[Missing One]] `[[code]]` [[a]]"), ("b/two.md", "two.md", "b", "[[a/one|x]] [[pic.png]] [[...]]")],
                              "path string, base string, section string, text string")
    ls = parsing.wikilinks(n)
    assert {r["target"] for r in links.broken_links(ls, n).collect()} == {"Missing One", "pic.png", "..."}
    assert links.rough_broken_count(n).first()["rough_broken"] == 3
    assert links.orphans(ls, n).isEmpty()


def test_graph_replace_and_hyperedges(spark):
    node, edge = "id string, label string, file_type string, source_file string", "source string, target string, relation string, type string, label string, source_file string, nodes array<string>"
    n = spark.createDataFrame([("00000000-a", "A", "concept", "f1"), ("ns::b", "B", "", "f2"), ("b", "B2", "code", "f2")], node)
    e = spark.createDataFrame([("ns::b", "00000000-a", "r", None, None, "f2", None), ("b", "b2", "r", "", "", "f2", ["b", "00000000-a"]), ("b", "00000000-a", "r", "", "", "f2", None)], edge)
    nn, ne = graph.normalise(n, e)
    assert nn.count() == 2 and ne.count() == 2
    files_ = spark.createDataFrame([("f1",)], "source_file string")
    _, left = graph.replace_sources((nn, ne), files_, (nn.limit(0), ne.limit(0)))
    assert left.count() == 0
    empty = graph.components(nn.limit(0), spark.createDataFrame([], "u string, v string"))
    assert graph.component_stats(empty).first()["components"] == 0


def test_coverage_cases(spark):
    nfd = unicodedata.normalize("NFD", "Андрей йод.md")
    notes = spark.createDataFrame([("n1", "n1.md", "source: IMG_1.PNG\nsources:\n  - Андрей йод.md")], "path string, base string, text string")
    names = ["inbox/IMG_1.PNG", "inbox/IMG_2.PNG", "inbox/" + unicodedata.normalize("NFC", nfd)]
    census = spark.createDataFrame([(n, "0" * 64) for n in names], "name string, sha256 string")
    got = {r["name"]: r["covered_by"] for r in coverage.covered_inputs(census, notes).collect()}
    assert [got[n] for n in names] == ["name", None, "name"]
    with pytest.raises(ValueError):
        coverage.covered_inputs(census.limit(0), notes)


def test_gap_split(spark):
    units = spark.createDataFrame([("g1", ["/in/a", "/in/b", "/in/c"]), ("g2", ["/in/d"])], "group_id string, files array<string>")
    res = spark.createDataFrame([("g1", "note")], "group_id string, outcome string")
    un = spark.createDataFrame([("/in/b",), ("/in/c",), ("/in/d",)], "name string")
    assert {r["name"]: r["gap"] for r in coverage.split_gaps(units, res, un).collect()} == {"/in/b": "provenance", "/in/c": "provenance", "/in/d": "real"}


def test_decisions_keep_equal_names_apart(spark):
    state = spark.createDataFrame([("c/a.md", "read"), ("c/d.md", "work"), ("p/d.md", "work"), ("c/c.md", "forget"), ("../../etc/x", "forget"), ("c/zz.md", "work")], "id string, action string")
    have = spark.createDataFrame([("c/d.md",), ("p/d.md",), ("c/c.md",)], "path string")
    got = {r["id"]: (r["outcome"], r["target"]) for r in ledgers.decisions(state, have).collect()}
    assert got["c/d.md"][1] != got["p/d.md"][1] and got["../../etc/x"][0] == "invalid" and got["c/zz.md"][0] == "missing"


def test_quarantine_verdicts(spark):
    layer = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    v = lambda l, m, c: changes.quarantine_verdict(l, m, c).first()
    assert v(layer, layer, 2)["verdict"] == "holds" and v(layer, layer.filter("path = 'a'"), 1)["verdict"] == "appeared"
    shrunk = v(layer.filter("path = 'a'"), layer, 2)
    assert shrunk["verdict"] == "shrank" and shrunk["ceiling"] == 1
    assert v(layer, layer, 3)["verdict"] == "manifest-mismatch"


def room(spark):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex[:8]}"
    os.makedirs(path)
    return path


def test_files_and_caches(spark):
    root = room(spark)
    os.makedirs(f"{root}/02 A+b/graph-out-x")
    os.makedirs(f"{root}/.git")
    for name, text in (("02 A+b/" + unicodedata.normalize("NFD", "йод.md"), "# x"), ("top.md", "y"), (".git/z.md", "no"), ("02 A+b/graph-out-x/q.md", "no"), ("pic.png", "p")):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    got = {r["path"]: (r["base"], r["section"], r["text"]) for r in files.scan_notes(spark, root).collect()}
    assert got == {"02 A+b/йод.md": ("йод.md", "02 A+b", "# x"), "top.md": ("top.md", "", "y")}
    assert {r["name"] for r in files.inbox_census(spark, root).collect()} == {"top.md", "pic.png"}
    cache = room(spark)
    with open(f"{cache}/a.json", "w") as f:
        json.dump({"source_hash": "h", "source_ref": "r", "status": "extracted_for_note", "text_path": "a.txt"}, f)
    with open(f"{cache}/bad.json", "w") as f:
        f.write("{oops")
    with open(f"{cache}/a.txt", "w") as f:
        f.write("word " * 30)
    rows, corrupt = files.extract_records(spark, cache)
    assert [r["source_ref"] for r in rows.collect()] == ["r"] and corrupt.first()["corrupt"] == 1
    with open(f"{root}/g.json", "w") as f:
        json.dump({"nodes": [{"id": "a"}], "edges": [{"source": "x"}], "links": [{"source": "a", "target": "b"}]}, f)
    nodes, edges = files.read_graph(spark, f"{root}/g.json")
    assert nodes.count() == 1 and edges.first()["source"] == "a"


def test_sinks_are_idempotent(spark):
    root = room(spark)
    d = spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "fingerprint string, v int")
    assert sinks.append_new(d, f"{root}/t").first()["written"] == 2
    again = sinks.append_new(d, f"{root}/t").first()
    assert again["written"] == 0 and again["skipped"] == 3 and spark.read.parquet(f"{root}/t").count() == 2
    sinks.write_snapshot(d, f"{root}/s", "one")
    sinks.write_snapshot(d.limit(1), f"{root}/s", "two")
    sinks.write_snapshot(d, f"{root}/s", "one")
    assert spark.read.parquet(f"{root}/s").count() == 4
    assert sinks.write_report(d, f"{root}/r", "fingerprint", [F.col("v")], 1).count() == 2
    sinks.append_log(d, f"{root}/l")
    sinks.append_log(d, f"{root}/l")
    assert spark.read.json(f"{root}/l").count() == 6


def test_file_stream_retries_and_skips(spark):
    root = room(spark)
    os.makedirs(f"{root}/in")

    def put(name, text):
        with open(f"{root}/in/{name}", "w") as f:
            f.write(text)
    ready = {"flag": False}

    def extract(d):
        good = F.lit(ready["flag"]) | ~F.decode("content", "UTF-8").startswith("late")
        return d.withColumn("text", F.when(good, F.decode("content", "UTF-8")))

    def poll():
        jobs.run_available(jobs.unseen(jobs.file_stream(spark, f"{root}/in"), ["sha256"]), jobs.accept_new(extract, f"{root}/out"), f"{root}/cp")
        return sorted(r["text"] for r in spark.read.parquet(f"{root}/out/accepted").collect())
    put("a", "one")
    put("b", "late two")
    assert poll() == ["one"]
    put("c", "one")  # same content under another name
    ready["flag"] = True
    assert poll() == ["late two", "one"]


def test_replay_and_red_checks(spark):
    ev = spark.createDataFrame([("i", 1, 1, "staged"), ("i", 2, 2, "measured"), ("i", 3, 3, "staged"), ("j", 1, 4, "measured")], "item string, ts int, seq int, status string")
    assert {(r["item"], r["seq"]) for r in ledgers.illegal_steps(ev).collect()} == {("i", 3), ("j", 4)}
    assert {r["item"]: r["status"] for r in ledgers.item_states(ev).collect()} == {"i": "staged", "j": "measured"}


def test_no_plan_collects_or_crosses(spark):
    """The flagship plan: pruned scan, no Cartesian product, no Python."""
    import __spark_entry__ as entry
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in plan


def red_stream(spark, tmp_path, batches):
    """Feed each list of (check, minute, red) as one trigger; the state after the last."""
    folder, room = f"{tmp_path}/in", f"{tmp_path}/room"
    for rows in batches:
        df = spark.createDataFrame(rows, "check string, m long, red boolean").select(
            "check", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "red")
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        jobs.run_available(jobs.red_since(stream), jobs.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return jobs.latest_per_key(spark, f"{room}/out", ["check"]).drop("kind").distinct()


def test_silence_raises_the_failure(spark, tmp_path):
    """A check that falls silent while red is raised once others report later; a green in time is not."""
    day = 1440
    batches = [[("silent", 0, True), ("cured", 0, True), ("other", 0, False)], [("cured", 100, False), ("other", 5 * day, False)],
               [("other", 9 * day, False)], [("other", 20 * day, True)], [("other", 21 * day, False), ("late", 20 * day, True)]]
    red_stream(spark, tmp_path, [[(c, 10 * day + m, red) for c, m, red in b] for b in batches])
    out = spark.read.parquet(f"{tmp_path}/room/out")
    assert [tuple(r) for r in out.filter("kind = 'overdue'").select("check", F.unix_seconds("first_red_at")).collect()] == [("silent", 10 * day * 60)]
    assert out.filter("kind = 'state' and check = 'silent'").count() == 1


def test_red_since_keeps_every_red_after_the_green(spark, tmp_path):
    rnd = random.Random(3)
    many = [("busy", rnd.randint(0, 9000), rnd.random() < 0.9) for _ in range(5000)]
    late = [("late", 1, True), ("late", 5, True)]
    got = {r["check"]: r for r in red_stream(spark, tmp_path, [many[:2500] + late, many[2500:] + [("late", 3, False)]]).collect()}
    green = max(m for _, m, red in many if not red)
    reds = [m for _, m, red in many if red and m > green]
    minute = lambda t: None if t is None else int(t.timestamp() // 60)
    assert minute(got["busy"]["last_green"]) == green
    assert minute(got["busy"]["first_red_at"]) == (min(reds) if reds else None)
    assert minute(got["late"]["last_green"]) == 3 and minute(got["late"]["first_red_at"]) == 5


def test_overdue_checks_need_no_new_event(spark):
    states = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00'), ('b', TIMESTAMP'2024-01-02 12:00:00'), ('c', NULL) t(check, first_red_at)")
    assert [r["check"] for r in jobs.overdue(states, "2024-01-02 13:00:00", 1).collect()] == ["a"]


def test_communities_end_where_labels_repeat(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("c", "x")], "u string, v string")
    nodes = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    got = {r["id"]: r["community"] for r in graph.communities(nodes, pairs).collect()}
    assert got["a"] == got["b"] == got["c"] and got["z"] == "z" and set(got) == set("abcxyz")


def test_cosine_floor_comes_after_the_top_k(spark):
    members = spark.createDataFrame([("m1", [0.0, 1.0], "alpha beta"), ("m2", [1.0, 0.1], "other"), ("m3", [1.0, 0.2], "more")],
                                    "id string, vec array<double>, title string")
    probe = spark.createDataFrame([("p", [0.97, 0.24], "alpha beta")], "id string, vec array<double>, title string")
    got = [r["other"] for r in vectors.nearest(probe, members, 2, cos_floor=0.5).orderBy("pos").collect()]
    assert got == [r["other"] for r in vectors.nearest(probe, members, 2).filter("cos >= 0.5").orderBy("pos").collect()]


def test_other_errors_than_absence_are_raised(spark, tmp_path):
    bad = tmp_path / "table"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    df = spark.createDataFrame([("k", "f")], "key string, fingerprint string")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        sinks.append_new(df, str(bad))
