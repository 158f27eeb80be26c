"""Hand-written cases for parsing, gates and rewriting."""

import pytest
from pyspark.sql import functions as F

from folioscope import rules
from folioscope.functions import frontmatter as fm
from folioscope.functions import text as T
from folioscope.functions import urls as U
from folioscope.operators import gates as G
from folioscope.operators import ledgers
from folioscope.operators import parsing as P
from folioscope.operators import readability as R


def one(spark, expr, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,error", [
    ("---\na: 1\nb: [x, \"y z\"]\nc:\n  - p\n  - 'q'\n---\nbody", None), ("# no head", "no_fence"), ("---\na: 1\nbody", "not_closed"),
    ("---\na: 1\na: 2\n---\n", "duplicate_key"), ("---\na: 1\n!!\n---\n", "unreadable_line"), ("---\n- x\n---\n", "unreadable_line")])
def test_head_errors(spark, text, error):
    row = fm.with_frontmatter(spark.createDataFrame([("n", text)], "path string, text string")).first()
    assert row["fm_error"] == error
    if error is None:
        got = {k: (v["is_list"], v["items"]) for k, v in row["fm"].items()}
        assert got == {"a": (False, ["1"]), "b": (True, ["x", "y z"]), "c": (True, ["p", "q"])}
        assert row["body"] == "body"


@pytest.mark.parametrize("old,value,keep", [
    ("подтверждён", "подтвержден", False), ("true", "подтвержден", True), ("непроверяемо-методом (видео)", "непроверяемо-методом", True),
    ("непроверяемо-методомX", "не-проверялось", True), ("", "не-проверялось", False), ("false", "не-проверялось", False),
    ("2024-01-01", "не-проверялось", True), ("частично подтверждено", "не-проверялось", True), ("expanded with public sources", "подтвержден", True)])
def test_verified_mapping(spark, old, value, keep):
    got = one(spark, P.mapped_verified(F.col("c0")), old)
    assert (got["value"], got["keep_legacy"]) == (value, keep)


@pytest.mark.parametrize("old,tool,want", [("security-tool-reference", False, "reference"), ("weekly-digest", False, "synthesis"),
                                           ("prompt", False, "concept"), ("decision", False, "concept"), ("x", True, "tool-card")])
def test_type_mapping(spark, old, tool, want):
    assert one(spark, P.mapped_type(F.col("c0"), F.lit(tool)), old) == want


@pytest.mark.parametrize("text,hit", [("для Фемиды важно", True), ("в Фемиде", True), ("в суде", False)])
def test_declined_names(spark, text, hit):
    slugs = one(spark, P.project_slugs(F.col("c0")), "## Фемида\n## Большой проект «Орион» Boreas")
    assert {"фемида", "фемид", "орион", "boreas"} <= set(slugs)
    assert any(s in text.lower() for s in slugs) is hit


@pytest.mark.parametrize("line,code", [("(function() {window.player={};", True), ("cfg.set({\"A\":1});", True),
                                       ("document.querySelector(\"#p\").play();", True), ("Plain prose with words and commas, nothing else.", False)])
def test_code_filter(spark, line, code):
    assert one(spark, T.looks_like_code(F.col("c0")), line) is code


@pytest.mark.parametrize("url,public", [("https://a.org/x", True), ("http://localhost/x", False), ("http://x.local/", False), ("http://10.1.1.1/", False),
                                        ("http://172.20.0.1", False), ("http://8.8.8.8/", True), ("http://[fe80::1]/", False), ("ftp://a.org", False),
                                        ("http://999.1.1.1/", False), ("http://[2606:4700::1]/", True), ("http://[::ffff:10.0.0.1]/", False)])
def test_public_addresses(spark, url, public):
    assert one(spark, U.is_public(F.col("c0")), url) is public


def test_mask_keeps_offsets(spark):
    text = "a `x` b\n```\n[[no]]\n```\n[[yes]] ```open"
    got = one(spark, T.mask_code(F.col("c0")), text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert "[[no]]" not in got and "[[yes]]" in got and got.endswith("  `open")


@pytest.mark.parametrize("target,kind", [("...", "placeholder"), ("x\\", "escaped-link"), ("a.PNG", "file-or-asset"), ("a/b", "path-link"),
                                         ("Agent OS", "concept"), ("what, then?", "missing-note")])
def test_link_kinds(spark, target, kind):
    assert one(spark, P.link_kind(F.col("c0")), target) == kind


NOTE = "---\nsource: x\ntype: concept\nverified: подтвержден\nsubject: world\n---\n# Т\nТекст про проект на русском языке.\n## Как это поможет мне\nДля Атласа.\n## Достоверность\n{}\n"


def rules_of(spark, text, **kw):
    d = spark.createDataFrame([("s/n.md", text)], "path string, text string")
    return {r["rule"] for r in G.spec_failures(d, ["атлас"], **kw).collect()}


def test_spec_gate_red_and_green(spark):
    assert rules_of(spark, NOTE.format("2024-01-01")) == set()
    assert rules_of(spark, NOTE.format("2024-01-01"), changed=True) == {"categories-missing"}
    assert rules_of(spark, NOTE.format("").replace("world", "moon")) == {"subject", "trust-empty"}
    assert "source" in rules_of(spark, NOTE.format("ok").replace("source: x", "note: `source: y`"))
    assert "help-missing" in rules_of(spark, NOTE.format("ok").replace("Как это поможет мне", "Зачем"))


def test_empty_input_raises(spark):
    with pytest.raises(ValueError):
        G.spec_failures(spark.createDataFrame([], "path string, text string"), ["a"])
    with pytest.raises(ValueError):
        G.in_sections(spark.createDataFrame([("x", "01 A")], "path string, section string"), ["77"])


def test_freshness(spark):
    d = spark.createDataFrame([("a", NOTE.format("Сверено 2026-01-01")), ("b", NOTE.format("верю")), ("c", "# x")], "path string, text string")
    assert {r["path"]: r["rule"] for r in G.freshness_failures(d).collect()} == {"b": "no-freshness-mark", "c": "no-trust-block"}


@pytest.mark.parametrize("path,head,want", [
    ("05 Кино/n.md", "title: x", "text"), ("02 Здоровье/n.md", "title: x", "personal"), ("01 Право и Юриспруденция/n.md", "data_class: public", "pd"),
    ("05 Кино/n.md", "data_class: personal", "personal"), ("05 Кино/n.md", "sources:\n  - agent-research--client-law--1", "pd"),
    ("05 Кино/n.md", "projects: [client-law]", "pd"), ("05 Кино/n.md", "section: 77 Нет", None), ("05 Кино/n.md", None, "personal")])
def test_sensitivity(spark, path, head, want):
    text = "plain" if head is None else f"---\n{head}\n---\nbody"
    row = G.sensitivity(spark.createDataFrame([(path, text)], "path string, text string")).first()
    assert row["class"] == want and row["undetermined"] is (want is None)


def test_preservation(spark):
    before = "---\na: 1\n---\n# T\nСтоит отметить, что 42 ноты на https://a.org/x и [[Link]].\n> quote 7\n"
    rows = [("same", before, before), ("lost", before, before.replace("42", "много").replace("[[Link]]", "Link")), ("quote", before, before.replace("> quote", "quote"))]
    got = {r["id"]: {(x["kind"], x["sample"]) for x in r["lost"]} for r in R.preservation(spark.createDataFrame(rows, "id string, before string, after string")).collect()}
    assert got["same"] == set()
    assert ("number", "42") in got["lost"] and ("wikilink", "[[Link]]") in got["lost"]
    assert got["quote"] == {("byte", "> quote 7")}


def test_rewrite_keeps_case_and_facts(spark):
    got = one(spark, P.rewrite_stock_phrases(F.col("c0")), "Данный метод не является новым. В современном мире это данные.")
    assert got == "Этот метод не новым. это данные."


def test_paste_trace_decides_at_once(spark):
    d = R.with_phrases(spark.createDataFrame([("a", "see turn3search5"), ("b", "чисто")], "path string, text string"))
    assert {r["path"]: r["v"] for r in d.select("path", R.marker_verdict(d).alias("v")).collect()} == {"a": "pasted", "b": "clean"}


def test_anchors_are_in_every_match(spark):
    """A pattern behind an anchor must not match texts without the anchor."""
    from folioscope import rules
    assert set(rules.BAN_ANCHORS) == {n for n, _ in rules.HARD_BANS}
    assert set(rules.LAYER_ANCHORS) == {n for n, _ in rules.LAYER_MARKERS}
    samples = ["Не просто идея, а план", "не только тут, но и там", "данную тему", "игра, уверенностью", "таким образом", "играют ключевую роль",
               "посмотрим чуть поближе", "вот тут начинается самое интересное", "выводит на новый уровень", "от дня до ночи", "src=\"x\" IMG_12 raw ocr draft-local"]
    d = spark.createDataFrame([(s,) for s in samples], "t string")
    for n, p in rules.HARD_BANS:
        bad = d.filter(F.lower("t").rlike("(?U)" + p) & ~T.has_any(F.lower("t"), rules.BAN_ANCHORS[n]))
        assert bad.isEmpty(), n


def test_paths_the_vector_index_takes(spark):
    paths = {"a/b.md": True, "a/_b.md": False, "_a/b.md": False, "a/.git/b.md": False, "x/.obsidian/b.md": False, "a b_c/d_e.md": True,
             f"v/{rules.GRAPH_FOLDER}/b.md": False, f"{rules.GRAPH_FOLDER}.md": True, ".git.md": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.ok for r in df.select("path", P.embedded_path(F.col("path")).alias("ok")).collect()} == paths


def test_chunks_after_a_stop_keep_their_earlier_status(spark):
    rows = [(1, 0, "a", "accepted", 2, None), (1, 1, "b", "insufficient_quota", 3, None), (1, 2, "b", "accepted", 4, "invalid"),
            (1, 3, "c", "accepted", 5, "invalid"), (1, 4, "d", "accepted", 6, None), (2, 0, "a", "accepted", 1, "invalid")]
    got = ledgers.chunk_ledger(spark.createDataFrame(rows, "run_id int, ord int, parent string, status string, files int, prior string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "accepted", 1, 2), (1, "insufficient_quota", 1, 3), (1, "invalid", 1, 5), (1, "not_attempted", 2, 10), (2, "accepted", 1, 1)]


def test_why_a_run_does_not_count(spark):
    obs = [("good", 1, True, "processed"), ("none", 1, True, "processed"), ("local", 1, True, "processed"), ("zero", 2, True, "processed"),
           ("flat", 0, False, "processed"), ("stuck", 1, True, "failed"), ("cached", 1, True, "cached"), ("shallow", 1, False, "processed"),
           ("skipped", 1, True, "processed")]
    synthesis = [("good", False, False, 3, 3, 1), ("local", False, True, 3, 3, 1), ("zero", False, False, 0, 0, 0), ("shallow", False, False, 1, 1, 1),
                 ("skipped", True, False, 0, 2, 1)]
    got = ledgers.run_verdicts(spark.createDataFrame(obs, "run_id string, tier int, deep boolean, status string"), spark.createDataFrame(
        synthesis, "run_id string, skipped boolean, degraded boolean, atomized int, written int, enriched int"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("local", "synthesis-degraded"), ("none", "no-atoms"), ("none", "nothing-enriched"), ("none", "synthesis-missing"),
        ("shallow", "deep-missing"), ("skipped", "no-atoms"), ("stuck", "nothing-processed"), ("zero", "no-atoms"), ("zero", "nothing-enriched")]


def test_derived_folders_among_notes(spark):
    files = ["graph-out/x.json", "graph-out/a/graph-out/y", "a/graph-out/x.json", "a/graph-out/b/graph-out/c.md", "a/b/graph-out-old/c.md", "a/.git/graph-out/c",
             "a/graph-out.md", "a/b.md"]
    got = G.nested_runtime(spark.createDataFrame([(f,) for f in files], "path string"))
    assert sorted(r.path for r in got.collect()) == ["a/b/graph-out-old", "a/graph-out"]


def test_flat_costs_take_the_last_total_of_a_session(spark):
    rows = [("a", "s1", "2024-02-01", 1, 100), ("a", "s1", "2024-02-01", 3, 500), ("a", "s1", "2024-02-01", 4, None), ("a", "s2", "2024-02-02", 1, 40),
            ("a", "old", "2024-01-01", 9, 9000), ("b", "s1", "2024-02-01", 1, None), ("b", "s1", "2024-02-01", 2, None)]
    df = spark.createDataFrame(rows, "provider string, session string, started string, ts long, total long").withColumn("started", F.to_timestamp("started"))
    got = ledgers.flat_cost_rollup(df, 2e6, "2024-01-15", 1000)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 540, 1080.0, True), ("b", 0, 0.0, False)]


@pytest.mark.parametrize("verified, ready", [("подтвержден", True), ('"подтверждён"', True), ("true", True), ("не-проверялось", False)])
def test_strictly_ready_takes_both_spellings(spark, verified, ready):
    note = (f'---\nstatus: "final"\nverified: {verified}\nverification_status: "verified"\nenrichment: "external-research"\n---\n# Т\n'
            "Факты, добавленные до атомизации:\n- a\n- b\n## Источники\nПубличные источники:\n- https://a.example/1\n")
    assert spark.createDataFrame([(note,)], "text string").select(P.strictly_ready(F.col("text"))).first()[0] is ready
