"""Substring joins against a plain search."""

from pyspark.sql import functions as F

from folioscope.operators import substring as S


def test_containing_is_a_plain_search(spark):
    names = [f"file-{i}.pdf" for i in range(300)] + ["a", "ab", "abc", "scan 12.png", "tail-of-the-name-7", "x" * 40, "é"]
    texts = [(f"p{i:03d}", f'see "inbox/file-{i}.pdf" and scan {i}.png abc{i} tail-of-the-name-{i} {"x" * (i % 60)} é') for i in range(120)]
    docs = spark.createDataFrame(texts, "path string, text string")
    needles = spark.createDataFrame([(n,) for n in names], "needle string")
    got = {(r.needle, r.path) for r in S.containing(docs, needles).collect()}
    assert got == {(n, p) for n in names for p, t in texts if n in t}


def test_names_that_begin_alike_do_not_meet_each_other(spark):
    """A gram that all names share would meet every word with every name."""
    names = spark.range(2000).select(F.concat(F.lit("file-"), F.col("id").cast("string"), F.lit(".pdf")).alias("part"))
    words = names.select(F.concat(F.lit('"inbox/'), "part", F.lit('"')).alias("word"))
    found = S.words_containing(words, names)
    assert found.count() == 2000
    met = [n for n in _rows(found) if n is not None]
    assert met and max(met) < 50 * 2000


def _rows(df):
    """Rows the joins of a query give out before their filters, from the counters of Spark."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if "Join" in name:
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out
