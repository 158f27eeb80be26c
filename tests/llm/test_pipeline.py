"""The pipeline's stages on a small table, and its registration."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from folioscope.llm.queries import QUERIES

from .test_operators import SCHEMA, brute_components, prose


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert "pipeline" in entry.queries() and [n for n, _ in pipeline.STAGES][-1] == "packing"


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, prose(rng, 120) + (" nastyword" if i % 5 == 0 else "") + f" id{i}", "en", "ab"[i % 2], 0) for i in range(100)]
    rows += [(200 + i, rows[1][1] + " x", "en", "a", 0) for i in range(3)]
    rows += [(300, "token = abcdefgh and more", "en", "b", 25), (301, None, None, None, None), (None, "no id", "en", "b", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.toxicity(spark, docs, str(tmp_path))
    left = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(str(r[0]) for r in left) == sorted(str(r[0]) for r in rows if not (r[1] or "").count("nastyword"))
    single = pipeline.near_duplicate(spark, kept, str(tmp_path))
    _, top = brute_components([r for r in left if r[0] is not None])
    assert sorted(str(r["doc_id"]) for r in single.collect()) == sorted(
        [str(i) for i, t in top.items() if i == t] + ["None"])
    clean = pipeline.secrets(spark, single, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[300] == "[assign] and more"
    mixed = pipeline.mixture(spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = pipeline.packing(spark, mixed, str(tmp_path))
    assert packed.filter("start = 0").count() == mixed.count()
    assert pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 80) + f" {x}" for x in "abcd")
    rows = [(3, a), (3, a), (7, a + " x"), (7, b), (-2, c), (None, c), (None, d), (None, d), (9, b), (None, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    single = pipeline.near_duplicate(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    want = [(3, a), (7, b), (-2, c), (None, d), (None, None), (None, None), (8, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in single.collect()))) == sorted(map(repr, want))


def test_stages_keep_clashing_columns(spark):
    """Columns named like helpers of the stages come through as they were, and never show a secret."""
    names = ("_spans", "_text", "_k1", "_k2", "_row", "copies", "_id", "_source", "_times", "x")
    rows = [(i, f"token = secret{i}word and more words {i}", "en", "ab"[i % 2], 5) for i in range(12)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for stage in (pipeline.secrets, pipeline.mixture):
        plain, got = stage(spark, docs, ""), stage(spark, wide, "")
        assert got.columns == wide.columns
        assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[n] == f"kept {n}" for r in got.collect() for n in names)
    assert not any("secret3word" in str(r) for r in pipeline.secrets(spark, wide, "").collect())
