"""Rounding against DuckDB and C."""

import duckdb
from pyspark.sql import functions as F

from folioscope.functions import numbers as N


def both(spark, sql, columns):
    """Rows of one DuckDB query, the first column put through Spark columns beside what DuckDB makes of it."""
    con = duckdb.connect()
    rows = con.execute(sql).fetchall()
    names = [d[0] for d in con.description]
    got = spark.createDataFrame(rows, names).select(*columns, *names[1:]).collect()
    return [r for r in got if r[:len(columns)] != r[1:1 + len(columns)]]


def test_half_even_and_half_up(spark):
    ratios = "(SELECT CAST(k / n AS DOUBLE) AS v FROM range(0, 400) t(k), range(1, 130) u(n))"
    assert both(spark, f"SELECT v, round_even(v, 3)::DOUBLE AS e FROM {ratios}", [N.half_even(F.col("v"), 3)]) == []
    assert both(spark, f"SELECT v, round(v, 6) AS e FROM {ratios}", [N.half_up(F.col("v"), 6)]) == []


def test_one_decimal_as_c_prints(spark):
    values = [10.25, 10.35, 0.25, 0.75, 0.05, 0.0, 100.0, 99.95, 11.25, 15.25, 29.949999999999996] + [k / n * 100 for n in range(1, 90) for k in range(n)]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.one_decimal(F.col("v")).alias("s"))
    assert [(r.v, r.s) for r in d.collect() if r.s != f"{r.v:.1f}"] == []


def test_stddev_as_running_mean(spark):
    sql = "SELECT l, list_stddev_pop(l) AS s FROM (SELECT list_transform(range(1, 40), lambda i: (i * k * 7919) % 53) AS l FROM range(0, 500) t(k))"
    assert both(spark, sql, [N.stddev_pop(F.col("l"))]) == []


def test_combined_title_score_at_ties(spark):
    """Titles of 64 words that share 41 and 51: the sixth digit is a tie."""
    from folioscope.plans import search_plans as S
    a = " ".join(f"w{i}" for i in range(64))
    rows = [(1, a), (2, " ".join(f"w{i}" for i in range(41)) + " " + " ".join(f"x{i}" for i in range(23)))]
    import tempfile
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert [tuple(r) for r in S.title_similarity(spark, d).collect()] == [(1, 0.640625, 0.792188)]
