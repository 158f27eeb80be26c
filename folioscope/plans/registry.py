"""Named queries: a Spark plan and, where SQL can say it, an oracle for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def wrap(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate plan name {name}")
        PLANS[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as it lies.

    A session that reads single-file samples may set ``spark.folioscope.spread``
    to deal the rows of text tables out to so many partitions.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = int(spark.conf.get("spark.folioscope.spread", "0"))
    return df.repartition(parts) if parts and name in ("documents", "pages") else df
