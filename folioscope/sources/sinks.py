"""Where results go: reports, logs, snapshots, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, group: str, order: list, worst: int = 20) -> DataFrame:
    """Full result as Parquet under ``path/full``; returns the first ``worst``
    rows of each group for people.  Nothing is written unless this is called."""
    df.write.mode("overwrite").parquet(f"{path}/full")
    w = Window.partitionBy(group).orderBy(*order)
    short = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= worst).drop("_rn")
    short.write.mode("overwrite").json(f"{path}/short")
    return short


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshot(snap: DataFrame, path: str, snapshot_id: str) -> None:
    """Snapshots lie side by side, one partition each; a repeated id replaces
    its own partition only."""
    (snap.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_id").parquet(path))


def append_new(df: DataFrame, path: str, key: str = "fingerprint") -> DataFrame:
    """Append rows whose key the table does not hold yet; returns the counts."""
    from ..operators.changes import write_once
    from ..session import cut_lineage, path_exists
    spark = df.sparkSession
    existing = spark.read.parquet(path) if path_exists(spark, path) else df.limit(0)
    fresh, counts = write_once(df, existing, key)
    counts = cut_lineage(counts)
    cut_lineage(fresh).write.mode("append").parquet(path)
    return counts


def write_vectors(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)
