"""Session settings and the two physical helpers every iterative job shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings a job here expects; all of them are ordinary Spark options, so a
#: cluster may override every one of them in spark-defaults.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = 8, app: str = "folioscope", **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "12g", "spark.folioscope.spread": str(cores) if str(cores).isdigit() else "0", **extra}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so it is refused.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Columns are compressed, later scans read those they need and know their
    size, and the plan starts anew: a checkpoint hands the constraints of its
    plan on, which in a loop grow until the driver holds little else.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixed_rows(df: DataFrame) -> DataFrame:
    """Checkpoint of ``df``, whose rows keep their partition and their place in it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other trouble with it raises."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores ahead of work that is long per row.

    After a small shuffle AQE joins partitions by their bytes; rows that each
    cost milliseconds would then run in a few tasks.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


def numbered(df: DataFrame, keys: list[str], order: list, out: str = "rn") -> DataFrame:
    """``row_number`` per key that never puts a whole key into one task.

    The rows are range-partitioned and sorted on (keys, order), so a key that
    holds a third of the table spreads over many partitions.  The sorted rows
    are written once to the checkpoint folder, which fixes their partition and
    position; a table of (key, partition) counts - as many rows as there are
    partitions plus keys - then gives every partition its offset.
    """
    key_cols = [F.col(k) for k in keys]
    fixed = fixed_rows(df.orderBy(*key_cols, *order)) if not keys else fixed_rows(
        df.repartitionByRange(*key_cols, *order).sortWithinPartitions(*key_cols, *order))
    placed = fixed.withColumn("_pos", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright(F.col("_pos"), 33))
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    counts = placed.groupBy(*keys, "_pid").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(n) for k, n in named.items()], F.col("_pid").alias("_p"), "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    on = F.col("_pid") == F.col("_p")
    for k, n in named.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return placed.join(offsets, on).select(
        *df.columns, (F.col("_pos") - F.col("_first") + F.col("_off") + 1).alias(out))


def require_rows(df: DataFrame, what: str, allow_empty: bool = False) -> DataFrame:
    """An empty input is an error, never a pass."""
    if not allow_empty and df.isEmpty():
        raise ValueError(f"{what}: no input rows (pass allow_empty=True to accept that)")
    return df
