"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import shared_dir


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's own switch: shuffle files go when the query that made them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch at most: buffers on both sides of a Python worker hold a batch of whole texts, and keep their size.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST = 1000


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once, one folder for each value of ``by``, and read it back.

    A costly pass over the texts then runs once however often its (narrow)
    result is used, and a lost executor only costs a re-read.  Nothing reads
    the shuffle files of the write again, so they are given up at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {CLEAN: spark.conf.get(CLEAN, "false"), BATCH: spark.conf.get(BATCH, "10000")}
    rows = int(before[BATCH])
    spark.conf.set(CLEAN, "true")
    spark.conf.set(BATCH, str(min(rows, MOST) if rows > 0 else MOST))
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stored` that no later step reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so Python objects of few texts live at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; a null text is an empty one."""
    return [t or "" for t in column.to_pylist()]


def map_texts(docs: DataFrame, keep: list[str], fn: Callable, fields: list[T.StructField], rows: int = 512) -> DataFrame:
    """``fn(texts, batch) -> list of arrow arrays`` on slices of (keep..., text).

    The columns ``keep`` pass through; ``fields`` describe what fn returns.
    """
    src = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = T.StructType([src.schema[k] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = fn(texts_of(b.column(len(keep))), b)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + out, names=schema.names)

    return src.mapInArrow(run, schema)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
