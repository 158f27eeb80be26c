"""A training corpus in five stages, each of them a pass of one operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.batches import stored
from folioscope.llm.jaccard_join import near_duplicates
from folioscope.llm.mixing import mix
from folioscope.llm.packing import pack
from folioscope.llm.queries import table, tokenizer
from folioscope.llm.secrets import redact
from folioscope.llm.toxicity import toxicity_scores


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``; rows without an id stay."""
    return docs.join(ids.filter("doc_id is not null").distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels of all folds but one."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, stored(scores.filter("predicted = 1").select("doc_id"), "toxic"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a text ``_key`` for each document: the same for rows of one id and text, in the
    order of ids; rows without an id come last, one document for each text."""
    mark = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return docs.withColumn("_key", F.concat(F.coalesce(place, F.lit("~")), mark))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates one row stays, of the document with the smallest id.

    A repeated row (same id and text) is one document, different texts under
    one id are several, and a text without an id is one that comes after all
    ids.  Rows without an id and without words are linked with nothing and stay."""
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if counts.filter("doc_id is null or n > 1").isEmpty():
        groups = near_duplicates(docs)
        return _without(docs, stored(groups.filter("doc_id <> component_id").select("doc_id"), "near-duplicates"))
    keyed = _keyed(docs)
    groups = stored(near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")), "groups").withColumnRenamed("doc_id", "_key")
    left = keyed.join(groups.filter("_key <> component_id").select("_key").distinct(), "_key", "left_anti")
    bare = groups.filter("n_shingles = 0 and startswith(_key, '~')").select("_key").distinct()
    once = left.join(bare, "_key", "left_anti").dropDuplicates(["_key"])
    return once.unionByName(left.join(bare, "_key", "left_semi")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, secrets in it give way to the name of their kind."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a row without an id as often as it stands.

    Rows that repeat a document share its copies evenly."""
    rates = stored(mix(docs.filter("doc_id is not null")).groupBy(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.round(F.avg("copies")).alias("copies")), "copies")
    copies = F.when(F.col("doc_id").isNull(), 1).otherwise(F.coalesce("copies", F.lit(0)))
    # the rows travel as one value, so no column of theirs can meet a name used here
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source")
    on = (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    taken = held.join(rates, on, "left").select("_row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_times"))
    return taken.select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return pack(docs, tokenizer())


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_duplicate), ("secret scans", secrets),
          ("mixing to target weights", mixture), ("packing", packing)]

#: A trained classifier and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i + 1}")
    return docs
