"""The registered queries of this package: thin views of the operators over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle as fim
from . import main_text, prefix_trie
from .batches import documents
from .jaccard_join import near_duplicates
from .mixing import mix
from .neighbours import nearest_neighbours
from .packing import pack
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .repeated_passages import repeated_passages
from .secrets import secret_spans
from .token_counts import token_counts
from .toxicity import toxicity_scores


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fim.fill_in_middle(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                    digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_token_counts, op4_secrets, op5_quality_classifier, op6_quality_rules,
                                op7_nearest_neighbours,
                                op8_toxicity, op9_jaccard_join, op10_repeated_passages,
                                op11_fill_in_middle, op12_conversation_trie, op13_html_extraction)}
ORACLES: dict[str, str] = {"op11_fill_in_middle": fim.ORACLE, "op12_conversation_trie": prefix_trie.ORACLE}
