"""Folders, caches and logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.normal_form import nfc
from ..functions.text import compact

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

OBSERVATION = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("run_id", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("ext", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("engines_tried", T.ArrayType(T.StringType())),
    T.StructField("engine_used", T.StringType()), T.StructField("deep", T.BooleanType()), T.StructField("llm_extract_used", T.BooleanType()),
    T.StructField("sidecar_present", T.BooleanType()), T.StructField("c2pa_manifest", T.BooleanType())])
SEARCH_LOG = "ts timestamp, topic string, mode string, results int"
EXTRACT = "source_hash string, source_ref string, status string, text_path string"
_EDGE = "struct<source:string,target:string,relation:string,type:string,label:string,source_file:string,nodes:array<string>>"
GRAPH = f"nodes array<struct<id:string,label:string,file_type:string,source_file:string>>, links array<{_EDGE}>, edges array<{_EDGE}>"


def _relative(root: str):
    """Path under the root, percent-decoding undone."""
    root = root.rstrip("/").removeprefix("file:")
    return F.regexp_replace(F.expr("try_url_decode(replace(path, '+', '%2B'))"), r"^.*?\Q" + root + r"\E/", "")


def scan_notes(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", ".obsidian"),
               skip_prefixes: tuple[str, ...] = (rules.GRAPH_FOLDER,), skip_paths: tuple[str, ...] = ()) -> DataFrame:
    """notes(path, base, section, text, mtime, sha256) of all Markdown files.

    Names are brought to NFC here, once, so later joins are plain equi-joins.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root))
    d = raw.select(nfc(_relative(root)).alias("path"), F.decode("content", "UTF-8").alias("text"),
                   F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(dirs, lambda p: p.isin(*skip))
    for prefix in skip_prefixes:
        hidden = hidden | (F.size(F.filter(dirs, _starts(prefix))) > 0)
    for p in skip_paths:
        hidden = hidden | F.col("path").startswith(p.rstrip("/") + "/")
    return d.filter(~hidden).select("path", F.element_at(parts, -1).alias("base"), F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("section"),
                                    "text", "mtime", "sha256")


def _starts(prefix: str):
    return lambda p: p.startswith(prefix)


def inbox_census(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, bytes, mtime) of the regular, visible top-level files."""
    raw = spark.read.format("binaryFile").load(folder)
    name = nfc(F.regexp_extract(F.expr("try_url_decode(replace(path, '+', '%2B'))"), r"([^/]+)$", 1))
    return (raw.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"),
                       F.col("modificationTime").alias("mtime")).filter(~F.col("name").startswith(".")))


def extract_records(spark: SparkSession, folder: str, refs: list[str] | None = None, min_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """Extract cache joined to its text files, and the number of corrupt rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    rows = raw.select(F.decode("content", "UTF-8").alias("json"))
    rows = rows.select(F.try_parse_json("json").isNull().alias("bad"), F.from_json("json", EXTRACT).alias("r"))
    corrupt = rows.agg(F.count_if("bad").alias("corrupt"))
    good = rows.filter(~F.col("bad")).select("r.*").filter("status = 'extracted_for_note' and text_path is not null")
    if refs:
        good = good.filter(F.col("source_ref").isin(refs))
    texts = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
             .select(F.regexp_extract(F.expr("try_url_decode(path)"), r"([^/]+)$", 1).alias("_f"), F.decode("content", "UTF-8").alias("text")))
    out = good.withColumn("_f", F.regexp_extract("text_path", r"([^/]+)$", 1)).join(texts, "_f")
    out = out.filter(F.length(compact(F.col("text"), 100)) >= min_chars)
    return out.select("source_hash", "source_ref", "text_path", "text"), corrupt


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file; ``links`` wins over ``edges``."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*")
    edges = g.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    return nodes, edges


def read_log(spark: SparkSession, path: str, schema: str | T.StructType = OBSERVATION) -> DataFrame:
    """Append-only JSON lines with a given schema."""
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(name, text) of subtitle, feed or list files, one row per file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return raw.select(nfc(F.regexp_extract(F.expr("try_url_decode(path)"), r"([^/]+)$", 1)).alias("name"), F.decode("content", "UTF-8").alias("text"))


def web_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages (url, html) from Parquet; fetching is outside Spark."""
    return spark.read.parquet(path).select("url", "html")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
