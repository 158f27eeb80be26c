"""Tags of list entries: each rule is tried once, and plain strings find what the patterns find."""

import re

from pyspark.sql import functions as F

from folioscope import rules
from folioscope.operators import parsing as P

TEXTS = ["", "AGENT memory", "an Kubernetes desk", "E-Commerce", "ecommerce", "e--commerce", "CI", "İD", "case  law", "case law", "plain x402"]


def test_rules_of_tags_stand_once_in_the_plan(spark):
    entries = spark.range(3).select(F.concat(F.lit("tool "), "id").alias("name"), F.lit("Legal").alias("category"), F.lit("search").alias("description"),
                                    F.array(F.lit("Python")).alias("languages"), F.array().cast("array<string>").alias("scopes"))
    d = P.list_tags(entries.repartition(2), ["x"]).select(F.explode("tags").alias("tag"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(concat(") == 1
    assert sorted({r["tag"] for r in d.collect()}) == sorted({"x", "legal", "python", *[
        "project_category_" + _slugged(rules.CATEGORIES[c]) for c in ("legal-trust", "knowledge-rag")]})


def _slugged(v):
    return re.sub("[^a-zа-я0-9]+", "_", v.lower()).strip("_")


def test_keywords_are_those_of_the_patterns(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["c"] for r in d.select("t", P.list_categories(F.col("t"), F.lit("none"), F.lit("zz")).alias("c")).collect()}
    for t in TEXTS:
        want = [rules.CATEGORIES[c] for p, c in rules.LIST_KEYWORD_FITS if re.search(p, f"none {t} zz", re.A)]
        want = list(dict.fromkeys(want))[:6] or [rules.CATEGORIES[rules.LIST_CATEGORY_DEFAULT]]
        assert got[t] == want, t
