"""Secret scans through a trigram inverted index, in DataFrame operations only.

From the syntax of each rule's pattern a Boolean query over trigrams follows:
an OR of ANDs that every matching text fulfils.  Texts are indexed on the
trigrams the rules ask for - one posting (trigram, text) each - and a rule's
candidates are the texts whose postings complete one of its conjunctions.  Only
candidates are searched with the pattern itself.  A pattern without mandatory
trigrams is searched in every text during the pass that builds the index.

Texts are identified by two 64-bit hashes of their content, so copies share
postings, candidates and findings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import let

from .batches import stored

parser = re._parser  # the syntax tree of a pattern


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds every scan reports.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run is matched whole, so asking for its length in the pattern finds the same runs
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds with public, fixed formats on top of them.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

#: At most so many strings stand for a part of a pattern, and so many characters for a class.
STRINGS, CLASS = 128, 8

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; the empty AND holds for every text
ALWAYS: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    """Drop every AND that another one of the OR already covers."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(p: Query, q: Query) -> Query:
    return _least(frozenset(a | b for a in p for b in q))


def _grams(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _parts(tree) -> tuple[set[str] | None, Query]:
    """(all strings the tree can match, lower case, if few; the query it implies otherwise)."""
    strings, query, whole = {""}, ALWAYS, True
    for op, arg in tree:
        s, q = _part(str(op), arg)
        if s is not None and len(strings) * len(s) <= STRINGS:
            strings = {a + b for a in strings for b in s}
            continue
        query, whole = _and(_and(query, _grams(strings)), q), False
        strings = {""} if s is None else s
    return (strings, ALWAYS) if whole else (None, _and(query, _grams(strings)))


def _part(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower()}, ALWAYS
    if op == "IN":
        found: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < CLASS:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALWAYS
        return (found, ALWAYS) if len(found) <= CLASS else (None, ALWAYS)
    if op == "SUBPATTERN":
        return _parts(arg[3])
    if op == "BRANCH":
        sides = [_parts(t) for t in arg[1]]
        if all(s is not None for s, _ in sides):
            return set().union(*(s for s, _ in sides)), ALWAYS
        return None, _least(frozenset().union(*(q if s is None else _grams(s) for s, q in sides)))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = arg
        s, q = _parts(body)
        if low == 0:
            return (s | {""}, ALWAYS) if high == 1 and s is not None else (None, ALWAYS)
        if s is not None and low == high and len(s) ** low <= STRINGS:
            return reduce(lambda a, _: {x + y for x in a for y in s}, range(low), {""}), ALWAYS
        return None, q if s is None else _grams(s)
    if op.startswith("AT") or op == "ASSERT_NOT":
        return {""}, ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of lower-case trigrams that every text with a match fulfils."""
    strings, query = _parts(parser.parse(pattern))
    return query if strings is None else _grams(strings)


def spans(text: Column, rule: Rule) -> Column:
    """array of (start, kind number, end) of a rule's findings, in code points.

    The pieces between the matches and the matches themselves alternate, so
    running lengths give the places.
    """
    kind = RULES.index(rule)
    hits = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group)]
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits[0].alias("hit"), hits[1].alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.char_length(x["gap"])
        end = at + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        keep = F.coalesce(F.char_length(x["part"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], F.struct(
            at.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, step, lambda acc: acc["out"]))


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their text, null as empty, and its two content hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_k1", F.xxhash64("_text")).withColumn(
        "_k2", F.xxhash64(F.lit(1), F.col("_text")))


def findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(one narrow row for each row of docs, spans of the texts that have any).

    The first holds (doc_id, _k1, _k2), the second (_k1, _k2, spans), a row for
    each distinct text.
    """
    spark = docs.sparkSession
    queries = {r: trigram_query(r.pattern) for r in rules}
    full = [r for r in rules if frozenset() in queries[r]]
    ands = [(r, a) for r in rules if r not in full for a in sorted(queries[r], key=sorted)]
    vocabulary = sorted(set().union(*(a for _, a in ands)))
    seen = keyed(docs.select("doc_id", "text"))
    grams = let(F.lower("_text"), lambda low: F.filter(
        F.array(*map(F.lit, vocabulary)), lambda g: F.contains(low, g)))
    direct = [F.coalesce(spans(F.col("_text"), r), F.array().cast(NO_SPANS)) for r in full]
    first = stored(seen.select("doc_id", "_k1", "_k2", grams.alias("grams"),
                               (F.concat(*direct) if direct else F.array().cast(NO_SPANS)).alias("direct")), "index")
    # the inverted index: a posting for each trigram of each distinct text
    postings = first.select(F.explode("grams").alias("gram"), "_k1", "_k2").distinct()
    asked = [(g, rules.index(r), i, len(a)) for i, (r, a) in enumerate(ands) for g in sorted(a)]
    asked = F.broadcast(spark.createDataFrame(asked, "gram string, rule int, part int, need int"))
    whole = postings.join(asked, "gram").groupBy("_k1", "_k2", "rule", "part", "need").agg(
        F.count("*").alias("n")).filter("n = need")
    candidates = stored(whole.groupBy("_k1", "_k2").agg(F.collect_set("rule").alias("rules")), "candidates")
    # one trigram of each AND tells which texts need not travel to the join
    hints = sorted({min(a) for _, a in ands})
    possible = seen.filter(let(F.lower("_text"), lambda low: F.exists(
        F.array(*map(F.lit, hints)), lambda g: F.contains(low, g))))
    checked = possible.join(candidates, ["_k1", "_k2"]).select("_k1", "_k2", F.concat(*[
        F.coalesce(F.when(F.array_contains("rules", rules.index(r)), spans(F.col("_text"), r)), F.array().cast(NO_SPANS))
        for r in rules if r not in full]).alias("spans"))
    every = checked.unionByName(first.select("_k1", "_k2", F.col("direct").alias("spans"))).filter("size(spans) > 0")
    # copies found the same spans; the two searches of a text found different kinds
    found = every.select("_k1", "_k2", F.explode("spans").alias("s")).distinct().groupBy("_k1", "_k2").agg(
        F.array_sort(F.collect_list("s")).alias("spans"))
    return first.select("doc_id", "_k1", "_k2"), found


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    ``spans`` lists kind:start:end of all findings by start, then kind in the
    order of RULES; the hash covers those of the base kinds, joined likewise.

    A null text is an empty one and has no findings; repeated rows find the
    same; null ids keep their rows; an empty table gives no rows; columns
    besides doc_id and text are not read.
    """
    rows, found = findings(docs)
    got = rows.join(found, ["_k1", "_k2"], "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("s"))
    base = F.filter("s", lambda s: s["kind"] < len(BASE))

    def number(kind: int) -> Column:
        return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")

    return got.select("doc_id", *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
                      F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every finding replaced by its kind in brackets.

    Overlapping findings become one replacement.  A null text stays null;
    ``n_chars``, where there is one, is the new length.  All columns stay.
    """
    _, found = findings(docs)
    # the rows travel as one value, so no column of theirs can meet a name used here
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    seen = keyed(held).join(found.withColumnRenamed("spans", "_spans"), ["_k1", "_k2"], "left")
    names = F.array(*[F.lit(f"[{r.kind}]") for r in RULES])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(
            acc["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("_spans", start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.char_length("_text"))))
    text = F.when(F.col("_spans").isNotNull(), masked).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("_spans").isNotNull(), F.char_length(text)).otherwise(F.col("_row.n_chars")).cast(
        docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return seen.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])
