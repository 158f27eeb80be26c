"""Rhythm, stock phrases and the cleanliness score; fact preservation.

All of it is arithmetic over one row: nothing here shuffles until a report
groups documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import numbers as N
from ..functions import text as T
from .parsing import hidden_path, rewrite_stock_phrases

SENTENCE_END = r"(?=\s)(?:(?<=[.!?…])\s+|\n+)"
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
# fixed values
BAND_CLEAN, BAND_EDIT = 85, 60
CV_TARGET, NOUN_VERB_TARGET = 0.45, 2.5


def with_rhythm(df: DataFrame, text: str = "text") -> DataFrame:
    """Sentence-length statistics of each text as columns."""
    t = F.col(text)
    d = T.staged(df, _s=F.filter(F.split(t, SENTENCE_END), lambda x: F.trim(x) != ""))
    d = T.staged(d, _n=F.filter(F.transform("_s", lambda x: T.count_of(x, WORD)), lambda n: n > 0))
    total = F.aggregate("_n", F.lit(0), lambda a, n: a + n)
    d = T.staged(d, sentences=F.size("_n"), words=total)
    mean = F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0)
    d = T.staged(d, _mean=mean)
    d = T.staged(d, _sd=F.when(F.col("sentences") > 1, N.stddev_pop(F.col("_n"))).otherwise(0.0))

    def share(test) -> Column:
        return F.when(F.col("sentences") > 0, N.half_even(F.size(F.filter("_n", test)) / F.col("sentences"), 3)).otherwise(0.0)
    return T.staged(
        d, mean_len=N.half_even(F.col("_mean"), 1), stdev_len=N.half_even(F.col("_sd"), 1),
        cv_len=N.half_even(F.when(F.col("_mean") > 0, F.col("_sd") / F.col("_mean")).otherwise(0.0), 3),
        min_len=F.coalesce(F.array_min("_n"), F.lit(0)), max_len=F.coalesce(F.array_max("_n"), F.lit(0)),
        short_share=share(lambda n: n < 5), long_share=share(lambda n: n > 25),
        em_dash=_literal_count(t, "—"), parentheses=_literal_count(t, "("),
        ellipsis=F.when(T.has_any(t, ["…", "..."]), T.count_of(t, r"…|\.\.\.")).otherwise(0),
        questions=F.size(F.filter("_s", lambda x: x.contains("?") & x.rlike(r"\?\s*$")))).drop("_s", "_n", "_mean", "_sd")


def _literal_count(low: Column, needle: str) -> Column:
    n = ((F.length(low) - F.length(F.replace(low, F.lit(needle)))) / len(needle)).cast("int")
    return F.when(low.contains(needle), n).otherwise(0)


def _first_seen(pattern: str) -> str:
    """A ban that asks for its first letter before it looks for an edge of a word."""
    group = re.match(r"\\b\(\?:([^()]*)\)", pattern)
    starts = [p[0] for p in group[1].split("|")] if group else re.findall(r"^\\b(\w)", pattern)
    return (f"(?=[{''.join(starts)}])" if starts else "") + pattern


def ban_hits(low: Column) -> Column:
    """array of (name, n) for every banned phrase in lower-case text."""
    def hits(t: Column) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.when(
            T.has_any(t, rules.BAN_ANCHORS[n]), T.count_of(t, "(?U)" + _first_seen(p))).otherwise(0).alias("n")) for n, p in rules.HARD_BANS])
    return F.filter(T.let(low, hits), lambda h: h["n"] > 0)


def marker_hits(low: Column) -> Column:
    """array of (category, marker, n); plain markers are counted by replacement,
    which is a byte scan, and only real patterns go through the regex engine."""
    rows = []
    for cat, items in rules.MARKERS.items():
        for m in items:
            n = F.when(T.has_any(low, rules.MARKER_ANCHORS[m]), T.count_of(low, "(?U)" + m[3:].lower())).otherwise(0) \
                if m.startswith("re:") else _literal_count(low, m.lower())
            rows.append(F.struct(F.lit(cat).alias("category"), F.lit(m.removeprefix("re:")).alias("marker"), n.alias("n")))
    return F.filter(F.array(*rows), lambda h: h["n"] > 0)


def with_phrases(df: DataFrame, text: str = "text") -> DataFrame:
    d = T.staged(df, _low=F.lower(F.col(text)))
    return T.staged(d, bans=ban_hits(F.col("_low")), markers=marker_hits(F.col("_low"))).drop("_low")


def _sum(arr: str, test) -> Column:
    return F.aggregate(F.filter(arr, test), F.lit(0), lambda a, h: a + h["n"])


def marker_verdict(df: DataFrame) -> Column:
    pasted = F.exists("markers", lambda h: h["category"] == rules.PASTE_CATEGORY)
    total = _sum("markers", lambda h: F.lit(True))
    return (F.when(pasted, "pasted").when(total <= 2, "clean").when(total <= 5, "suspicious").otherwise("generated"))


def with_score(df: DataFrame, noun_verb: Column | None = None) -> DataFrame:
    """Cleanliness 0-100 and band; needs the rhythm and phrase columns.

    The noun/verb term counts only when the caller has a ratio to give.
    """
    words = F.greatest(F.col("words"), F.lit(1))
    d = T.staged(df, hard=_sum("bans", lambda h: h["name"] != rules.DASH_BAN), ban_count=_sum("bans", lambda h: F.lit(True)),
                 pasted=_sum("markers", lambda h: h["category"] == rules.PASTE_CATEGORY),
                 soft=_sum("markers", lambda h: h["category"] != rules.PASTE_CATEGORY))
    dash = F.col("em_dash") / words * 100
    penalty = (F.when(F.col("hard") > 0, F.least(F.lit(45), 12 * F.col("hard"))).otherwise(0)
               + F.when(F.col("pasted") > 0, 60).otherwise(0)
               + F.least(F.lit(30.0), N.half_even(2 * (F.col("soft") / words * 100), 0))
               + F.when(dash > 2.0, F.least(F.lit(8.0), N.half_even(3 * (dash - 2.0), 0))).otherwise(0.0)
               + F.when((F.col("sentences") >= 4) & (F.col("cv_len") < CV_TARGET), F.least(F.lit(20.0), N.half_even(
                   (CV_TARGET - F.col("cv_len")) / CV_TARGET * 30, 0))).otherwise(0.0))
    if noun_verb is not None:
        penalty = penalty + F.when(noun_verb > NOUN_VERB_TARGET, F.least(F.lit(8.0), N.half_even(
            (noun_verb - NOUN_VERB_TARGET) / 0.5 * 3, 0))).otherwise(0.0)
    d = T.staged(d, score=F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty)).cast("int"))
    return d.withColumn("band", band(F.col("score")))


def band(score: Column) -> Column:
    return F.when(score >= BAND_CLEAN, "clean").when(score >= BAND_EDIT, "edit").otherwise("rewrite")


def scan(df: DataFrame, text: str = "text", noun_verb: Column | None = None) -> DataFrame:
    return with_score(with_phrases(with_rhythm(df, text), text), noun_verb)


def distribution(scored: DataFrame) -> DataFrame:
    """Bands, median and p10 by floor index, notes with bans.

    Scores take at most 101 values, so the percentile walks a table of value
    counts and no corpus-sized sort happens.
    """
    per = scored.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("ban_count") > 0).alias("b"),
                                      F.count_if(F.col("hard") > 0).alias("h"))
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)  # over <= 101 rows
    total = F.sum("n").over(Window.partitionBy())
    d = per.withColumn("cum", F.sum("n").over(upto)).withColumn("total", total)

    def pct(p: int) -> Column:
        at = F.least(F.col("total") - 1, F.floor(F.lit(p) / 100 * F.col("total")))
        return F.min(F.when(F.col("cum") > at, F.col("score")))
    return d.agg(F.sum("n").alias("notes"), pct(50).alias("median_score"), pct(10).alias("p10_score"),
                 F.sum(F.when(F.col("score") >= BAND_CLEAN, F.col("n")).otherwise(0)).alias("clean"),
                 F.sum(F.when(F.col("score").between(BAND_EDIT, BAND_CLEAN - 1), F.col("n")).otherwise(0)).alias("edit"),
                 F.sum(F.when(F.col("score") < BAND_EDIT, F.col("n")).otherwise(0)).alias("rewrite"),
                 F.sum("b").alias("ban_notes"), F.sum("h").alias("slop_notes"))


def worst(scored: DataFrame, keep: int = 300, key: str = "path") -> DataFrame:
    return scored.orderBy("score", key).limit(keep).select(key, "score", "ban_count")


def scan_text(text: Column) -> Column:
    """What the phrase rules judge: no head, code or untouchable section."""
    t = T.sub(T.drop_fences(T.drop_head(text)), r"`[^`\n]+`", " ")
    for title in rules.UNTOUCHABLE:
        t = T.sub(t, r"(?s)(?m:" + rules.body_heading(title) + r").*?(?=\n##\s+|\z)", " ")
    return t


# -- preservation ----------------------------------------------------------------------

# fixed values: what must survive a rewrite, by kind
FACTS = {
    "url": r"https?://[^\s)>\]\"'`]+",
    "wikilink": r"\[\[[^\]]+\]\]",
    "path": r"(?:~|\.{0,2})/[^\s`)>\]\"']+|[A-Za-z0-9_.\-/]+\.(?:mjs|py|json|md|sh|ts|js|txt|yml|yaml)\b",
    "number": r"[0-9]+(?:[.,][0-9]+)?",
    "version": r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?\b",
    "isoDate": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}
#: the same matches with fewer tries: a path that is no suffix of its own run, edges looked for at digits only
FACTS_SPELLED = {
    "path": r"(?=[~./])(?:~|\.{0,2})/[^\s`)>\]\"']+"
            r"|(?<![A-Za-z0-9_.\-/])[A-Za-z0-9_.\-/]+\.(?:mjs|py|json|md|sh|ts|js|txt|yml|yaml)\b",
    "version": r"(?=[v0-9])" + FACTS["version"],
    "isoDate": r"(?=[0-9])" + FACTS["isoDate"],
}
#: the paths of a text that holds no file ending
ROOTED_PATH = FACTS_SPELLED["path"].split("|(?<!")[0]
FILE_ENDINGS = [".mjs", ".py", ".js", ".md", ".sh", ".ts", ".txt", ".yml", ".yaml"]
LATIN_WORD = r"[A-Za-z][A-Za-z0-9_-]{2,}"


def _occurrences(words: Column) -> Column:
    """Every word with its running number, so multisets compare as sets."""
    return F.flatten(F.transform(T.counts_of(words), lambda c: F.transform(
        F.sequence(F.lit(1), c["n"]), lambda k: F.concat(c["word"], F.lit("\u0000"), k.cast("string")))))


def facts(kind: str, text: Column) -> Column:
    """Every fact of a kind in a text, as ``FACTS`` spells it."""
    found = T.find_all(text, T.ascii_edges(FACTS_SPELLED.get(kind, FACTS[kind])))
    return found if kind != "path" else F.when(T.has_any(text, FILE_ENDINGS), found).otherwise(T.find_all(text, ROOTED_PATH))


def _lost(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("sample")))


def verbatim_blocks(text: Column) -> Column:
    """Blocks that must reappear byte for byte."""
    head = F.filter(F.array(F.regexp_extract(text, r"^(?s:---\r?\n.*?\r?\n---(?:\r?\n|\z))", 0)), lambda x: x != "")
    def where(mark: str, found: Column) -> Column:
        return F.when(text.contains(mark), found).otherwise(F.array().cast("array<string>"))
    fences = where("```", T.find_all(text, r"(?s)```.*?```"))
    inline = where("`", T.find_all(T.drop_fences(text), r"`[^`\n]+`"))
    sects = F.filter(F.array(*[F.when(text.contains(t), T.headed_block(text, rules.body_heading(t))).otherwise("") for t in rules.UNTOUCHABLE]),
                     lambda x: x != "")
    tables = where("|", F.filter(T.find_all(text, r"(?m)^[ \t]*\|[^\n]*(?:\n[ \t]*\|[^\n]*)*"), lambda b: b.rlike("[0-9]")))
    quotes = where(">", T.find_all(text, r"(?m)^[ \t]*>[^\n]*(?:\n[ \t]*>[^\n]*)*"))
    return F.concat(head, fences, inline, sects, tables, quotes)


def lost_facts(before: Column, after: Column) -> Column:
    """array of (kind, sample): what the new version no longer has."""
    parts = [_lost("byte", F.transform(F.filter(verbatim_blocks(before), lambda b: ~after.contains(b)),
                                       lambda b: F.substring(b, 1, 60)))]
    for kind in FACTS:
        gone = F.array_except(_occurrences(facts(kind, before)), _occurrences(facts(kind, after)))
        parts.append(_lost(kind, F.array_distinct(F.transform(gone, lambda v: F.split(v, "\u0000")[0]))))
    parts.append(_lost("latin", F.array_except(T.find_all(before, LATIN_WORD), T.find_all(after, LATIN_WORD))))
    heads = F.filter(F.array(*[F.when(before.contains(t) & before.rlike("(?m)" + rules.body_heading(t))
                                      & ~(after.contains(t) & after.rlike("(?m)" + rules.body_heading(t))),
                                      F.lit(t)) for t in rules.BODY_HEADINGS]), lambda x: x.isNotNull())
    parts.append(_lost("heading", heads))
    return F.concat(*parts)


def preservation(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Add ``lost``; an unclosed head in ``before`` is an input error row."""
    broken = F.col(before).rlike(r"^---\r?\n") & ~F.col(before).rlike(r"^(?s:---\r?\n.*?\r?\n---(?:\r?\n|\z))")
    d = T.staged(pairs, lost=F.when(~broken, lost_facts(F.col(before), F.col(after))))
    return d.withColumn("input_error", broken)


def four_way(lost: Column, ban_count: Column | None = None, score: Column | None = None, floor: int = 85) -> Column:
    """struct(accuracy, language, style, terminology); None without a scan."""
    facts = list(FACTS) + ["byte"]
    none = F.lit(None).cast("boolean")
    return F.struct((~F.exists(lost, lambda x: x["kind"].isin(facts))).alias("accuracy"),
                    (none if ban_count is None else ban_count == 0).alias("language"),
                    (none if score is None else score >= floor).alias("style"),
                    (~F.exists(lost, lambda x: x["kind"].isin("latin", "heading"))).alias("terminology"))


def rewrite_pass(notes: DataFrame, rounds: int = 2) -> DataFrame:
    """(path, outcome, text): notes with stock phrases, rewritten when every
    fact survives and the phrases are gone, else reported as they are.

    The rewrite is its own fixed point, so further rounds change nothing; the
    number of rounds stays a parameter.
    """
    def slop(t: Column) -> Column:
        return F.aggregate(F.filter(ban_hits(F.lower(scan_text(t))), lambda h: h["name"] != rules.DASH_BAN),
                           F.lit(0), lambda a, h: a + h["n"])
    d = T.staged(notes.filter(~hidden_path(F.col("path"))), slop=slop(F.col("text"))).filter("slop > 0")
    new = F.col("text")
    for _ in range(rounds):
        new = rewrite_stock_phrases(new)
    d = T.staged(d, after=new)
    d = preservation(d.withColumnRenamed("text", "before"))
    d = T.staged(d, slop_after=slop(F.col("after")))
    good = ~F.col("input_error") & (F.size("lost") == 0) & (F.col("slop_after") == 0)
    outcome = F.when(good, "fixed").when(F.col("input_error"), "input-error").otherwise("failed")
    return d.select("path", outcome.alias("outcome"), "slop", F.when(good, F.col("after")).otherwise(F.col("before")).alias("text"))


def sweep(notes: DataFrame, floor: int = 85, strict: bool = False) -> DataFrame:
    """Phrases other than the dash fail a note; the dash and a low score advise."""
    d = T.staged(notes.filter(~hidden_path(F.col("path"))), _t=scan_text(F.col("text")))
    d = scan(d, "_t")
    fatal = (F.col("hard") > 0) | (F.lit(strict) & (F.col("score") < floor))
    level = F.when(fatal, "failure").when((F.col("ban_count") > 0) | (F.col("score") < floor), "advice").otherwise("ok")
    return d.select("path", "score", F.col("hard").alias("slop"), level.alias("level"))
