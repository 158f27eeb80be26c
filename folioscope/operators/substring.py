"""Exact "text contains string" joins without a nested loop.

A string that occurs in a text has each of its words inside some word of that
text.  So the join goes over the words: (1) which words of the corpus contain a
word of the string - an equi-join on three-letter grams, then verified; (2) which
documents hold those words; (3) verify on the text itself.  Every step is an
equi-join, and no result is lost, whichever word of the string is followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, spread

#: lengths of grams; a part is looked up by grams of the longest length it has
GRAMS = (1, 2, 3, 6, 10)


def grams(word: Column, n: int) -> Column:
    """Distinct substrings of one length."""
    return F.when(F.length(word) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def words_containing(vocab: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part) for every vocabulary word that contains the part.

    A part joins on one gram of the longest length of GRAMS it has, the one the
    fewest parts have: names that begin or end alike do not meet each other.
    Only the lengths that occur are spread out.
    """
    size = F.when(F.length("part") >= GRAMS[0], F.lit(GRAMS[0]))
    for n in GRAMS[1:]:
        size = F.when(F.length("part") >= n, F.lit(n)).otherwise(size)
    sized = cut_lineage(parts.select("part", size.alias("n")).distinct().filter("n is not null"))
    sizes = sorted(r["n"] for r in sized.select("n").distinct().collect())  # at most as many values as GRAMS
    if not sizes:
        return vocab.limit(0).select("word", F.col("word").alias("part"))
    every = sized.select("part", F.explode(F.coalesce(*[F.when(F.col("n") == n, grams(F.col("part"), n)) for n in sizes])).alias("gram"))
    shared = every.groupBy("gram").agg(F.count("*").alias("parts"))
    # stored, so its size is known: few parts are sent to the words, and the grams of the words then stay where they are
    first = cut_lineage(every.join(shared, "gram").groupBy("part").agg(F.min_by("gram", F.struct("parts", "gram")).alias("gram")))
    grammed = spread(vocab.select("word")).select("word", F.explode(F.concat(*[grams(F.col("word"), n) for n in sizes])).alias("gram"))
    return (grammed.join(first, "gram").filter(F.col("word").contains(F.col("part"))).select("word", "part").distinct())


def containing(docs: DataFrame, needles: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(needle, key) for every document whose text contains the needle.

    Of a needle's words the one with the fewest candidate documents is followed.
    """
    words = docs.select(key, F.explode(F.array_distinct(T.find_all(F.col(text), r"\S+"))).alias("word"))
    vocab = words.groupBy("word").agg(F.count("*").alias("df"))
    parts = needles.select("needle", F.explode(F.array_distinct(T.find_all(F.col("needle"), r"\S+"))).alias("part"))
    hits = words_containing(vocab, parts)
    hits = cut_lineage(hits.join(vocab, "word"))  # words of the needles only
    cost = hits.groupBy("part").agg(F.sum("df").alias("cost"))
    # a part found nowhere has cost 0: its needle occurs nowhere
    priced = parts.join(cost, "part", "left").fillna(0, ["cost"])
    chosen = priced.groupBy("needle").agg(F.min_by("part", F.struct("cost", "part")).alias("part"))
    cand = (words.join(hits.join(chosen, "part").select("word", "needle").distinct(), "word")
            .select(key, "needle").distinct())
    return (cand.join(docs.select(key, text), key).filter(F.col(text).contains(F.col("needle"))).select("needle", key))
