"""Lexical search for many topics at once, and what is built on its results.

Documents are ``docs(path, text)``, topics ``topics(topic, text)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..session import cut_lineage, numbered, spread
from .substring import words_containing


def topic_terms(topics: DataFrame) -> DataFrame:
    """(topic, terms): distinct search words of each topic, order kept."""
    return topics.select("topic", F.array_distinct(T.tokens(F.col("text"), rules.SEARCH_STOP)).alias("terms"))


def _topic_words(topics: DataFrame) -> DataFrame:
    """(topic, n_terms, word): words of each topic and its neighbouring pairs ("a b")."""
    t = topic_terms(topics).withColumn("n_terms", F.size("terms"))
    return t.select("topic", "n_terms", F.explode(F.concat("terms", F.transform(
        F.slice("terms", 1, F.greatest(F.size("terms") - 1, F.lit(0))),
        lambda a, i: F.concat_ws(" ", a, F.get("terms", i + 1))))).alias("word"))


def _postings(docs: DataFrame) -> DataFrame:
    """(path, word, points): a word counts at most eight times, plus four when it is in the path.

    A note's words are counted inside its row; neighbouring words are postings
    of their own without points.
    """
    d = T.staged(docs.select("path", "text"),
                 hay=T.tokens(F.concat_ws("\n", "path", "text"), rules.SEARCH_STOP),
                 rel=F.array_distinct(T.tokens(F.col("path"), rules.SEARCH_STOP)))
    side = F.array_distinct(F.transform(F.slice("hay", 1, F.greatest(F.size("hay") - 1, F.lit(0))),
                                        lambda a, i: F.concat_ws(" ", a, F.get("hay", i + 1))))
    posts = d.select("path", "rel", F.inline(F.concat(T.counts_of(F.col("hay")), F.transform(
        side, lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"))))))
    return posts.select("path", "word", (F.least("n", F.lit(8)) + F.when(
        F.array_contains("rel", F.col("word")), 4).otherwise(0)).alias("points"))


def lexical_scores(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, path, score) of every note a topic matches.

    A note matches the whole topic when it has all its words or two adjacent
    ones side by side; it always matches a single word.  This lists one row for
    each (topic, note); for the best notes of each topic take :func:`best_notes`.
    """
    # a pair posting has no points and is told apart by that
    agg = _postings(docs).join(_topic_words(topics), "word").groupBy("topic", "path").agg(
        F.sum("points").alias("total"), F.max("points").alias("single"), F.count_if(F.col("points") > 0).alias("found"),
        F.max("n_terms").alias("n_terms"), F.max(F.col("points") == 0).alias("pair"))
    whole = (F.col("found") == F.col("n_terms")) | F.col("pair")
    return agg.select("topic", "path", F.greatest(F.when(whole, F.col("total")).otherwise(0), "single").alias("score"))


# -- block-max index -------------------------------------------------------------------

#: Notes of a block of the index.
BLOCK = 1024
#: Blocks of the highest bounds that are scored first, to learn what the others have to reach.
FIRST = 4


def block_index(docs: DataFrame, postings: DataFrame, block: int = BLOCK, repeated: bool = False) -> DataFrame:
    """(word, block, top, posts): the postings (path, points) of every word in each block of notes, and the most points there.

    ``postings(path, word, points)``, which may be ``repeated``.  A list holds at most a block of notes,
    however common its word is.  Written once, as a search reads it several times.
    """
    at = F.pmod(F.xxhash64("path"), F.lit(max(1, -(-docs.count() // block)))).cast("int")
    lists = postings.groupBy("word", at.alias("block")).agg(
        F.max("points").alias("top"), (F.collect_set if repeated else F.collect_list)(F.struct("path", "points")).alias("posts"))
    return cut_lineage(lists)


class BlockSearch:
    """The best notes of every topic over a :func:`block_index`; ``words(topic, n_terms, word[, weight])``.

    No note of a block can score more than the sum of the highest points its
    topic's words have there.  A few blocks of the highest bounds are scored
    first; a block whose bound is below the score then found at place ``keep``
    is not opened.  Notes never meet topics one by one in a shuffle: what moves
    is lists of a block, a topic scores a block where its lists lie, and out of
    it come at most ``keep`` notes - or, with ``ties``, those and all that equal
    the last of them.  ``whole``: a topic scores by all its words or by
    two neighbouring ones, else by a single one; without it by whatever is found.
    """

    def __init__(self, index: DataFrame, words: DataFrame, keep: int, whole: bool = True, ties: bool = False):
        self.keep, self.whole, self.ties = keep, whole, ties
        words = words if "weight" in words.columns else words.withColumn("weight", F.lit(1))
        self.met = index.join(words, "word").select("topic", "block", "top", "n_terms", "weight", "posts")
        # stored, so sizes are known: blocks to open are sent to the lists, and of those only the opened ones move
        self.bounds = cut_lineage(self.met.groupBy("topic", "block").agg(F.sum(F.col("top") * F.col("weight")).alias("bound")))
        w = Window.partitionBy("topic").orderBy(F.desc("bound"), "block")
        self.first = cut_lineage(self.bounds.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= FIRST).select("topic", "block"))
        self.seeds = cut_lineage(self._ranked(self._scored(self.first), "topic").drop("rank"))

    def _scored(self, blocks: DataFrame) -> DataFrame:
        spark = blocks.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        opened = self.met.join(blocks, ["topic", "block"], "left_semi").repartition(tasks, "topic", "block")
        # grouping and ranking go on inside the partitions of (topic, block)
        notes = opened.select("topic", "block", "n_terms", "weight", F.inline("posts")).groupBy("topic", "block", "path").agg(
            F.sum(F.col("points") * F.col("weight")).alias("total"), F.max("points").alias("single"),
            F.count_if(F.col("points") > 0).alias("found"), F.max("n_terms").alias("n_terms"), F.max(F.col("points") == 0).alias("pair"))
        whole = (F.col("found") == F.col("n_terms")) | F.col("pair")
        score = F.greatest(F.when(whole, F.col("total")).otherwise(0), "single") if self.whole else F.col("total")
        return self._ranked(notes.withColumn("score", score.cast("long")), "topic", "block").select("topic", "path", "score")

    def _ranked(self, scored: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), *([] if self.ties else ["path"]))
        return scored.withColumn("rank", (F.rank() if self.ties else F.row_number()).over(w)).filter(F.col("rank") <= self.keep)

    def rest(self) -> DataFrame:
        """(topic, block): the blocks that may still hold one of the best."""
        least = self.seeds.groupBy("topic").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= self.keep)
        return self.bounds.join(least, "topic", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0))).select(
            "topic", "block").join(self.first, ["topic", "block"], "left_anti")

    def best(self) -> DataFrame:
        """(topic, path, score, rank)."""
        return self._ranked(self.seeds.unionByName(self._scored(cut_lineage(self.rest()))), "topic")


def best_of_blocks(index: DataFrame, words: DataFrame, keep: int, whole: bool = True, ties: bool = False) -> DataFrame:
    """(topic, path, score, rank): the ``keep`` best notes of every topic, see :class:`BlockSearch`."""
    return BlockSearch(index, words, keep, whole, ties).best()


def best_notes(docs: DataFrame, topics: DataFrame, keep: int = 60, block: int = BLOCK) -> DataFrame:
    """(topic, path, score, rank): the best ``keep`` notes of each topic by :func:`lexical_scores`, ties by path."""
    words = cut_lineage(_topic_words(topics))
    postings = _postings(docs).join(words.select("word").distinct(), "word", "left_semi")
    return best_of_blocks(block_index(docs, postings, block), words, keep)


def candidates(scores: DataFrame, keep: int = 60) -> DataFrame:
    """The best ``keep`` notes of each topic; Spark cuts before the shuffle."""
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def snippets(text: Column, terms: Column, keep: int = 3) -> Column:
    """Distinct snippets around the first hit of each term; stops when full."""
    def walk(line: Column) -> Column:
        def add(acc: Column, term: Column) -> Column:
            grown = T.let(T.snippet_at(text, line, term), lambda s: F.when(
                s.isNotNull() & (s != "") & ~F.array_contains(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
            return F.when(F.size(acc) >= keep, acc).otherwise(grown)
        return F.aggregate(terms, F.array().cast("array<string>"), add)
    return T.let(T.word_line(text), walk)


def with_texts(cands: DataFrame, docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Candidates with their topic words and texts, spread for per-row work."""
    return spread(cands.join(topic_terms(topics), "topic").join(docs.select("path", "text"), "path"))


def findings(cands: DataFrame, docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, path, source, insight, relevance) of candidates with a snippet."""
    d = T.staged(with_texts(cands, docs, topics), snips=snippets(F.col("text"), F.col("terms")))
    return d.filter(F.size("snips") > 0).select(
        "topic", "path", "rank", F.regexp_extract("text", r"https?://\S+", 0).alias("source"),
        F.array_join("snips", " … ").alias("insight"),
        F.least(F.lit(5), 2 + F.floor(F.col("score") / 4)).alias("relevance"))


def evidence(text: Column, terms: Column, limit: int = 2500, size: int = 1000, step: int = 800) -> Column:
    """The two windows of a text with most topic words, in text order; ``terms`` are distinct words."""
    # the n-th character is found by walking to it, so windows are cut out of blocks of ten
    block = step * 10
    blocks = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))

    def scored(line: Column) -> Column:
        def inside(b: Column, part: Column) -> Column:
            starts = F.sequence(b, F.least(b + block, F.length(text)) - 1, F.lit(step))
            # one space stands for each separator, so the words of a window are cut by it and looked up at once
            return F.transform(starts, lambda s: F.struct((-F.size(F.array_intersect(
                F.split(F.substring(part, s - b + 1, F.lit(size)), " "), terms))).alias("neg"), s.alias("start")))
        return F.flatten(F.transform(blocks, lambda b: T.let(
            F.substring(line, b + 2, F.lit(block - step + size)), lambda part: inside(b, part))))
    best = F.slice(F.array_sort(T.let(T.word_line(text), scored)), 1, 2)
    shown = F.transform(F.array_sort(F.transform(best, lambda w: w["start"])), lambda s: T.let(
        F.substring(text, s + 1, F.lit(size)), lambda body: F.concat(
            F.lit("["), (s + 1).cast("string"), F.lit("–"), (s + F.length(body)).cast("string"), F.lit("]\n"), body)))
    return F.substring(F.array_join(shown, "\n\n"), 1, limit)


def facet_of(text: Column, facets: Sequence[tuple[str, Sequence[str]]], default: str = "general") -> Column:
    """Facet with most of its terms in the text; the earlier one on ties."""
    def pick(low: Column) -> Column:
        scored = F.array(*[F.struct(
            sum((low.contains(t).cast("int") for t in terms), F.lit(0)).alias("n"), F.lit(-i).alias("o"),
            F.lit(label).alias("label")) for i, (label, terms) in enumerate(facets)])
        return T.let(F.array_max(scored), lambda b: F.when(b["n"] > 0, b["label"]).otherwise(default))
    return T.let(F.lower(text), pick)


def shards(cands: DataFrame, by: Sequence[str] = ("topic",), size: int = 6) -> DataFrame:
    """Shard number inside each group of candidates (a topic has at most the
    candidate cap, so the group is small by construction)."""
    w = Window.partitionBy(*by).orderBy("rank")
    return cands.withColumn("shard", F.floor((F.row_number().over(w) - 1) / size) + 1)


def shard_cap(sharded: DataFrame, by: Sequence[str] = ("topic",), max_shards: int = 12) -> DataFrame:
    """Per topic: shards kept and how many notes fall out, as the report says."""
    sizes = sharded.groupBy(*by, "shard").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    w = Window.partitionBy("topic").orderBy("first", "shard")
    d = sizes.withColumn("order", F.row_number().over(w))
    inside = F.col("order") <= max_shards
    return d.groupBy("topic").agg(F.count("*").alias("shards"), F.count_if(inside).alias("kept"),
                                  F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("dropped_notes"))


def themes(found: DataFrame, keep: int = 12) -> DataFrame:
    """Per topic the notes with most findings, their distinct points joined."""
    per = found.groupBy("topic", "path").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"),
        F.array_join(F.array_sort(F.collect_set("insight")), " | ").alias("points"))
    w = Window.partitionBy("topic").orderBy(F.desc("n"), "first")
    return (per.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= keep)
            .select("topic", "pos", F.col("path").alias("title"), "points"))


# -- votes ---------------------------------------------------------------------------

def vote_ranking(docs: DataFrame, questions: DataFrame, keep: int = 7, min_len: int = 3, block: int = BLOCK) -> DataFrame:
    """(topic, path, votes, pos): question words that occur anywhere in a note.

    A word counts as a substring.  The corpus vocabulary is matched once against
    all question words through shared grams; notes then only meet the words of
    the vocabulary that hold one.  The words found are lists of the block index.
    In all that, a note goes by its place in the order of paths, which breaks ties as its path does.
    """
    names = cut_lineage(numbered(docs.select(F.col("path").alias("name")).distinct(), [], [F.col("name")], "place"))
    docs = docs.join(names, F.col("path").eqNullSafe(F.col("name"))).select(F.col("place").alias("path"), "text")
    q = cut_lineage(questions.select("topic", F.explode(F.array_distinct(
        T.query_words(F.col("text"), rules.SEARCH_STOP, min_len))).alias("word")))
    runs = docs.select("path", F.explode(F.array_distinct(T.find_all(F.lower("text"), r"[a-zа-яё0-9-]+"))).alias("run"))
    vocab = runs.select(F.col("run").alias("word")).distinct()
    hits = cut_lineage(words_containing(vocab, q.select(F.col("word").alias("part")).distinct()).withColumnRenamed("word", "run"))
    posts = runs.join(hits, "run").select("path", F.col("part").alias("word"), F.lit(1).alias("points"))
    best = best_of_blocks(block_index(docs, posts, block, repeated=True), q.withColumn("n_terms", F.lit(0)), keep, whole=False)
    return best.join(names, F.col("path") == F.col("place")).select(
        "topic", F.col("name").alias("path"), F.col("score").alias("votes"), F.col("rank").alias("pos"))


# -- evaluation -----------------------------------------------------------------------

def hit_at(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(topic, hit): any ranked name of the topic contains any expected string.
    ``ranked(topic, path)`` is a top list, ``expected(topic, expect)`` a table."""
    hits = (ranked.join(expected, "topic").filter(F.lower("path").contains(F.lower("expect"))).select("topic").distinct())
    return (expected.select("topic").distinct().join(hits.withColumn("_h", F.lit(True)), "topic", "left")
            .select("topic", F.coalesce("_h", F.lit(False)).alias("hit")))


def missing_expectations(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """Topics none of whose expected strings is in any note name; any row here
    fails the run."""
    from .substring import containing
    names = docs.select(F.col("path"), F.lower("path").alias("text"))
    found = containing(names, expected.select(F.lower("expect").alias("needle")).distinct())
    low = expected.withColumn("needle", F.lower("expect"))
    ok = low.join(found.select("needle").distinct(), "needle", "left_semi").select("topic").distinct()
    return expected.select("topic").distinct().join(ok, "topic", "left_anti")


def must_and_must_not(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases(topic, path, must_hit)`` against a result list: row per failure."""
    got = ranked.select("topic", "path").distinct().withColumn("_g", F.lit(True))
    d = cases.join(got, ["topic", "path"], "left").withColumn("_g", F.coalesce("_g", F.lit(False)))
    return d.filter(F.col("_g") != F.col("must_hit")).select("topic", "path", "must_hit")


def retrieval_totals(hits: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``hits(method, topic, hit)``: hits and misses per method and, with a
    baseline of (method, hits), whether the method fell behind it."""
    out = hits.groupBy("method").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    if baseline is None:
        return out
    b = baseline.select("method", F.col("hits").alias("before"))
    return out.join(b, "method", "left").withColumn("regressed", F.coalesce(F.col("hits") < F.col("before"), F.lit(False)))
