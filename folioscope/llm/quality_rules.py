"""Quality rules: counted base rules, then distance of a text from its language.

A language is described by two average histograms over all its documents: the
classes of its characters and its most common words.  A document whose own
histograms lie too far from them (Jensen-Shannon distance, base 2) is rejected;
the allowance grows as 1 / sqrt(words), the sampling noise of a short text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import long_field, map_texts, slices, stored, texts_of

SYMBOLS = b"#*$%&|<>"
#: Byte -> class: lower, upper, digit, blank, line end, punctuation, symbol, other ASCII, start of another character.
CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[0xC0:] = 8
_CLASS[0x80:0xC0] = 9  # continues a character, counted nowhere


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that stands twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    n = Counter(windows)
    hit = np.fromiter((n[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def common_words(docs: DataFrame, k: int, share: float, min_words: int) -> DataFrame:
    """(lang, words, docs): the k words that are prominent in most documents of a language.

    A word is prominent where it makes up ``share`` of a text of ``min_words``
    or more, so a document contributes at most 1 / share words.  Tasks send
    counts of words, never of occurrences.
    """
    src = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    schema = "lang string, word binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0] for key in keys], pa.string()), pa.array([key[1] for key in keys], pa.binary()),
                pa.array([seen[key] for key in keys], pa.int64())], names=["lang", "word", "n"])

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                words = text.encode().lower().split()
                if len(words) >= min_words:
                    floor = share * len(words)
                    seen.update((lang, w) for w, n in Counter(words).items() if n >= floor)
                    seen[lang, None] += 1
            if len(seen) > 200_000:
                yield flush()
                seen.clear()
        yield flush()

    counts = src.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.col("word").isNull().desc(), F.desc("n"), "word"))).filter(f"rank <= {k + 1}")
    return ranked.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("rank", "word")))).alias("ranked"),
        F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("docs"))


def _shares(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.greatest(F.aggregate(a, F.lit(0.0), lambda s, y: s + y), F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of one length, in [0, 1]."""
    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: (half(x, y) + half(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), F.lit(0.0)))


def quality_rules(docs: DataFrame, common: int = 48, share: float = 0.01, min_words: int = 50, min_docs: int = 30,
                  word_base: float = 0.24, word_noise: float = 1.6, char_base: float = 0.14, char_noise: float = 1.1) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance).

    Words are runs of anything but ASCII white space.  A document with fewer
    than ``min_words`` words or repeated windows over half its words fails the
    base rules.  Others are dropped when a distance exceeds base + noise /
    sqrt(words).  Distances are null, and nobody is dropped for them, below
    ``min_words`` words (the minimum-length guard) and in a language with fewer
    than ``min_docs`` such documents.  The languages, like the columns of a
    table, are a small catalogue: at most ``common`` words each go to the driver.

    A null text counts as an empty one; a null language is a language of its
    own; repeated rows are judged alike, each on its own row; an empty table
    gives no rows; columns besides doc_id, text and lang are not read.
    """
    lists = {r["lang"]: {bytes(w["word"]): i for i, w in enumerate(r["ranked"])}
             for r in common_words(docs, common, share, min_words).collect() if (r["docs"] or 0) >= min_docs}
    fields = [long_field(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
        T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType()))]

    def count(texts: list[str], batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text, lang in zip(texts, batch.column(1).to_pylist()):
            raw = text.encode()
            words = raw.split()
            classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES + 1)
            known = lists.get(lang)
            bins = None
            if known is not None and len(words) >= min_words:
                n = Counter(map(known.get, raw.lower().split()))
                bins = [n.get(i, 0) for i in range(len(known))] + [0] * (common - len(known)) + [n.get(None, 0)]
            rows.append((len(words), int(classes[:CLASSES].sum() - classes[3] - classes[4]), int(classes[6]),
                         repeated_lines(raw), repeated_words(words), classes[:CLASSES].tolist(), bins))
        return [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2)]

    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    seen = stored(map_texts(docs, ["doc_id", "lang"], count, fields), "quality")
    share_cols = [_shares(F.col(c)).alias(c) for c in ("chars", "words")]
    mean = None
    for name in ("chars", "words"):
        part = (seen.filter("words is not null").select("lang", *share_cols).select("lang", F.posexplode(name))
                .groupBy("lang", "pos").agg(F.avg("col").alias("x")).groupBy("lang")
                .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).getField("x").alias(f"ref_{name}")))
        part = part.withColumnRenamed("lang", "l")
        mean = part if mean is None else mean.join(part.withColumnRenamed("l", "l2"), F.expr("l <=> l2")).drop("l2")
    placed = seen.join(mean, F.col("lang").eqNullSafe(F.col("l")) & F.col("words").isNotNull(), "left")
    for name in ("chars", "words"):
        placed = placed.withColumn(f"{name[:-1]}_distance", F.when(
            F.col("words").isNotNull(), js_distance(_shares(F.col(name)), F.col(f"ref_{name}"))))
    bad = F.expr(f"n_words < {min_words} or 100 * n_repeat_words > 50 * n_words")
    far = F.coalesce((F.col("char_distance") > char_base + char_noise / F.sqrt("n_words"))
                     | (F.col("word_distance") > word_base + word_noise / F.sqrt("n_words")), F.lit(False))
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         bad.alias("base_failed"), (~bad & ~far).alias("kept"), "char_distance", "word_distance")
