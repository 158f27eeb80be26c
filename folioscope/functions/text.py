"""Column expressions over one text.

Everything here is built from Spark's own functions, so it runs inside the JVM
next to the scan and needs no shuffle: a document is one row, and its lines,
words and sections are arrays of that row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A Column used several times in one expression is evaluated several times
    when it sits inside a higher-order function; a one-element array binds it
    to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections see as plain attributes.

    The one-row generator keeps Catalyst from copying a costly expression into
    every place that mentions it (predicate push-down inlines aliases).
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


WORD_EDGE = (r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
             r"|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


_LEADING_EDGE = re.compile(r"(^|\||\(\?[imsuU]+\)|\(\?:|\()\\b(?=[A-Za-z0-9]|\(\?:[A-Za-z]|\[a-f0-9\]|\[0-9\])")


def ascii_edges(pattern: str) -> str:
    r"""Spell ``\b`` as an ASCII word edge, whatever the Java version thinks of it.

    Before a word character the edge is just "no word character behind", which
    the engine tests much faster than the two-sided form.
    """
    return _LEADING_EDGE.sub(r"\1(?<![A-Za-z0-9_])", pattern).replace(r"\b", WORD_EDGE)


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; a lone space is no match to replace."""
    spaced = sub(text, r"\s{2,}|[^\S ]", " ")
    return let(spaced, lambda t: F.when(t.rlike("[\u0085\u2028\u2029]\\z"), strip(t)).otherwise(F.trim(t)))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def at(arr: Column, i: int | Column) -> Column:
    """Zero-based element, null when outside (no ANSI error)."""
    return F.get(arr, F.lit(i) if isinstance(i, int) else i)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or null when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def has_any(low: Column, strings: Sequence[str]) -> Column:
    """Does lower-case text contain one of these strings (a plain byte search)?"""
    hit = low.contains(strings[0])
    for s in strings[1:]:
        hit = hit | low.contains(s)
    return hit


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else, which is what ``(?i)`` alone takes for the same."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cased(text: Column) -> Column:
    """(text, low): a text with its lower case, so a chain of rules asks for it only after a change."""
    return let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))


#: Letters that ``(?iu)`` takes for Latin or Cyrillic ones although their lower case is another.
ODD_CASE = "[\u0130\u0131\u017f\u1c80-\u1c88]"


def alternatives(pattern: str) -> tuple[list[str], list[str]]:
    """The top-level alternatives of a pattern: plain strings, and real patterns."""
    parts = re.split(r"\|(?![^(]*\))", pattern)
    plain = [p for p in parts if re.fullmatch(r"(?:\\\.|[^\\.*+?()\[\]{}^$|])+", p)]
    return [p.replace("\\.", ".") for p in plain], [p for p in parts if p not in plain]


# -- normal forms -----------------------------------------------------------

def fold_yo(text: Column) -> Column:
    """Lower case with the two spellings of one Cyrillic letter made equal."""
    return F.lower(F.translate(text, "ёЁ", "еЕ"))


def compact(text: Column, limit: int | None = None) -> Column:
    """Heading marks cut, white space squeezed, the whole text or its first ``limit`` characters."""
    whole = squeeze(sub(text, r"(?m)^#{1,6}\s+", ""))
    return whole if limit is None else F.substring(whole, 1, limit)


def slug(text: Column, limit: int = 72, default: str = "note", unicode: bool = False) -> Column:
    keep = r"[^\p{L}\p{N}]+" if unicode else r"[^a-zа-я0-9]+"
    s = F.substring(sub(sub(F.lower(text), keep, "-"), r"^-+|-+$", ""), 1, limit)
    return F.coalesce(let(s, blank_to_null), F.lit(default))


def short_label(text: Column, n: int = 30) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


# -- tokens -----------------------------------------------------------------

def tokens(text: Column, stop: Sequence[str] = (), pattern: str = r"[\p{L}\p{N}]{3,}") -> Column:
    """Lower-case runs of letters and digits, duplicates kept, stop words out."""
    found = find_all(F.lower(text), pattern)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def token_set(text: Column, min_len: int = 2) -> Column:
    return F.array_distinct(F.filter(find_all(fold_yo(text), r"[a-zа-я0-9]+"),
                                     lambda t: F.length(t) >= min_len))


def stem_set(text: Column, width: int = 5) -> Column:
    return F.array_distinct(F.transform(token_set(text), lambda t: F.substring(t, 1, width)))


def query_words(text: Column, stop: Sequence[str], min_len: int = 3) -> Column:
    """Distinct words of a question; a hyphen belongs to the word."""
    found = find_all(F.lower(text), r"[a-zа-яё0-9][a-zа-яё0-9-]*")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= min_len) & ~w.isin(*stop)))


def counts_of(words: Column) -> Column:
    """array of (word, n), counted inside the row by sorting its words."""
    def runs(s: Column) -> Column:
        marks = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(marks, lambda m: F.transform(m, lambda i, j: F.struct(
            F.get(s, i).alias("word"), (F.coalesce(F.get(m, j + 1), F.size(s)) - i).alias("n"))))
    return let(F.sort_array(words), runs)


def long_words(text: Column, min_len: int = 4) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-zа-яё0-9]+"), lambda w: F.length(w) >= min_len)


def windows(text: Column, size: int = 1000, step: int = 800) -> Column:
    """Overlapping windows over the whole text: array of (start, body)."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("body")))


# -- code and prose ---------------------------------------------------------

def mask_code(text: Column) -> Column:
    """Blank out fenced and inline code; every line and offset stays put.

    Splitting at the fence mark makes the pieces alternate outside/inside, so
    a piece is code when its index is odd and a closing mark follows it.
    """
    def mask(value: Column, mark: str) -> Column:
        pad = " " * len(mark)
        return let(F.split(value, mark), lambda parts: F.array_join(F.transform(
            parts, lambda p, i: F.when(i % 2 == 0, p)
            .when(i < F.size(parts) - 1, F.concat(F.lit(pad), sub(p, r"[^\n]", " "), F.lit(pad)))
            .otherwise(F.concat(F.lit(mark), p))), ""))
    fenced = mask(text, "```")
    return F.array_join(F.transform(lines_of(fenced), lambda line: mask(line, "`")), "\n")


def drop_fences(text: Column) -> Column:
    return let(text, lambda t: F.when(t.contains("```"), sub(t, r"(?s)```.*?```", " ")).otherwise(t))


def drop_code(text: Column) -> Column:
    return sub(drop_fences(text), r"`[^`\n]*`", " ")


def drop_urls(text: Column) -> Column:
    return sub(text, r"https?://\S+", " ")


def drop_head(text: Column) -> Column:
    return sub(text, r"^(?s:---\r?\n.*?\r?\n---(?:\r?\n|$))", "")


def prose(text: Column) -> Column:
    """Text without frontmatter, code and addresses."""
    return drop_urls(drop_code(drop_head(text)))


def language_layer(text: Column) -> Column:
    """The words a reader sees: no head, code, link targets, addresses or ids."""
    def where(t: Column, has: str, pattern: str, repl: str) -> Column:
        return let(t, lambda x: F.when(x.contains(has), sub(x, pattern, repl)).otherwise(x))
    t = F.when(text.startswith("---"), sub(text, r"^(?s:---\s*\n.*?\n---\s*\n?)", "\n")).otherwise(text)
    t = where(drop_fences(t), "`", r"`[^`]*`", " ")
    t = where(t, "![", r"!\[[^\]]*\]\([^)]+\)", " ")
    t = where(t, "](", r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = where(t, "[[", r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    t = where(where(t, "[[", r"\[\[[^\]]+\]\]", " "), "://", r"https?://\S+", " ")
    t = where(t, ":", ascii_edges(r"(?i)(?=[sclpv])\b(?:source_ref|source_hash|cluster_id|processor_model|"
                                  r"verification_status|local-media|processed_notes):\S*"), " ")
    return let(t, lambda x: F.when(x.rlike(r"(?i)[a-f0-9]{16}"), sub(x, ascii_edges(r"(?i)\b[a-f0-9]{16,}\b"), " ")).otherwise(x))


CYRILLIC = r"[А-Яа-яЁё]"
LATIN = r"[A-Za-z]"


def script_share(prose_text: Column, script: str = CYRILLIC, empty: float = 0.0) -> Column:
    """Share of one script among the letters of that script and Latin."""
    def share(t: Column) -> Column:
        own, lat = count_of(t, script), count_of(t, LATIN)
        return F.when(own + lat > 0, own / (own + lat)).otherwise(F.lit(empty))
    return let(prose_text, share)


# -- sections ---------------------------------------------------------------

def section_body(text: Column, heading: str) -> Column:
    """Lines after the first line matching ``heading`` up to the next level-2
    heading; null when no such heading exists."""
    def first_true(lines: Column, pattern: str) -> Column:
        return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True)).cast("int")

    def upto_next(tail: Column) -> Column:
        return let(first_true(tail, r"^##\s"), lambda stop: F.array_join(
            F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail), "\n"))

    def after(lines: Column, start: Column) -> Column:
        rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
        return F.when(start > 0, let(rest, upto_next))
    return let(lines_of(text), lambda ls: let(first_true(ls, heading), lambda start: after(ls, start)))


def filled_sections(text: Column) -> Column:
    """array of (head, filled) of the level-2 sections: the heading line, and whether more than white space follows it."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=##[^\S\n])"), lambda p: p.startswith("##"))
    return F.transform(parts, lambda p: let(F.substring_index(p, "\n", 1), lambda h: F.struct(
        h.alias("head"), F.substring(p, F.length(h) + 1, F.length(p)).rlike(r"\S").alias("filled"))))


def is_filled(sections: Column, heading: str) -> Column:
    """Whether the first of :func:`filled_sections` that has this heading says something."""
    return F.coalesce(at(F.filter(sections, lambda s: s["head"].rlike(heading)), 0)["filled"], F.lit(False))


def headed_block(text: Column, heading: str) -> Column:
    """The heading line itself plus everything before the next level-2 heading."""
    return F.regexp_extract(text, r"(?s)(?m:" + heading + r").*?(?=\n##\s+|\z)", 0)


# -- bullets and titles -----------------------------------------------------

def sentence_parts(text: Column) -> Column:
    return F.split(text, r"\n|[•*-]\s+|(?<=[.!?])\s+")


def distinct_by_lower(arr: Column, keep: int) -> Column:
    """First ``keep`` strings that differ in more than case, order kept."""
    return let(arr, lambda a: let(F.transform(a, F.lower), lambda low: F.transform(
        F.slice(F.array_distinct(low), 1, keep), lambda k: F.element_at(a, F.array_position(low, k).cast("int")))))


def bullets(text: Column, boiler: str, min_len: int = 32, width: int = 190, keep: int = 8) -> Column:
    cut = F.transform(sentence_parts(text), lambda p: compact(p, width))
    return distinct_by_lower(F.filter(cut, lambda p: (F.length(p) >= min_len) & ~p.rlike(boiler)), keep)


def word_line(text: Column) -> Column:
    """Lower-case text with every separator turned into one space, character for
    character, and a space on both ends: " word " finds whole words by plain
    search, and positions are those of the text."""
    low = F.lower(F.replace(text, F.lit("İ"), F.lit("I")))  # the one letter whose lower case is longer
    return F.concat(F.lit(" "), sub(low, r"[^\p{L}\p{N}]", " "), F.lit(" "))


def snippet_at(text: Column, line: Column, term: Column, before: int = 120, after: int = 200) -> Column:
    """Text around the first whole-word hit of ``term``; null without a hit."""
    return let(F.instr(line, F.concat(F.lit(" "), term, F.lit(" "))) - 1, lambda hit: F.when(hit >= 0, let(
        F.greatest(hit - before, F.lit(0)),
        lambda start: squeeze(F.substring(text, start + 1, hit + after - start)))))


def snippet(text: Column, term: Column, before: int = 120, after: int = 200) -> Column:
    return let(word_line(text), lambda line: snippet_at(text, line, term, before, after))


# -- line repeats -----------------------------------------------------------

def repeated_line_share(text: Column, min_lines: int = 8) -> Column:
    lines = F.filter(F.transform(lines_of(text), strip), lambda x: x != "")
    return let(lines, lambda ls: F.when(F.size(ls) < min_lines, F.lit(0.0)).otherwise(
        1 - F.size(F.array_distinct(ls)) / F.size(ls)))


def looks_like_code(text: Column) -> Column:
    """Braces, arrows, calls, or too few characters that occur in prose."""
    prose_chars = count_of(text, r"[\p{L}\s.,;:!?()'\"-]")
    return (text.rlike(r"[{}]|=>|\);|\w+\.\w+\(|^\(function")
            | (prose_chars / F.greatest(F.length(text), F.lit(1)) < 0.85))


def usable_extraction(text: Column) -> Column:
    """At least 80 characters and 50 letters, and no placeholder."""
    t = squeeze(text)
    return ((F.length(t) >= 80) & (count_of(t, r"[A-Za-zА-Яа-яЁё]") >= 50)
            & ~t.rlike(r"(?i)^(Video queued for local Whisper transcription|No extractable text)"))
