"""Note heads as columns: no shuffle, because one note is one row.

The head is a small YAML subset - scalars, inline lists, block lists, comments.
Anything else is an error, and an erroneous head yields no fields at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, lines_of, staged, strip, sub

FENCE = r"^---\s*$"


def _unquote(v: Column) -> Column:
    return sub(v, r"^(?s:\"(.*)\"|'(.*)')$", "$1$2")


def _split_list(raw: Column) -> Column:
    inner = F.split(sub(raw, r"^\[|\]$", ""), ",")
    return F.filter(F.transform(inner, lambda x: _unquote(strip(x))), lambda x: x != "")


def _last_before(positions: Column, i: Column) -> Column:
    return F.array_max(F.filter(positions, lambda p: p < i))


def with_frontmatter(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fm_error``, ``fm_detail``, ``fm`` and ``body``.

    ``fm`` maps a key to (is_list, items).  ``fm_error`` is one of no_fence,
    not_closed, duplicate_key, unreadable_line; ``fm_detail`` holds the key or
    the line number.  The body of a note without a closed head is the text.
    """
    d = staged(df, _ls=lines_of(F.col(text)))
    d = d.withColumn("_open", F.get("_ls", F.lit(0)).rlike(FENCE))
    d = staged(d, _close=F.when(F.col("_open"), F.array_position(F.transform(
        F.slice("_ls", 2, F.greatest(F.size("_ls") - 1, F.lit(0))), lambda x: x.rlike(FENCE)), F.lit(True))
    ).otherwise(F.lit(0)).cast("int"))
    d = d.withColumn("body", F.when(F.col("_close") > 0, F.array_join(
        F.slice("_ls", F.col("_close") + 2, F.greatest(F.size("_ls") - F.col("_close") - 1, F.lit(0))), "\n"))
        .otherwise(F.col(text)))

    def parse(line: Column, i: Column) -> Column:
        line = sub(line, r"\r$", "")
        key = F.regexp_extract(line, r"^([A-Za-z0-9_.-]+):(?:\s+(.*))?$", 1)
        raw = strip(F.regexp_extract(line, r"^([A-Za-z0-9_.-]+):(?:\s+(.*))?$", 2))
        kind = (F.when(line.rlike(r"^\s*(#|$)"), "skip")
                .when((key != "") & (raw == ""), "block")
                .when((key != "") & raw.rlike(r"^\[.*\]$"), "inline")
                .when(key != "", "scalar")
                .when(line.rlike(r"^\s*-\s+"), "item")
                .when(line.rlike(r"^\s"), "skip").otherwise("bad"))
        value = F.when(kind == "item", _unquote(strip(sub(line, r"^\s*-\s+", "")))).otherwise(raw)
        return F.struct(i.alias("i"), kind.alias("kind"), key.alias("key"), value.alias("value"),
                        line.rlike(r"^\s").alias("indented"))

    d = staged(d, _p=F.transform(F.slice("_ls", 2, F.greatest(F.col("_close") - 1, F.lit(0))), parse))
    d = staged(d, _k=F.filter("_p", lambda p: p["kind"].isin("block", "inline", "scalar")))
    d = staged(d, _kp=F.transform("_k", lambda p: p["i"]),
               _bp=F.transform(F.filter("_k", lambda k: k["kind"] == "block"), lambda k: k["i"]))
    # the key line an item belongs to, when that key opened a block list
    d = staged(d, _items=F.transform(F.filter("_p", lambda p: p["kind"] == "item"), lambda p: F.struct(
        p["i"].alias("i"), p["value"].alias("value"), p["indented"].alias("indented"),
        _last_before(F.col("_bp"), p["i"]).eqNullSafe(_last_before(F.col("_kp"), p["i"])).alias("same"),
        _last_before(F.col("_kp"), p["i"]).alias("owner"))))
    keys = F.transform("_k", lambda p: p["key"])
    bad = F.concat(
        F.transform(F.filter("_p", lambda p: p["kind"] == "bad"), lambda p: F.struct(
            p["i"].alias("i"), F.lit("unreadable_line").alias("e"), (p["i"] + 2).cast("string").alias("d"))),
        F.transform(F.filter("_items", lambda p: ~(p["same"] & p["owner"].isNotNull()) & ~p["indented"]),
                    lambda p: F.struct(p["i"].alias("i"), F.lit("unreadable_line").alias("e"),
                                       (p["i"] + 2).cast("string").alias("d"))),
        F.transform(F.filter("_k", lambda p, n: F.array_position(keys, p["key"]) <= n),
                    lambda p: F.struct(p["i"].alias("i"), F.lit("duplicate_key").alias("e"), p["key"].alias("d"))))
    d = staged(d, _bad=let(bad, lambda b: F.when(F.size(b) > 0, F.array_min(b))))
    d = staged(d, fm_error=F.when(~F.col("_open"), "no_fence").when(F.col("_close") == 0, "not_closed")
               .otherwise(F.col("_bad.e")),
               fm_detail=F.when(F.col("_open") & (F.col("_close") > 0), F.col("_bad.d")))

    def entry(k: Column) -> Column:
        items = F.transform(F.filter("_items", lambda p: p["same"] & (p["owner"] == k["i"])), lambda p: p["value"])
        vals = (F.when(k["kind"] == "block", items).when(k["kind"] == "inline", _split_list(k["value"]))
                .otherwise(F.array(_unquote(k["value"]))))
        return F.struct(k["key"], F.struct((k["kind"] != "scalar").alias("is_list"), vals.alias("items")))
    d = staged(d, fm=F.when(F.col("fm_error").isNull(), F.map_from_entries(F.transform("_k", entry))))
    return d.drop("_ls", "_open", "_close", "_p", "_k", "_kp", "_bp", "_items", "_bad")


def scalar(fm: Column, key: str) -> Column:
    """Trimmed scalar; empty for a list or a missing key."""
    v = fm[F.lit(key)]
    return F.coalesce(F.when(~v["is_list"], strip(v["items"][0])), F.lit(""))


def values(fm: Column, key: str) -> Column:
    """Non-blank values of a list or a scalar; empty array when missing."""
    got = F.filter(F.transform(fm[F.lit(key)]["items"], strip), lambda x: x != "")
    return F.coalesce(got, F.array().cast("array<string>"))


def filled(fm: Column, key: str) -> Column:
    return F.size(values(fm, key)) > 0


def properties(notes: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """Long table: one row per (note, key, position)."""
    d = with_frontmatter(notes, text).filter("fm is not null")
    d = d.select(key, F.explode("fm").alias("key", "v"))
    return d.select(key, "key", "v.is_list", F.posexplode("v.items").alias("pos", "value"))


def lenient_fields(text: Column) -> Column:
    """The class gate's own reading: three scalars, two lists, ``ok`` for a
    closed fence.  Unknown lines are skipped, a later key wins."""
    def bare(v: Column) -> Column:
        return sub(sub(v, r"^[\"']", ""), r"[\"']$", "")

    def closing(ls: Column) -> Column:
        return F.array_position(F.transform(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))),
                                            lambda x: strip(x) == "---"), F.lit(True)).cast("int")

    def parse(ls: Column, close: Column) -> Column:
        kv = r"^([A-Za-z_][A-Za-z0-9_]*):\s*(.*)$"
        head = F.transform(F.slice(ls, 2, F.greatest(close - 1, F.lit(0))), lambda x: sub(x, r"\s+$", ""))
        rows = F.transform(head, lambda x, i: F.struct(
            i.alias("i"), F.regexp_extract(x, kv, 1).alias("k"), strip(F.regexp_extract(x, kv, 2)).alias("v"),
            x.rlike(r"^\s*-\s+").alias("item"), strip(sub(x, r"^\s*-\s+", "")).alias("iv")))
        ok = (strip(F.get(ls, F.lit(0))) == "---") & (close > 0)
        return let(rows, lambda r: fields(r, ok))

    def fields(rows: Column, ok: Column) -> Column:
        solid = F.transform(F.filter(rows, lambda r: ~r["item"]), lambda r: r["i"])

        def one(name: str) -> Column:
            hit = F.filter(rows, lambda r: (r["k"] == name) & (r["v"] != ""))
            return bare(F.try_element_at(hit, F.lit(-1))["v"])

        def many(name: str) -> Column:
            inline = F.filter(rows, lambda r: (r["k"] == name) & r["v"].startswith("["))
            last = F.try_element_at(inline, F.lit(-1))["v"]
            listed = F.coalesce(F.filter(F.transform(F.split(sub(last, r"^\[|\]$", ""), ","),
                                                     lambda x: bare(strip(x))), lambda x: x != ""),
                                F.array().cast("array<string>"))
            openers = F.transform(F.filter(rows, lambda r: (r["k"] == name) & (r["v"] == "")), lambda r: r["i"])
            owned = F.filter(rows, lambda r: r["item"] & F.array_contains(openers, F.coalesce(
                F.array_max(F.filter(solid, lambda s: s < r["i"])), F.lit(-1))))
            return F.concat(listed, F.transform(owned, lambda r: bare(r["iv"])))
        return F.struct(ok.alias("ok"), one("data_class").alias("data_class"), one("section").alias("section"),
                        one("source").alias("source"), many("projects").alias("projects"),
                        many("sources").alias("sources"))
    return let(lines_of(text), lambda ls: let(closing(ls), lambda close: parse(ls, close)))
