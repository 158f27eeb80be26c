"""Column expressions over addresses and repository names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_edges, find_all, let, sub


def host(url: Column) -> Column:
    """Lower-case host without port, user and ``www.``; empty when not http(s)."""
    raw = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1)
    return sub(F.lower(raw), r"^www\.", "")


def is_public(url: Column) -> Column:
    """An http(s) address whose host is neither local nor a private range."""
    h = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@\s]*@)?(\[[^\]]*\]|[^/?#:\s]+)", 1)
    h = sub(sub(F.lower(h), r"^\[|\]$", ""), r"\.$", "")

    def private4(o: Column) -> Column:
        a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
        return (F.exists(o, lambda x: x.isNull() | (x > 255)) | a.isin(0, 10, 127) | ((a == 169) & (b == 254))
                | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
                | ((a == 100) & b.between(64, 127)) | (a >= 224))

    def private6(x: Column) -> Column:
        return x.contains(":") & (x.isin("::", "::1") | x.rlike(r"^(fc|fd|fe80:|ff|2001:db8:)"))

    def octets(x: Column) -> Column:
        return F.transform(F.split(sub(x, "^::ffff:", ""), r"\."), lambda p: p.try_cast("int"))

    def verdict(x: Column) -> Column:
        local = (x == "localhost") | x.endswith(".localhost") | x.endswith(".local")
        numeric = x.rlike(r"^(::ffff:)?\d+\.\d+\.\d+\.\d+$")
        return (x != "") & ~local & ~F.when(numeric, let(octets(x), private4)).otherwise(private6(x))
    return F.coalesce(let(h, verdict), F.lit(False))


def extract_urls(text: Column, keep: int | None = 8) -> Column:
    """Explicit addresses, then bare repository hosts; public and distinct."""
    def found(t: Column) -> Column:
        explicit = find_all(t, ascii_edges(r"\bhttps?://[^\s)]+"))
        bare = find_all(t, ascii_edges(r"\bgithub\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"))
        return F.array_distinct(F.concat(explicit, F.transform(bare, lambda u: F.concat(F.lit("https://"), u))))
    clean = F.filter(F.transform(let(text, found), lambda u: sub(u, r"[.,;]+$", "")), is_public)
    return F.slice(clean, 1, keep) if keep else clean


def hosts_of(text: Column) -> Column:
    """Distinct hosts (port kept) of all addresses in a text."""
    raw = find_all(text, r"https?://([^/\s)]+)", 1)
    return F.array_distinct(F.transform(raw, lambda h: sub(h, r"^www\.", "")))


def repositories(text: Column) -> Column:
    rx = r"https://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
    pairs = let(text, lambda t: F.arrays_zip(find_all(t, rx, 1).alias("o"), find_all(t, rx, 2).alias("r")))
    named = F.transform(pairs, lambda p: F.struct(p["o"].alias("o"), sub(p["r"], r"(?i)\.git$", "").alias("r")))
    kept = F.filter(named, lambda p: (p["r"] != "") & ~p["r"].isin("releases", "blob"))
    return F.array_distinct(F.transform(kept, lambda p: F.concat(p["o"], F.lit("/"), p["r"])))


def repository_of(url: Column) -> Column:
    """``owner/repo`` of one address, null for other hosts or a cut-off name."""
    path = F.split(sub(sub(url, r"[?#].*$", ""), r"^(?i:https?)://[^/]+/?", ""), "/")
    owner, repo = F.get(path, F.lit(0)), sub(F.get(path, F.lit(1)), r"(?i)\.git$", "")
    ok = (host(url) == "github.com") & (owner != "") & (repo != "") & ~repo.endswith("-")
    return F.when(ok, F.concat(owner, F.lit("/"), repo))


def path_bits(url: Column) -> Column:
    """First two path segments joined by a slash; empty when there is no path."""
    path = sub(sub(url, r"[?#].*$", ""), r"^(?i:https?)://[^/]*", "")
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, 2), "/")
