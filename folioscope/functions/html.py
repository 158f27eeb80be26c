"""Column expressions over one HTML page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, find_all, first_match, matches, squeeze, strip, sub


def to_text(html: Column) -> Column:
    """Readable text: script and style out, block ends as newlines, headings
    marked, tags and entities resolved, space squeezed."""
    t = sub(html, r"(?is)<script.*?</script>", " ")
    t = sub(t, r"(?is)<style.*?</style>", " ")
    t = sub(t, r"(?i)</(h[1-4]|p|li|section|article|div)>", "\n")
    t = sub(t, r"(?i)<h([1-4])[^>]*>", "\n### ")
    t = sub(t, r"<[^>]+>", " ")
    t = sub(sub(t, "&nbsp;", " "), "&amp;", "&")
    t = sub(sub(t, "&quot;", '"'), "&#39;|&#x27;", "'")
    t = sub(t, r"\s+\n", "\n")
    t = sub(t, r"[ \t]{2,}", " ")
    return strip(sub(t, r"\n{3,}", "\n\n"))


def decode_entities(t: Column) -> Column:
    for pattern, char in (("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&"),
                          ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        t = sub(t, pattern, char)
    return t


def to_lines(html: Column) -> Column:
    """Second reading of a page: every tag and comment breaks the line."""
    t = sub(html, r"(?is)<script.*?</script>", "\n")
    t = sub(t, r"(?is)<style.*?</style>", "\n")
    t = sub(t, r"(?s)<!--.*?-->", "\n")
    t = decode_entities(sub(t, r"<[^>]+>", "\n"))
    return strip(sub(sub(t, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def flat_text(html: Column) -> Column:
    """Third reading: one line, for report gates."""
    t = sub(html, r"(?is)<script.*?</script>", " ")
    t = sub(sub(t, r"(?is)<style.*?</style>", " "), r"<[^>]+>", " ")
    return squeeze(sub(sub(t, "&nbsp;", " "), "&amp;", "&"))


def title(html: Column, url: Column) -> Column:
    raw = F.coalesce(first_match(html, r"(?is)<h1[^>]*>(.*?)</h1>"),
                     first_match(html, r"(?is)<title[^>]*>(.*?)</title>"), url)
    return to_text(raw)


def description(html: Column) -> Column:
    kind = r"(?:name|property)=[\"'](?:description|og:description)[\"']"
    before = r"(?i)<meta[^>]+" + kind + r"[^>]*content=[\"']([^\"']+)[\"']"
    after = r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*" + kind
    return strip(F.coalesce(first_match(html, before), first_match(html, after), F.lit("")))


def structured_data(html: Column, keep: int = 12) -> Column:
    """``type: name`` of each JSON-LD node; a list and an @graph are unfolded.

    A block that is not JSON yields null variants and drops out.
    """
    blocks = find_all(html, r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)

    def nodes(block: Column) -> Column:
        v = F.try_parse_json(strip(block))
        listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                            F.try_variant_get(v, "$['@graph']", "array<variant>"))
        return F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(listed, F.array(v)))

    def label(n: Column) -> Column:
        kind = F.coalesce(
            F.array_join(F.try_variant_get(n, "$['@type']", "array<string>"), "/"),
            F.try_variant_get(n, "$['@type']", "string"), F.lit(""))
        name = F.lit("")
        for key in ("title", "headline", "name"):
            v = F.coalesce(F.try_variant_get(n, f"$.{key}", "string"), F.lit(""))
            name = F.when(v != "", v).otherwise(name)
        name = F.substring(strip(name), 1, 160)
        return F.when((kind != "") | (name != ""), F.concat(
            F.when(kind != "", kind).otherwise(F.lit("Thing")),
            F.when(name != "", F.concat(F.lit(": "), name)).otherwise(F.lit(""))))

    labels = F.transform(F.flatten(F.transform(blocks, nodes)), label)
    return F.slice(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())), 1, keep)


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case; empty for anything not http(s)."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://[^/?#\s]+", 0))


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a reference against the page address, fragment cut."""
    o = origin(base)
    scheme = F.regexp_extract(o, r"^https?:", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+)$", "$1/")
    folder = F.regexp_replace(folder, r"[^/]*$", "")
    page = F.regexp_replace(base, r"[?#].*$", "")
    full = (F.when(href.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(o, href))
            .when(href.startswith("#"), F.regexp_replace(base, r"#.*$", ""))
            .when(href.startswith("?"), F.concat(page, href))
            .otherwise(F.concat(folder, href)))
    return F.regexp_replace(full, r"#.*$", "")


def same_origin_links(html: Column, base: Column) -> Column:
    hrefs = find_all(html, r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']", 1)
    full = F.transform(hrefs, lambda h: resolve(h, base))
    return F.array_distinct(F.filter(full, lambda u: (origin(u) == origin(base)) & (origin(u) != "")))


def api_hints(html: Column, base: Column, keep: int = 15) -> Column:
    """Endpoint-like string literals of the inline scripts."""
    js = F.array_join(find_all(html, r"(?is)<script(?![^>]*\bsrc=)[^>]*>(.*?)</script>", 1), "\n")
    paths = find_all(js, r"[\"'`](/(?:api|v\d|graphql|rest|wp-json)/[A-Za-z0-9_\-/.{}:]*)[\"'`]", 1)
    urls = F.filter(find_all(js, r"[\"'`](https?://[^\"'`\s]+/(?:api|v\d|graphql)/[^\"'`\s]*)[\"'`]", 1),
                    lambda u: (origin(base) == "") | (origin(u) == origin(base)))
    return F.slice(F.array_distinct(F.concat(paths, urls)), 1, keep)


def doc_links(html: Column, base: Column, keep: int = 15) -> Column:
    """Links whose address or anchor text looks like documentation."""
    rx = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(find_all(html, rx, 1).alias("href"), find_all(html, rx, 2).alias("label"))

    def wanted(p: Column) -> Column:
        label = F.lower(to_text(p["label"]))
        return (matches(p["href"], r"(?i)/(docs?|documentation|guide|reference|api|manual|wiki)\b")
                | matches(label, r"\b(docs|documentation|guide|reference|api docs|manual)\b")
                | matches(p["href"], r"(?i)readthedocs|swagger|openapi|gitbook|docusaurus"))
    full = F.transform(F.filter(pairs, wanted), lambda p: resolve(p["href"], base))
    return F.slice(F.array_distinct(full), 1, keep)


def readme_points(text: Column, width: int = 220, keep: int = 6) -> Column:
    """Lines of a page that say something: no badges, links, code or markup."""
    from .text import looks_like_code

    def clean(line: Column) -> Column:
        return compact(sub(sub(line, r"^#+\s*", ""), r"^[-*]\s+", ""), width)

    def wanted(s: Column) -> Column:
        c, raw = s["clean"], s["raw"]
        return ((F.length(c) >= 32) & ~matches(c, r"^[,.;:]") & ~matches(c, r"(?i)^https?://")
                & ~matches(c, r"(?i)^(install|usage|license|contributing|table of contents|badges?)$")
                & ~matches(raw, r"(?i)^!\[|^<img|^\[!?\[|^window\.|^document\.|^function\s")
                & ~matches(c, r"(?i)\b(src|href|alt|title)=[\"'][^\"']*[\"']")
                & ~matches(c, r"(?i)https?://\S+\.(?:svg|png|jpe?g|gif|webp)(?:\?\S*)?$")
                & ~matches(c, r"(?is)<[a-z].*>") & ~looks_like_code(c))
    pairs = F.transform(F.split(to_lines(text), "\n"),
                        lambda x: F.struct(clean(x).alias("clean"), strip(x).alias("raw")))
    return F.slice(F.transform(F.filter(pairs, wanted), lambda s: s["clean"]), 1, keep)


