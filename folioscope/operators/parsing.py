"""Projections of notes, pages and documents into tables (no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import frontmatter as fm
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U


def title_chain(text: Column, base: Column) -> Column:
    """Quoted head title, else the first level-1 heading, else the file name
    without extension and date."""
    quoted = T.blank_to_null(F.regexp_extract(text, r'(?m)^title:\s*"([^"]+)"', 1))
    heading = T.blank_to_null(T.strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)))
    return F.coalesce(quoted, heading, file_title(base))


def file_title(base: Column) -> Column:
    return T.sub(T.sub(base, r"\.md$", ""), r"^\d{4}-\d{2}-\d{2}\s*[—–-]\s*", "")


def date_chain(text: Column, base: Column, mtime: Column) -> Column:
    pick = [T.first_match(text, r"(?m)^updated:\s*(\S+)"), T.first_match(text, r"(?m)^created:\s*(\S+)"),
            T.first_match(base, r"^(\d{4}-\d{2}-\d{2})"), F.date_format(mtime, "yyyy-MM-dd")]
    return T.sub(F.coalesce(*pick), r"[\"']", "")


def head_date(head: Column, key: str) -> Column:
    return T.blank_to_null(F.regexp_extract(head, rf"(?m)^{key}:\s*[^\n]*?(\d{{4}}-\d{{2}}-\d{{2}})", 1))


def body_chars(text: Column) -> Column:
    return F.length(T.strip(T.sub(text, r"(?s)^---.*?\n---", "")))


def sections(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per level-2/3 heading; the body runs to the next level-2 heading."""
    d = notes.select(key, T.lines_of(F.col(text)).alias("ls"))
    d = d.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("ls") - 1),
                                       lambda i: F.get("ls", i).rlike(r"^#{2,3}\s")))
    d = d.withColumn("tops", F.filter("heads", lambda i: F.get("ls", i).rlike(r"^##\s")))
    d = d.select(key, "ls", "tops", F.posexplode("heads").alias("ord", "i"))
    nxt = F.coalesce(F.array_min(F.filter("tops", lambda t: t > F.col("i"))), F.size("ls"))
    line = F.get("ls", F.col("i"))
    return d.select(key, "ord", F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("level"),
                    T.strip(T.sub(line, r"^#+\s+", "")).alias("heading"),
                    F.array_join(F.slice("ls", F.col("i") + 2, nxt - F.col("i") - 1), "\n").alias("body"))


def named_section(text: Column, names: Sequence[str]) -> Column:
    """Body of the first name in the list that occurs as a level-2 heading."""
    import re
    return F.coalesce(*[T.section_body(text, rf"(?iu)^##\s+{re.escape(n)}(?:\s|$)") for n in names])


def clean_section(text: Column, names: Sequence[str], limit: int = 420) -> Column:
    body = named_section(text, names)
    body = T.squeeze(T.sub(T.sub(body, r"(?s)```.*?```", ""), r"(?m)^[-*]\s+", ""))
    return F.coalesce(F.substring(body, 1, limit), F.lit(""))


def first_paragraph(text: Column, limit: int = 420) -> Column:
    t = T.strip(T.sub(T.sub(T.sub(text, r"(?s)<!--.*?-->", ""), r"\r", ""), r"\n{3,}", "\n\n"))
    paras = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: T.strip(T.sub(p, r"\n", " "))), lambda p: p != "")
    p = F.coalesce(F.get(paras, F.lit(0)), F.lit(""))
    return F.when(F.length(p) > limit, F.concat(T.strip(F.substring(p, 1, limit - 1)), F.lit("..."))).otherwise(p)


def inferred_title(text: Column, fallback: Column, opening: int | None = 500) -> Column:
    """Address in the first ``opening`` characters, else the first line of title length."""
    url = F.regexp_extract(T.compact(text, opening), T.ascii_edges(r"\bhttps?://[^\s)]+"), 0)
    from_url = F.substring(T.sub(T.sub(url, r"^https?://", ""), r"[?#].*$", ""), 1, 90)
    cut = F.transform(F.split(text, r"\n|[.!?]\s+"), lambda x: T.compact(x, 120))
    line = F.get(F.filter(cut, lambda x: F.length(x).between(18, 120) & ~x.rlike(rules.TITLE_BOILER)), F.lit(0))
    return F.coalesce(F.when(url != "", from_url), line, fallback)


def media_tier(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return (F.when(ext.isin(rules.TEXT_EXT), 0).when(ext.isin(rules.DOCUMENT_EXT), 1)
            .when(ext.isin(rules.IMAGE_EXT), 2).when(ext.isin(rules.AV_EXT), 3).otherwise(1))


def engines(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return (F.when(ext.isin(rules.TEXT_EXT), "text-read").when(ext.isin(rules.AV_EXT), "ffmpeg,whisper,vision-ocr")
            .when(ext.isin(rules.IMAGE_EXT), "vision-ocr").when(ext.isin(rules.CONVERTED_EXT), "markitdown")
            .otherwise(""))


# -- links ----------------------------------------------------------------------

def link_target(display: Column) -> Column:
    t = F.get(F.split(F.get(F.split(F.get(F.split(display, r"\|"), F.lit(0)), "#"), F.lit(0)), r"\^"), F.lit(0))
    return T.sub(T.strip(t), r"\\+$", "")


def wikilinks(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line, pos, display, target) of every link outside code."""
    d = notes.select(key, F.posexplode(T.lines_of(T.mask_code(F.col(text)))).alias("line", "ltext"))
    d = d.filter(F.col("ltext").contains("[["))
    d = d.select(key, (F.col("line") + 1).alias("line"),
                 F.posexplode(T.find_all(F.col("ltext"), r"\[\[([^\]\n]+)\]\]", 1)).alias("pos", "display"))
    d = d.withColumn("target", link_target(F.col("display")))
    return d.filter((F.col("target") != "") & ~F.col("target").rlike(r"(?i)^(https?|mailto):"))


def link_kind(target: Column) -> Column:
    t = T.strip(target)
    return (F.when(t.isin("", "...", "…", "note", "Название"), "placeholder")
            .when(t.rlike(r"\\$"), "escaped-link")
            .when(t.rlike(r"(?i)\.(pdf|docx?|xlsx?|pptx?|png|jpe?g|webp|heic|mov|mp4|canvas)$"), "file-or-asset")
            .when(t.contains("/"), "path-link")
            .when(t.rlike(r"(?iu)^[A-ZА-ЯЕ0-9 _-]{2,}$") & (F.length(t) <= 40), "concept")
            .otherwise("missing-note"))


LINK_ACTIONS = {"placeholder": "drop or replace with a real note", "escaped-link": "remove the stray backslash",
                "file-or-asset": "use a plain link or a wrapper note", "path-link": "correct the path",
                "concept": "write a short concept note", "missing-note": "find the new name, bridge or drop"}


def link_action(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LINK_ACTIONS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


# -- mappings ---------------------------------------------------------------------

def mapped_type(old: Column, has_all_tool_fields: Column) -> Column:
    t = T.fold_yo(old)
    keep = [x for x in rules.TYPES if x not in ("decision", "tool-card")]
    return (F.when(has_all_tool_fields, "tool-card").when(t.isin(keep), t)
            .when(t.rlike(rules.REFERENCE_SUFFIX) | (t == "redirect"), "reference")
            .when(t.rlike(rules.SYNTHESIS_PART), "synthesis").otherwise("concept"))


def mapped_verified(old: Column) -> Column:
    """struct(value, keep_legacy); never claims a check that did not happen."""
    v = T.fold_yo(F.coalesce(old, F.lit("")))
    annotated = F.lit(None).cast("string")
    for word in reversed(rules.VERIFIED):
        annotated = F.when(v.rlike(rf"^{word}[\s(]"), word).otherwise(annotated)
    none = "не-проверялось"
    value = (F.when(v.isin(rules.VERIFIED), v).when(annotated.isNotNull(), annotated)
             .when(v.rlike(rules.YES_FORMS) | (v == rules.PUBLIC_SOURCES_FORM), "подтвержден").otherwise(none))
    keep = (F.when(v.isin(rules.VERIFIED), False).when(annotated.isNotNull(), True)
            .when(v.rlike(rules.YES_FORMS), v != "подтвержден").when(v == rules.PUBLIC_SOURCES_FORM, True)
            .when((v == "") | v.rlike(rules.NO_FORMS), False).otherwise(True))
    return F.struct(value.alias("value"), keep.alias("keep_legacy"))


def mapped_status(old: Column) -> Column:
    v = T.fold_yo(F.coalesce(old, F.lit("")))
    yes = v.isin("verified", "verified-with-public-sources") | v.rlike(r"^подтвержд")
    value = (F.when((v == "") | v.isin(rules.UNKNOWN_STATUS) | v.contains("частично"), "не-проверялось")
             .when(yes, "подтвержден").when(v.isin("источник-не-найден", "непроверяемо-методом"), v)
             .otherwise("не-проверялось"))
    keep = (F.when((v == "") | v.isin(rules.UNKNOWN_STATUS), False).when(v.contains("частично"), True)
            .when(yes, v != "verified").when(v.isin("источник-не-найден", "непроверяемо-методом"), False)
            .otherwise(True))
    return F.struct(value.alias("value"), keep.alias("keep_legacy"))


def case_stem(word: Column, floor: int = 5) -> Column:
    """One case ending cut off, the longest that leaves ``floor`` letters."""
    out = word
    for end in reversed(rules.CASE_ENDINGS):
        out = F.when(word.endswith(end) & (F.length(word) - len(end) >= floor),
                     F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def project_slugs(text: Column) -> Column:
    """Names a project may be called by, from the level-2 headings of a list."""
    heads = T.find_all(text, r"(?m)^##\s+(.+?)\s*$", 1)
    quoted = F.flatten(F.transform(heads, lambda h: T.find_all(h, r"«([^»]+)»", 1)))
    words = F.flatten(F.transform(heads, lambda h: F.filter(
        F.transform(F.split(h, r"\s+"), lambda w: T.sub(w, r"[«»()\"'.,:;]", "")),
        lambda w: (F.length(w) >= 5) & w.rlike("[A-Za-z]"))))
    names = F.transform(F.concat(heads, quoted), T.fold_yo)
    stems = F.transform(F.filter(names, lambda n: n.rlike(r"^[а-яё]+$")), case_stem)
    return F.array_distinct(F.filter(F.concat(names, stems, F.transform(words, T.fold_yo)), lambda x: x != ""))


def source_basenames(text: Column) -> Column:
    """File names listed under source/sources in the head, any list form."""
    head = F.when(text.startswith("---"), T.sub(F.substring(text, F.lit(4), F.length(text)), r"(?s)\n---.*$", ""))
    kv = r"(?i)^\s*(sources?):\s*(.*)$"
    rows = F.transform(T.lines_of(head), lambda x, i: F.struct(
        i.alias("i"), x.rlike(kv).alias("key"), T.strip(F.regexp_extract(x, kv, 2)).alias("v"),
        x.rlike(r"^\s*-\s*(.+)$").alias("item"), F.regexp_extract(x, r"^\s*-\s*(.+)$", 1).alias("iv"),
        (T.strip(x) == "").alias("blank")))
    stops = F.transform(F.filter(rows, lambda r: r["key"] | ~(r["item"] | r["blank"])), lambda r: r["i"])
    opens = F.transform(F.filter(rows, lambda r: r["key"] & (r["v"] == "")), lambda r: r["i"])
    raw = F.concat(
        F.transform(F.filter(rows, lambda r: r["key"]), lambda r: r["v"]),
        F.transform(F.filter(rows, lambda r: r["item"] & ~r["key"] & F.array_contains(
            opens, F.coalesce(F.array_max(F.filter(stops, lambda s: s < r["i"])), F.lit(-1)))), lambda r: r["iv"]))
    parts = F.flatten(F.transform(raw, lambda v: F.split(T.sub(v, r"^\[|\]$", ""), ",")))
    clean = F.transform(parts, lambda p: T.sub(T.sub(T.strip(p), r"^[\"']|[\"']$", ""), r"^.*/(?=[^/])", ""))
    return F.coalesce(F.array_distinct(F.filter(clean, lambda x: x != "")), F.array().cast("array<string>"))


# -- rewriting ----------------------------------------------------------------------

def _spell(pattern: str) -> str:
    return "(?iu)" + pattern.replace("<", rules.NOT_AFTER_LETTER, 1).replace(">", rules.NOT_BEFORE_LETTER) \
        if "(?<" not in pattern else pattern


def rewrite_stock_phrases(text: Column) -> Column:
    """Remove or replace stock phrases; the case of a replaced word is kept."""
    def guarded(anchors: Sequence[str], pattern: str, repl: str):
        return lambda s: F.when(T.has_any(s["low"], anchors), T.cased(T.sub(s["text"], _spell(pattern), repl))).otherwise(s)
    s = T.cased(text)
    for anchors, (pattern, repl) in zip(rules.REWRITE_ANCHORS, rules.REWRITES):
        s = T.let(s, guarded(anchors, pattern, repl))
    s = T.let(s, lambda s: F.when(s["low"].contains("анн") & s["text"].rlike("(?iu)" + "|".join(rules.DEMONSTRATIVES)),
                                  T.cased(_demonstratives(s["text"]))).otherwise(s))
    for pattern, repl in rules.COPULA:
        s = T.let(s, guarded(["явля"], pattern, repl))
    return s["text"]


def _demonstratives(text: Column) -> Column:
    before, after = rules.NOT_AFTER_LETTER, rules.NOT_BEFORE_LETTER
    for word, repl in rules.DEMONSTRATIVES.items():
        text = T.sub(text, f"{before}{word[0].upper()}(?iu:{word[1:]}){after}", repl[0].upper() + repl[1:])
        text = T.sub(text, f"{before}{word[0]}(?iu:{word[1:]}){after}", repl)
    return text


def redact(text: Column, wording: Sequence[tuple[str, str]] = rules.REDACTIONS) -> Column:
    """Display form of a text: a rule list applied in order, ends stripped
    (``rules.REDACTIONS`` for briefs, ``rules.REPORT_WORDING`` for run reports)."""
    def step(pattern: str, repl: str):
        def apply(s: Column) -> Column:
            new = T.cased(T.sub(s["text"], T.ascii_edges(pattern), repl))
            return F.when(T.has_any(s["low"], rules.WORDING_ANCHORS[pattern]), new).otherwise(s)
        return apply
    s = T.cased(text)
    for i, (pattern, repl) in enumerate(wording):
        if (pattern, repl) == (r"\s+", " ") and i == len(wording) - 1:
            return T.squeeze(s["text"])
        s = T.let(s, step(pattern, repl)) if pattern in rules.WORDING_ANCHORS else T.cased(T.sub(s["text"], T.ascii_edges(pattern), repl))
    return T.strip(s["text"])


# -- pages ----------------------------------------------------------------------------

def page_records(pages: DataFrame) -> DataFrame:
    h, u = F.col("html"), F.col("url")
    return pages.select("page_id", "url", H.title(h, u).alias("title"), H.description(h).alias("description"),
                        H.to_text(h).alias("text"), H.structured_data(h).alias("structured"),
                        H.api_hints(h, u).alias("api"), H.doc_links(h, u).alias("docs"),
                        U.repositories(h).alias("repos"))


def page_verdict(text: Column, html: Column, url: Column, script: str = T.CYRILLIC, min_share: float = 0.15,
                 domains: str = r"\.(ru|xn--p1ai|su)(/|$)", min_chars: int = 400, challenge_chars: int | None = None) -> Column:
    """Why a fetched page is not usable, or ``ok``; first failing test wins.

    Challenge texts are looked for in the whole page, or in its first
    ``challenge_chars`` characters.
    """
    low = F.lower(url)
    media = F.lit(False)
    for m in rules.MEDIA_HOSTS:
        media = media | low.contains(m)
    blocked, garbled = F.lit(False), F.lit(False)
    for c in rules.CHALLENGE_TEXTS:
        blocked = blocked | (html if challenge_chars is None else F.substring(html, 1, challenge_chars)).contains(c)
    for m in rules.MOJIBAKE:
        garbled = garbled | text.contains(m)
    letters = T.count_of(text, r"\p{L}")
    share = F.when(letters > 0, T.count_of(text, script) / letters).otherwise(0.0)
    return (F.when(media, "media").when(blocked, "challenge")
            .when((text != "") & low.rlike(domains) & (share < min_share), "wrong-script")
            .when(garbled, "mojibake").when(T.repeated_line_share(text) > 0.4, "boilerplate")
            .when(F.length(text) < min_chars, "too-short").otherwise("ok"))


# -- list lines -------------------------------------------------------------------------

def strip_markup(v: Column) -> Column:
    v = T.sub(v, r"!\[[^\]]*]\([^)]+\)", "")
    v = T.sub(v, r"\[([^\]]+)]\([^)]+\)", "$1")
    v = T.sub(T.sub(v, r"`([^`]+)`", "$1"), r"<[^>]+>", "")
    return T.squeeze(v)


def list_entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Curated-list lines as records; the category is the last level-3 heading.

    All lines of a list sit in one row, so the heading above a line is looked up
    in that row's array and the list is never shuffled by document.
    """
    head = r"^###\s+(.+?)\s*$"
    d = docs.select(key, F.split(F.col(text), r"\r?\n").alias("ls"))
    d = d.withColumn("hs", F.filter(F.transform("ls", lambda x, i: F.struct(
        i.alias("i"), F.regexp_extract(x, head, 1).alias("h"))), lambda s: s["h"] != ""))
    d = d.select(key, "hs", F.posexplode("ls").alias("line", "raw"))
    rx = r"^- \[([^\]]+)]\((https://github\.com/[^)\s]+)\)(.*)$"
    d = d.filter(F.col("raw").startswith("- [") & F.col("raw").rlike(rx))
    d = T.staged(d, tail=T.sub(F.regexp_extract("raw", rx, 3), r"\[!\[[^\]]*]\([^)]+\)]\([^)]+\)", " "))
    owner = F.try_element_at(F.filter("hs", lambda s: s["i"] < F.col("line")), F.lit(-1))["h"]
    category = T.strip(T.sub(strip_markup(owner), r"^[^\p{L}\p{N}]+", ""))
    tail = F.col("tail")
    has_sep = tail.rlike(r"\s-\s")
    flags = F.when(has_sep, F.regexp_extract(tail, r"^(.*?)\s-\s", 1)).otherwise(tail)
    desc = F.when(has_sep, T.sub(tail, r"^.*?\s-\s", "")).otherwise(tail)
    desc = T.strip(T.sub(strip_markup(desc), r"\s*[—–-]\s*$", ""))

    def marked(marks: dict[str, str]) -> Column:
        picks = F.array(*[F.when(F.col("flags").contains(k), v) for k, v in marks.items()])
        return F.filter(picks, lambda x: x.isNotNull())
    repo = U.repository_of(T.sub(F.regexp_extract("raw", rx, 2), r"[.,;]+$", ""))
    d = T.staged(d, repo=repo).filter("repo is not null")
    d = T.staged(d, name=strip_markup(F.regexp_extract("raw", rx, 1)),
                 category=F.coalesce(T.let(category, T.blank_to_null), F.lit("Uncategorized")),
                 description=F.coalesce(T.let(desc, T.blank_to_null), F.lit("no description")), flags=flags)
    return d.select(
        key, "line", "name", "repo", "category", "description", marked(rules.LANGUAGE_MARKS).alias("languages"),
        marked(rules.SCOPE_MARKS).alias("scopes"), marked(rules.OS_MARKS).alias("os"),
        F.col("flags").contains(rules.OFFICIAL_MARK).alias("official"))


def list_risk(description: Column, scopes: Column, category: Column) -> Column:
    t = F.lower(F.concat_ws(" ", description, F.array_join(scopes, " "), category))
    return (F.when(t.rlike(rules.HIGH_RISK), rules.RISK_TEXT["high"])
            .when(t.rlike(rules.MEDIUM_RISK), rules.RISK_TEXT["medium"]).otherwise(rules.RISK_TEXT["low"]))


def list_categories(description: Column, category: Column, name: Column, keep: int = 6) -> Column:
    def named(low: Column, pattern: str) -> Column:
        plain, rest = T.alternatives(pattern.removeprefix("(?i)"))
        hit = T.has_any(low, plain)
        return hit | low.rlike("|".join(rest)) if rest else hit

    def hits(low: Column) -> Column:
        fits = F.array(*[F.when(category.rlike(p), rules.CATEGORIES[c]) for p, c in rules.LIST_CATEGORY_FITS],
                       *[F.when(named(low, p), rules.CATEGORIES[c]) for p, c in rules.LIST_KEYWORD_FITS])
        return F.array_distinct(F.filter(fits, lambda x: x.isNotNull()))
    found = T.let(T.ascii_lower(F.concat_ws(" ", category, description, name)), hits)
    return T.let(found, lambda hit: F.when(F.size(hit) > 0, F.slice(hit, 1, keep)).otherwise(
        F.array(F.lit(rules.CATEGORIES[rules.LIST_CATEGORY_DEFAULT]))))


def install_hint(description: Column, default: str) -> Column:
    a = F.regexp_extract(description, r"(?i)(?:Install:|install(?: with)?:?)\s*`([^`]+)`", 1)
    b = F.regexp_extract(description, r"(?i)`((?:npx|uvx|pip install|docker|go install|cargo install)[^`]+)`", 1)
    return F.coalesce(T.blank_to_null(a), T.blank_to_null(b), F.lit(default))


def list_tags(entries: DataFrame, lead: Sequence[str]) -> DataFrame:
    """At most twelve distinct tags of an entry, fixed ones first."""
    def tag(v: Column) -> Column:
        return F.translate(T.slug(v, 110, "entry"), "-", "_")
    # both are staged: whoever explodes the tags filters on them, which would make them all again
    d = T.staged(entries, _cats=list_categories(F.col("description"), F.col("category"), F.col("name")))
    tags = F.concat(F.array(*[F.lit(x) for x in lead], tag(F.col("category"))),
                    F.transform("_cats", lambda c: F.concat(F.lit("project_category_"), tag(c))),
                    F.transform("languages", tag), F.transform("scopes", tag))
    return T.staged(d, tags=F.slice(F.array_distinct(tags), 1, 12)).drop("_cats")


# -- topics -----------------------------------------------------------------------------

def topic_of(text: Column) -> Column:
    def pick(low: Column) -> Column:
        out = F.lit(rules.TOPIC_DEFAULT)
        for tid, _title, pattern in reversed(rules.TOPICS):
            plain, rest = T.alternatives(pattern.replace("(?iu)", "").replace("(?i)", ""))
            hit = T.has_any(low, plain)
            out = F.when(hit | low.rlike("|".join(rest)) if rest else hit, tid).otherwise(out)
        return out
    return T.let(F.lower(text), pick)


def public_sources(text: Column, keep: int = 10) -> Column:
    """Explicit addresses and hinted sources, one per address, later name wins."""
    return T.let(text, lambda t: _public_sources(t, keep))


def _public_sources(text: Column, keep: int) -> Column:
    explicit = F.transform(U.extract_urls(text), lambda u: F.struct(
        F.when(u.contains("github.com"), "GitHub source").otherwise("Source link").alias("name"), u.alias("url")))
    hinted = F.filter(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(u).alias("url")))
                                for p, n, u in rules.SOURCE_HINTS]), lambda s: s.isNotNull())

    def by_url(both: Column) -> Column:
        urls = F.array_distinct(F.transform(both, lambda s: s["url"]))
        return F.transform(F.slice(urls, 1, keep), lambda u: F.struct(
            F.element_at(F.filter(both, lambda s: s["url"] == u), -1)["name"].alias("name"), u.alias("url")))
    return T.let(F.concat(explicit, hinted), by_url)


# -- marked text --------------------------------------------------------------------------

def first_marker(text: Column, markers: Sequence[tuple[str, str]] = tuple(rules.RAW_MARKERS)) -> Column:
    return F.coalesce(*[F.when(text.rlike(T.ascii_edges(p)), n) for n, p in markers])


def strictly_ready(text: Column) -> Column:
    """Four exact head facts, two fact bullets and an address in the sources."""
    def after(label: str) -> Column:
        pos = F.instr(text, label)
        tail = F.substring(text, pos + len(label), F.length(text))
        return F.when(pos > 0, T.sub(tail, r"(?s)\n##\s+.*$", ""))
    facts = F.concat_ws("\n", after("External facts added before atomization:"),
                        after("Факты, добавленные до атомизации:"))
    sources = F.concat_ws("\n", after("Public/source expansion:"), after("Публичные источники:"))
    real = F.filter(T.lines_of(facts), lambda x: x.rlike(r"^\s*-\s+\S") & ~x.rlike(
        r"(?iu)No external enrichment facts recorded|Внешние факты не записаны"))
    return (text.rlike(r'(?m)^status:\s*"final"\s*$') & text.rlike(r'(?m)^verified:\s*(?:true|"?подтвержд[её]н"?)\s*$')
            & text.rlike(r'(?m)^verification_status:\s*"verified"\s*$')
            & text.rlike(r'(?m)^enrichment:\s*"external-research"\s*$')
            & (F.size(real) >= 2) & sources.rlike(r"(?i)https?://"))


def service_path(path: Column, derived: str = rules.GRAPH_FOLDER) -> Column:
    """Paths the note gates do not judge."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return (path.contains(f"/{derived}/") | path.rlike(r"/_legacy-index |/_архив-дублей/|/Capabilities/_|^99 Система/|^00 System/")
            | base.isin("_Содержание.md", "_МАСТЕР-ИНДЕКС.md", "_ROUTING.md", "_ШАБЛОНЫ.md")
            | path.isin("AGENTS.md", "CLAUDE.md", "_ROUTING.md", "Лог обработки.md"))


def hidden_path(path: Column, derived: str = rules.GRAPH_FOLDER) -> Column:
    """Paths the readability gates do not judge: a segment that starts with a
    dot or an underscore, or anything of the derived graph folder."""
    return path.rlike(r"(^|/)[._]") | path.contains(derived)


def lint_service_path(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return (path.startswith("99 Система/") | path.startswith("00 Входящие/") | path.rlike(r"(^|/)_")
            | base.rlike(r"(?i)^(AGENTS|CLAUDE|README)\.md$") | base.startswith("Лог ")
            | base.startswith("Без названия"))


def embedded_path(path: Column, derived: str = rules.GRAPH_FOLDER) -> Column:
    """Paths the vector index takes: nothing under the derived graph folder or the folders of tools, and no segment
    that starts with an underscore, as a copy in a service folder is no finding."""
    tools = F.lit(False)
    for folder in (derived, ".git", ".obsidian"):
        tools = tools | path.contains(f"/{folder}/")
    return ~tools & ~path.rlike(r"(^|/)_")


def changed_since(df: DataFrame, since: str | None, column: str = "mtime") -> DataFrame:
    """Keep rows at or after a timestamp; a value that is no time keeps all."""
    if since is None:
        return df
    try:
        float(since)
        bound = F.timestamp_millis(F.lit(int(float(since))))
    except ValueError:
        import datetime as dt
        try:
            bound = F.lit(dt.datetime.fromisoformat(since))
        except ValueError:
            return df
    return df.filter(F.col(column) >= bound)


def has_structured_source(df: DataFrame) -> Column:
    """Needs ``fm`` and ``body``; a mention in running text does not count."""
    return F.coalesce(fm.filled(F.col("fm"), "source"), F.lit(False)) | F.coalesce(
        T.strip(T.section_body(F.col("body"), rules.SOURCE_HEADING)) != "", F.lit(False))
