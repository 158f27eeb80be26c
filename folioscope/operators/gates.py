"""Rule gates over notes: one row per failed rule, (path, rule, detail).

A gate is a set of column tests over one row, so it needs no shuffle; only the
summaries aggregate.  An empty input raises unless it is allowed explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import frontmatter as fm
from ..functions import html as H
from ..functions import numbers as N
from ..functions import text as T
from ..session import require_rows
from . import links as L
from . import parsing as P


def in_sections(notes: DataFrame, wanted: Sequence[str], column: str = "section") -> DataFrame:
    """Exact section names or two-digit prefixes; no match at all is an error."""
    test: Column = F.lit(False)
    for w in wanted:
        test = test | (F.col(column).startswith(w + " ") if w.isdigit() and len(w) == 2 else F.col(column) == w)
    out = notes.filter(test)
    if out.isEmpty():
        raise ValueError(f"no section matches {list(wanted)}")
    return out


def _fail(rule: str, test: Column, detail: Column | str | None = None) -> Column:
    d = F.lit(detail) if not isinstance(detail, Column) else detail
    return F.when(test, F.struct(F.lit(rule).alias("rule"), d.cast("string").alias("detail")))


def _rows(df: DataFrame, tests: list[Column], key: str = "path") -> DataFrame:
    """Explode the tests that fired; a row per failure."""
    return df.select(key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("f")).select(
        key, "f.rule", "f.detail")


def _hits(rule: str, found: Column, sep: str = " | ") -> Column:
    """Failure with the found strings as detail, none when there are none."""
    return T.let(found, lambda h: _fail(rule, F.size(h) > 0, F.array_join(h, sep)))


def failed_paths(failures: DataFrame, stop_after: int | None = None, key: str = "path") -> DataFrame:
    """Failing notes with their rules joined; optionally the first N of them."""
    d = failures.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return d.orderBy(key).limit(stop_after) if stop_after else d


# -- spec -------------------------------------------------------------------------

def spec_failures(notes: DataFrame, slugs: Sequence[str], changed: bool = False, allow_empty: bool = False) -> DataFrame:
    """Note form: head values, language share, help and trust blocks.

    ``changed`` adds what only a new note must carry.  ``slugs`` are the names
    a help block may mention (:func:`parsing.project_slugs`).
    """
    if not slugs:
        raise ValueError("no project names to judge the help block by")
    d = fm.with_frontmatter(require_rows(notes, "spec gate", allow_empty)).filter(~P.service_path(F.col("path")))
    f, body = F.col("fm"), F.col("body")
    d = T.staged(d, share=T.script_share(T.drop_urls(T.drop_code(body))), help=T.fold_yo(T.section_body(body, rules.HELP_HEADING)),
                 trust=T.section_body(body, rules.TRUST_HEADING), type=fm.scalar(f, "type"), subject=fm.scalar(f, "subject"),
                 cats=fm.values(f, "project_categories"), dclass=fm.scalar(f, "data_class"))
    ok = F.col("fm_error").isNull()
    unknown = F.filter("cats", lambda c: ~c.isin(*rules.CATEGORIES.values()))
    tests = [
        _fail("head", ~ok, F.col("fm_error")),
        _fail("source", ok & ~F.coalesce(fm.filled(f, "source"), F.lit(False))),
        _fail("type", ok & ~F.col("type").isin(rules.TYPES), F.col("type")),
        _fail("verified", ok & ~T.fold_yo(fm.scalar(f, "verified")).isin(rules.VERIFIED), fm.scalar(f, "verified")),
        _fail("subject", ok & (F.col("subject") != "") & ~F.col("subject").isin(rules.SUBJECTS), F.col("subject")),
        _fail("subject-self-foreign", ok & (F.col("subject") == "self") & fm.scalar(f, "source_type").isin(rules.FOREIGN_SOURCE_TYPES)),
        _fail("categories-unknown", ok & (F.size(unknown) > 0), F.array_join(unknown, " | ")),
        _fail("data-class", ok & (F.col("dclass") != "") & ~F.col("dclass").isin(rules.CLASS_ORDER), F.col("dclass")),
        _fail("script-share", F.col("share") < rules.MIN_SCRIPT_SHARE, F.concat(N.one_decimal(F.col("share") * 100), F.lit("%"))),
        _fail("help-missing", F.col("help").isNull()),
        _fail("help-no-project", F.col("help").isNotNull() & ~F.exists(
            F.array(*[F.lit(s) for s in slugs]), lambda s: F.col("help").contains(s))),
        _fail("trust-missing", F.col("trust").isNull()),
        _fail("trust-empty", F.col("trust").isNotNull() & (T.strip(F.col("trust")) == "")),
    ]
    for kind, keys in rules.REQUIRED_FIELDS.items():
        tests += [_fail("required-field", ok & (F.col("type") == kind) & ~F.coalesce(fm.filled(f, k), F.lit(False)), f"{kind}: {k}")
                  for k in keys]
    if changed:
        named = F.exists(F.transform("cats", T.fold_yo), lambda c: F.col("help").contains(c))
        tests += [_fail("subject-missing", ok & (F.col("subject") == "")), _fail("categories-missing", ok & (F.size("cats") == 0)),
                  _fail("help-no-category", F.col("help").isNotNull() & (F.size("cats") > 0) & ~named)]
    return _rows(d, tests)


def legacy_failures(notes: DataFrame, require_dossier: bool = False, allow_empty: bool = False) -> DataFrame:
    """Raw marker, no structured source, no meaning heading, dossier sections."""
    d = fm.with_frontmatter(require_rows(notes, "legacy gate", allow_empty)).filter(~P.service_path(F.col("path")))
    text = F.col("text")
    d = T.staged(d, marker=P.first_marker(text), sourced=P.has_structured_source(d))
    tests = [_fail("raw-marker", F.col("marker").isNotNull(), F.col("marker")), _fail("no-source", ~F.col("sourced")),
             _fail("no-meaning", ~text.rlike(rules.MEANING_HEADING))]
    if require_dossier:
        tests += [_fail("dossier", ~text.rlike(rules.ATOMISED_HEADING) & ~text.rlike(rf"(?m)^##\s+{s}(?:\s|$)"), s) for s in rules.DOSSIER]
    return _rows(d, tests)


def freshness_failures(notes: DataFrame) -> DataFrame:
    """The trust block must carry a date, a version or a re-check word; service
    paths are not judged."""
    d = T.staged(notes.filter(~P.service_path(F.col("path"))), trust=T.section_body(F.col("text"), rules.TRUST_HEADING))
    fresh = F.lit(False)
    for p in rules.FRESHNESS:
        fresh = fresh | F.col("trust").rlike(T.ascii_edges(p))
    blank = T.strip(F.col("trust")) == ""
    reason = (F.when(F.col("trust").isNull(), "no-trust-block").when(blank, "empty-trust-block").when(~fresh, "no-freshness-mark"))
    return d.select("path", reason.alias("rule")).filter("rule is not null")


# -- reader layer ------------------------------------------------------------------

def marker_failures(text: Column, low: Column, keep: int = 5) -> list[Column]:
    out = []
    for name, pattern in rules.LAYER_MARKERS:
        hits = F.when(T.has_any(low, rules.LAYER_ANCHORS[name]), F.slice(T.find_all(text, T.ascii_edges(pattern)), 1, keep)).otherwise(
            F.array().cast("array<string>"))
        out.append(_hits(name, hits))
    return out


def layer_failures(notes: DataFrame, product: str = "the assistant", min_letters: int = 120, max_ratio: float = 2.2,
                   script: str = T.CYRILLIC) -> DataFrame:
    """Markers, required sections by note kind, letters of the reader's script."""
    text = F.col("text")
    d = T.staged(notes, low=F.lower(text), heads=T.filled_sections(text), layer=T.language_layer(text), type=F.coalesce(T.strip(F.regexp_extract(text, r'(?m)^type:\s*"?([^"\n]+)"?', 1)), F.lit("")))
    digest = F.col("type") == "knowledge-digest"
    known = F.col("type").isin(rules.TYPES) | text.rlike(r"^#\s+")
    d = T.staged(d, own=T.count_of(F.col("layer"), script), lat=T.count_of(F.col("layer"), T.LATIN))

    def has(title: str) -> Column:
        return T.is_filled(F.col("heads"), rf"(?iu)^##\s+{title}(?:\s|$)")
    titles = sorted({*rules.DIGEST_SECTIONS, *rules.KNOWLEDGE_SECTIONS})
    missing = F.filter(F.array(*[F.when(~has(t) & F.when(digest, F.lit(t in rules.DIGEST_SECTIONS)).otherwise(
        F.lit(t in rules.KNOWLEDGE_SECTIONS)), F.lit(t)) for t in titles]), lambda x: x.isNotNull())
    use = F.lit(False)
    for t in [*rules.USE_SECTIONS, f"Что добавила {product}"]:
        use = use | has(t)
    judged = digest | known
    d = T.staged(d, missing=missing, use=use)
    tests = marker_failures(text, F.col("low")) + [
        _fail("missing-sections", judged & (F.size("missing") > 0), F.array_join("missing", " | ")),
        _fail("missing-use-section", known & ~digest & ~F.col("use")),
        _fail("weak-script-layer", judged & (F.col("own") < min_letters), F.concat(F.lit("letters="), F.col("own").cast("string"))),
        _fail("latin-dominant-layer", judged & (F.col("lat") > F.col("own") * max_ratio))]
    return _rows(d, tests)


def brief_failures(briefs: DataFrame, product: str = "") -> DataFrame:
    text = F.col("text")

    def has(title: str) -> Column:
        return T.is_filled(F.col("heads"), rf"(?iu)^##\s+{title}(?:\s|$)")
    old = "|".join(rules.BRIEF_LABELS)
    d = T.staged(briefs, low=F.lower(text), heads=T.filled_sections(text))
    tests = marker_failures(text, F.col("low")) + [
        _fail("brief-title", ~text.rlike(r"(?mu)^#\s+Короткий отч[её]т" + (rf"\s+{product}" if product else ""))), _fail("brief-status-missing", ~has("Статус")),
        _fail("brief-actions-missing", ~has("Следующие действия")),
        _fail("brief-english-shell", text.rlike(rf"(?m)^##\s+Next Actions\b|^-\s+({old}):"))]
    return _rows(d, tests)


def report_text_failures(reports: DataFrame, title: str = r"(?iu)Отч[ее]т|после прогона", min_letters: int = 200,
                         script: str = T.CYRILLIC) -> DataFrame:
    text = F.col("text")
    d = T.staged(reports, low=F.lower(text))
    tests = marker_failures(text, F.col("low")) + [_fail(f"missing-{n}", ~text.rlike(p)) for n, p in [("report-title", title), *rules.REPORT_TEXT_SIGNALS]]
    tests.append(_fail("weak-report", T.count_of(text, script) < min_letters))
    return _rows(d, tests)


def report_html_failures(pages: DataFrame, key: str = "page_id", min_cards: int = 30, min_links: int = 3) -> DataFrame:
    """Report page: raw markers, catalogue shape, required signals, links."""
    d = T.staged(pages, plain=H.flat_text(F.col("html")))
    d = T.staged(d, low=F.lower("plain"), odd=F.col("plain").rlike(T.ODD_CASE))
    t, low, html = F.col("plain"), F.col("low"), F.col("html")

    def signal(pattern: str) -> Column:
        plain, rest = T.alternatives(pattern.replace("(?iu)", "").lower())
        return T.has_any(low, plain) | ((F.col("odd") | F.lit(bool(rest))) & t.rlike(pattern))
    cards = T.count_of(html, r"(?i)<article\b")
    atoms = T.count_of(html, "(?i)data-knowledge-atom=|class=\"[^\"]*\\batom\\b|class='[^']*\\batom\\b")
    raw = F.filter(F.array(*[F.when(T.has_any(low, rules.REPORT_ANCHORS[n]) & t.rlike(T.ascii_edges(p)), n)
                             for n, p in rules.REPORT_MARKERS]), lambda x: x.isNotNull())
    gone = F.filter(F.array(*[F.when(~signal(p), n) for n, p in rules.REPORT_SIGNALS]), lambda x: x.isNotNull())
    anchors = T.count_of(html, r"(?i)<a\s+[^>]*href=")
    return _rows(d, [_hits("raw-marker", raw, ","),
                     _fail("raw-catalog-shape", (cards >= min_cards) & (atoms == 0), cards.cast("string")),
                     _hits("missing-synthesis-contract", gone, ","),
                     _fail("weak-source-expansion", anchors < min_links, anchors.cast("string"))], key)


# -- sensitivity ---------------------------------------------------------------------

def _matching(pattern: str):
    return lambda s: s.rlike(pattern)


def sensitivity(notes: DataFrame, known: Sequence[str] | None = None) -> DataFrame:
    """(path, class, undetermined): the strictest class any rule names.

    A broken head falls to the default; an unknown class or section leaves the
    note undetermined.  Known sections are the note's own directories, or the
    given names.
    """
    d = T.staged(notes.select("path", "text"), f=fm.lenient_fields(F.col("text")))
    dirs = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    sec = F.coalesce(F.col("f.section"), F.element_at(dirs, -1))
    first = F.trim(F.get(F.split(sec, "/"), F.lit(0)))
    rank = {c: i for i, c in enumerate(rules.CLASS_ORDER)}

    def fired(test: Column, cls: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(rank[cls]))
    explicit = F.lit(None).cast("int")
    for c, r in rank.items():
        explicit = F.when(F.col("f.data_class") == c, r).otherwise(explicit)
    srcs = F.concat(F.array(F.coalesce(F.col("f.source"), F.lit(""))), F.col("f.sources"))
    votes = [explicit] + [fired((sec == s) | (first == s), c) for s, c in rules.CLASS_BY_SECTION.items()]
    votes += [fired(F.array_contains("f.projects", p), c) for p, c in rules.CLASS_BY_PROJECT.items()]
    votes += [fired(F.size(F.filter(srcs, _matching(rx))) > 0, c) for rx, c in rules.CLASS_BY_SOURCE.items()]
    top = F.array_max(F.array(*votes))
    is_known = F.array_contains(dirs, first) if known is None else first.isin(*known)
    bad = F.col("f.data_class").isNotNull() & explicit.isNull()
    ok = F.coalesce(F.col("f.ok"), F.lit(False))
    names = F.array(*[F.lit(c) for c in rules.CLASS_ORDER])
    cls = (F.when(~ok, rules.CLASS_DEFAULT).when(bad, None).when(top.isNotNull(), F.get(names, top))
           .when(is_known, "text"))
    return d.select("path", cls.alias("class"), cls.isNull().alias("undetermined"))


def cloud_readable(notes: DataFrame) -> DataFrame:
    """Paths whose class may leave the machine and that no private folder holds."""
    private = [s for s, c in rules.CLASS_BY_SECTION.items() if c in ("personal", "pd")]
    parts = F.split("path", "/")
    return (sensitivity(notes).filter(F.col("class").isin(rules.CLOUD_CLASSES)
                                      & ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in private]))).select("path"))


def batch_gate(classes: DataFrame, target: str) -> DataFrame:
    """One row: 2 for an empty batch or an undetermined note, 1 for a class the
    target may not hold, else 0."""
    allowed = [c for c, m in rules.CLASS_MACHINES.items() if target in m]
    if not allowed:
        raise ValueError(f"unknown target {target}")
    d = classes.agg(F.count("*").alias("notes"), F.count_if("undetermined").alias("undetermined"),
                    F.count_if(~F.col("class").isin(allowed)).alias("blocked"))
    code = (F.when((F.col("notes") == 0) | (F.col("undetermined") > 0), 2).when(F.col("blocked") > 0, 1).otherwise(0))
    return d.withColumn("code", code)


# -- canon audit ------------------------------------------------------------------------

def routed_section(note: dict[str, Column]) -> Column:
    """Section a note belongs to; the first rule wins.

    ``note`` has the columns base, section, path, title, type and tags.
    """
    low = {k: F.lower(F.coalesce(c, F.lit(""))) for k, c in note.items()}
    low["either"] = F.concat(low["title"], F.lit(" "), low["path"])

    def holds(test: dict[str, str]) -> Column:
        out = F.lit(True)
        for field, value in test.items():
            out = out & (note["section"] == value if field == "section" else note["base"].rlike(value) if field == "base"
                         else low[field].rlike("(?u)" + value))
        return F.coalesce(out, F.lit(False))
    out = F.coalesce(T.blank_to_null(note["section"]), F.lit(rules.ROUTE_DEFAULT))
    for pattern, target in reversed(rules.TITLE_ROUTES):
        hit = low["title"].rlike("(?u)" + pattern)
        if target in rules.TAG_ROUTES:
            hit = hit | low["tags"].contains(rules.TAG_ROUTES[target])
        out = F.when(hit, target).otherwise(out)
    for test, target in reversed(rules.EARLY_ROUTES):
        out = F.when(holds(test), target).otherwise(out)
    return out


def head_value(text: Column, key: str) -> Column:
    """Value of one line of the head, quotes off; empty where there is none."""
    return T.sub(T.strip(F.regexp_extract(text, rf"(?m)\A---\n(?s:.*?)^{key}:\s*(?-s:(.*))$", 1)), r"^['\"]|['\"]$", "")


def canon_audit(notes: DataFrame) -> DataFrame:
    """(path, section, inferred, flags, soft, score) of each note."""
    text = F.col("text")
    h1 = T.strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    title = F.coalesce(T.blank_to_null(head_value(text, "title")), T.blank_to_null(h1), T.sub(F.col("base"), r"\.md$", ""))

    def any_of(patterns: Sequence[str]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | text.rlike(p)
        return hit
    d = T.staged(notes, title=title, atomised=text.rlike(rules.ATOMISED_HEADING), type=head_value(text, "type"),
                 tags=head_value(text, "tags"), status=head_value(text, "status"), present=F.array(*[any_of(p) for p in rules.AUDIT_KINDS.values()]),
                 system=F.col("path").isin(rules.AUDIT_SYSTEM_FILES) | F.col("path").rlike(rules.AUDIT_SYSTEM_PATHS))
    d = T.staged(d, inferred=routed_section({k: F.col(k) for k in ("base", "section", "path", "title", "type", "tags")}))
    judged = ~F.col("system") & ~F.col("atomised")
    processed = ((F.lower("status") == "processed") & F.forall("present", lambda x: x)
                 & F.lower("type").isin(rules.PROCESSED_TYPES))
    flags = [F.when(judged & ~F.get("present", F.lit(i)), F.lit(f"missing:{k}")) for i, k in enumerate(rules.AUDIT_KINDS)]
    mentions = text.rlike("(?iu)source|источник")
    soft = [F.when(F.col("atomised"), F.lit("atomized-source"))]
    for label, p in rules.AUDIT_RAW:
        hit = text.rlike(p)
        flags.append(F.when(hit & ~(F.col("system") | mentions), F.lit(f"raw:{label}")))
        soft.append(F.when(hit & (F.col("system") | mentions), F.lit(f"raw-reference:{label}")))
    soft.append(F.when(F.col("base").rlike(r"^_COMMUNITY_|Community \d+"), F.lit("graph-community-note")))
    alias = F.lit(None).cast("string")
    for a, target in rules.SECTION_ALIASES.items():
        alias = F.when(F.col("section") == a, target).otherwise(alias)
    flags += [F.when(judged & (F.size(T.lines_of(text)) > 220), F.lit("long-note")),
              F.when(judged & (T.count_of(text, r"(?m)^##+\s+") >= 12), F.lit("many-headings")),
              F.when(judged & ~processed & F.col("title").rlike(rules.COLLECTION_WORDS), F.lit("collection-candidate")),
              F.when(alias.isNotNull(), F.concat(F.lit("section-alias:"), alias)),
              F.when(~F.col("section").isin(rules.CANON_SECTIONS) & alias.isNull()
                     & ~F.col("section").startswith("08 AI и Инструменты/"), F.lit("noncanonical-section")),
              F.when(~F.col("system") & (F.col("inferred") != F.col("section")) & ~alias.eqNullSafe(F.col("inferred"))
                     & ~F.col("path").startswith(F.concat("inferred", F.lit("/"))), F.concat(F.lit("route:"), F.col("inferred")))]
    d = T.staged(d, flags=F.filter(F.array(*flags), lambda x: x.isNotNull()), soft=F.filter(F.array(*soft), lambda x: x.isNotNull()))
    hard = F.size(F.filter("flags", lambda x: ~x.startswith("route:")))
    return d.select("path", "section", "inferred", "flags", "soft",
                    F.greatest(F.lit(0), 100 - 12 * hard - 3 * F.size("soft")).alias("score"))


# fixed values: (rule, pattern)
FINAL_RULES = [
    ("raw-media-name", r"(?i)\b(?:temp[_-]?image|tmpImage|IMG_\d+)(?:\.(?:WEBP|PNG|JPE?G|HEIC|TIFF|MOV|MP4))?\b"),
    ("draft-marker", r"(?i)\b(?:intake-draft|draft-local)\b"),
    ("raw-ocr", r"(?iu)\braw\s+ocr\b|сыр[оы]й\s+ocr|Локальное извлечение"),
    ("external-sandbox-ref", r"(?i)\b(?:attached_file://|sandbox:/mnt/data/|oai_citation|turn\d+(?:search|fetch|view)\d+)\b"),
    ("chat-tracking-ref", r"(?i)[?&]utm_source=chatgpt\.com\b"),
    ("english-section-shell", r"(?m)^##\s+(?:What This Is|Why It Matters|How To Use It|Source|Verification|Related Notes|Reuse)\b"),
]


#: Folders of tools, which the audit does not enter.
TOOL_FOLDERS = [".git", ".obsidian"]


def nested_runtime(files: DataFrame, derived: str = rules.GRAPH_FOLDER) -> DataFrame:
    """Folders of the derived graph below the top level, once each; ``files(path)`` lists files of any kind.

    The outermost such folder of a path counts; what lies in one at the top or
    in a folder of a tool does not.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    d = files.select(folders.alias("f")).withColumn("i", F.array_position(F.transform("f", lambda s: s.startswith(derived)), True))
    up = F.slice("f", 1, F.col("i").cast("int"))
    d = d.filter((F.col("i") > 1) & ~F.arrays_overlap(up, F.array(*[F.lit(t) for t in TOOL_FOLDERS])))
    return d.select(F.array_join(up, "/").alias("path")).distinct().select(
        "path", F.lit("nested-runtime").alias("rule"), F.lit("").alias("detail"))


def final_audit(notes: DataFrame, link_scope: str = "all", critical: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Raw names, draft marks, tracking and sandbox references, private path in
    a file name, broken links in the chosen scope (none, critical, all) and, given
    all ``files(path)``, folders of the derived graph among the notes."""
    out = _note_audit(notes, link_scope, critical)
    return out if files is None else out.unionByName(nested_runtime(files))


def _note_audit(notes: DataFrame, link_scope: str, critical: Column | None) -> DataFrame:
    hay = F.concat_ws("\n", "base", "text")
    d = T.staged(notes, hay=hay)
    tests = [_fail("private-path-filename", F.col("base").rlike(r"Users [^/ ]+|/Users/[^/]+|личный vault 0\d"), F.col("base"))]
    for name, p in FINAL_RULES:
        hits = F.slice(T.find_all(F.col("hay"), T.ascii_edges(p)), 1, 5)
        tests.append(_hits(name, hits))
    out = _rows(d, tests)
    if link_scope == "none":
        return out
    scope = notes if link_scope == "all" else notes.filter(critical)
    ls = P.wikilinks(scope).filter(~F.col("target").isin("...", "…", "note", "Название"))
    broken = L.wide_broken(ls, notes).select("path", F.lit("broken-wiki-link").alias("rule"), F.col("target").alias("detail"))
    return out.unionByName(broken)


# -- lint ---------------------------------------------------------------------------------

def lint_findings(notes: DataFrame, now: str, spec_date: str = "2026-07-25", stale_days: int = 30, min_letters: int = 100) -> DataFrame:
    """Per-note lint rows (path, check, severity, detail); ``now`` fixes the clock."""
    head = F.regexp_extract("text", r"^(?s:---\r?\n(.*?)\r?\n---(?:\r?\n|\z))", 1)
    d = T.staged(notes.filter(~P.lint_service_path(F.col("path"))), head=T.blank_to_null(head), prose=T.prose(F.col("text")))
    kind = T.sub(T.strip(T.sub(F.regexp_extract("head", r"(?m)^type:\s*(.*)$", 1), r"\s+#.*$", "")), r"^['\"]|['\"]$", "")
    own, lat = T.count_of(F.col("prose"), T.CYRILLIC), T.count_of(F.col("prose"), T.LATIN)
    problems = F.filter(F.array(
        F.when(F.col("head").isNull(), "no head"),
        F.when(F.col("head").isNotNull() & ~F.col("head").rlike(r"(?m)^source:\s*\S"), "no source"),
        F.when(F.col("head").isNotNull() & ~kind.isin(rules.TYPES), "type")), lambda x: x.isNotNull())
    date = F.coalesce(P.head_date(F.col("head"), "created"), P.head_date(F.col("head"), "updated"), F.date_format("mtime", "yyyy-MM-dd"))
    upd = F.coalesce(P.head_date(F.col("head"), "updated").try_cast("timestamp"), F.col("mtime"))
    gone = F.filter(F.array(*[F.when(~F.col("text").rlike(p), F.lit(n)) for n, p in rules.LINT_BLOCKS.items()]), lambda x: x.isNotNull())
    d = T.staged(d, problems=problems, date=date, gone=gone, own=own, lat=lat, upd=upd)
    share = F.col("own") / (F.col("own") + F.col("lat"))
    found = F.filter(F.array(
        F.when((F.size("problems") > 0) & (F.col("date") >= spec_date), F.struct(F.lit("spec_new").alias("check"), F.lit("high").alias("severity"), F.array_join("problems", "; ").alias("detail"))),
        F.when((F.size("problems") > 0) & (F.col("date") < spec_date), F.struct(F.lit("spec_old").alias("check"), F.lit("medium").alias("severity"), F.array_join("problems", "; ").alias("detail"))),
        F.when((F.col("own") + F.col("lat") >= min_letters) & (share < rules.MIN_SCRIPT_SHARE), F.struct(
            F.lit("low_script").alias("check"), F.lit("medium").alias("severity"), F.round(share * 100).cast("int").cast("string").alias("detail"))),
        F.when(F.size("gone") > 0, F.struct(F.lit("missing_blocks").alias("check"), F.lit("medium").alias("severity"), F.array_join("gone", "; ").alias("detail"))),
        F.when(F.lit(now).cast("timestamp") - F.col("upd") > F.expr(f"INTERVAL {stale_days} DAYS"), F.struct(
            F.lit("stale_notes").alias("check"), F.lit("info").alias("severity"), F.lit("").alias("detail")))), lambda x: x.isNotNull())
    return d.select("path", F.inline(found))


CHECKS = {"broken_wikilinks": "critical", "index_divergence": "critical", "spec_new": "high", "spec_old": "medium",
          "orphans": "medium", "low_script": "medium", "missing_blocks": "medium", "stale_notes": "info", "root_junk": "info"}


def lint_summary(notes: DataFrame, now: str, index_issues: DataFrame | None = None, worst: int = 20, **kw) -> DataFrame:
    """(check, severity, n, unique_targets, worst, run_ok): the nine checks, zero counts included.

    ``worst`` lists the ``worst`` items of a check by weight: broken targets by
    how often they are linked, low shares from the lowest, else paths in order.
    Any row of a critical check fails the run.  Broken links count per link,
    ``unique_targets`` per target; only sums per check and the cut lists meet.
    """
    ls = P.wikilinks(notes)
    zero = F.lit(0.0)
    found = lint_findings(notes, now, **kw)
    broken = L.broken_links(ls, notes).groupBy("target").agg(F.count("*").alias("n"))
    parts = [found.select("check", F.col("path").alias("item"), F.when(F.col("check") == "low_script", F.col("detail").cast("double"))
                          .otherwise(zero).alias("weight"), F.lit(1).cast("long").alias("n")),
             broken.select(F.lit("broken_wikilinks").alias("check"), F.col("target").alias("item"), (-F.col("n")).cast("double").alias("weight"), "n"),
             L.orphans(ls, notes).select(F.lit("orphans").alias("check"), F.col("path").alias("item"), zero.alias("weight"), F.lit(1).cast("long").alias("n")),
             notes.filter(~F.col("path").contains("/") & (F.col("path").startswith("Без названия") | (F.col("path") == ".DS_Store")))
             .select(F.lit("root_junk").alias("check"), F.col("path").alias("item"), zero.alias("weight"), F.lit(1).cast("long").alias("n"))]
    if index_issues is not None:
        parts.append(index_issues.select(F.lit("index_divergence").alias("check"), F.col("path").alias("item"), zero.alias("weight"),
                                         F.lit(1).cast("long").alias("n")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counts = rows.groupBy("check").agg(F.sum("n").alias("n"), F.count("*").alias("items"))
    w = Window.partitionBy("check").orderBy("weight", "item")
    top = rows.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= worst).groupBy("check").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("worst"))
    names = notes.sparkSession.createDataFrame(list(CHECKS.items()), "check string, severity string")
    d = names.join(counts, "check", "left").join(top, "check", "left").fillna(0, ["n"])
    bad = F.sum(F.when(F.col("severity") == "critical", F.col("n")).otherwise(0)).over(Window.partitionBy())  # nine rows
    return d.select("check", "severity", "n", F.when(F.col("check") == "broken_wikilinks", F.coalesce("items", F.lit(0))).alias("unique_targets"),
                    F.coalesce("worst", F.array().cast("array<string>")).alias("worst"), (bad == 0).alias("run_ok"))


# -- indexes, composite gate, weekly cards ------------------------------------------------------

def claimed_counts(index: DataFrame, text: str = "text") -> DataFrame:
    """(section, claimed) from table rows whose third cell is a number."""
    d = index.select(F.explode(T.lines_of(F.col(text))).alias("l")).select(F.transform(F.split("l", r"\|"), T.strip).alias("c"))
    ok = (F.size("c") >= 5) & (F.get("c", F.lit(1)) != "") & F.get("c", F.lit(3)).rlike(r"^\d+$")
    return d.filter(ok).select(F.get("c", F.lit(1)).alias("section"), F.get("c", F.lit(3)).cast("bigint").alias("claimed"))


def claimed_total(index: DataFrame, text: str = "text") -> DataFrame:
    return index.select(F.regexp_extract(text, r"Всего markdown[^*\n]*\*\*(\d+)\*\*", 1).try_cast("bigint").alias("total")).filter("total is not null")


def count_mismatches(claimed: DataFrame, notes: DataFrame) -> DataFrame:
    """Sections whose claimed and actual counts differ, in either direction."""
    actual = notes.filter(F.col("path").contains("/")).groupBy("section").agg(F.count("*").alias("actual"))
    d = claimed.join(actual, "section", "full_outer").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return d.filter(F.coalesce(F.col("claimed"), F.lit(-1)) != F.col("actual")).filter(
        (F.col("actual") > 0) | (F.col("claimed") != 0)).select("section", "claimed", "actual")


def stale_indexes(notes: DataFrame, indexes: DataFrame, min_days: float = 1.0) -> DataFrame:
    """``indexes(path, mtime)`` older than the newest note by the limit or
    absent (null time); the newest time is a single row."""
    newest = notes.agg(F.max("mtime").alias("newest"))
    lag = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("mtime").cast("timestamp"))) / F.lit(86400e6)
    return (indexes.crossJoin(newest).filter(F.col("mtime").isNull() | (lag >= min_days))  # one row
            .select("path", F.round(lag, 1).alias("lag_days")))


def composite(failures: DataFrame, gates: Sequence[str]) -> DataFrame:
    """``failures(gate, level)`` -> (gate, failures, warnings, ok) for each gate
    that had to run, so a silent gate shows as a row."""
    names = failures.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    agg = failures.groupBy("gate").agg(F.count_if(F.col("level") == "failure").alias("failures"),
                                       F.count_if(F.col("level") == "warning").alias("warnings"))
    return names.join(agg, "gate", "left").fillna(0).withColumn("ok", F.col("failures") == 0)


def weekly_cards(notes: DataFrame, since: str, summary_len: int = 520, max_links: int = 4) -> DataFrame:
    """Notes changed since a time: title, summary, action line, links."""
    d = P.changed_since(notes, since)
    text = F.col("text")
    h1 = T.strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    title = F.coalesce(T.blank_to_null(h1), T.sub(F.col("base"), r"\.md$", ""))
    block = F.regexp_extract(text, r"(?iu)## (?:What This Is|Что это|Суть)\s+([\s\S]*?)(\n## |\z)", 1)
    summary = F.substring(P.redact(T.sub(F.when(block != "", block).otherwise(text), r"[#*_`>-]", "")), 1, summary_len)
    act = F.coalesce(T.blank_to_null(T.strip(F.regexp_extract(text, r"(?im)Next action:\s*(.+)$", 1))),
                     T.blank_to_null(T.strip(F.regexp_extract(text, r"(?imu)Следующее действие[:\s]+(.+)$", 1))), F.lit("read and decide"))
    urls = F.transform(F.array_distinct(T.find_all(text, T.ascii_edges(r"\bhttps?://[^\s)]+"))), lambda u: T.sub(u, r"[.,;]+$", ""))
    links = F.slice(F.filter(urls, lambda u: ~u.rlike(r"(?i)\.(?:md|png|svg|jpe?g|webp|gif)")), 1, max_links)
    return d.select("path", P.redact(title).alias("title"), summary.alias("summary"), P.redact(act).alias("action"),
                    F.array_join(links, " ").alias("links"))
