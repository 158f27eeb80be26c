"""Groups cut into parts, records rolled up, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions import urls as U
from ..session import cut_lineage, numbered
from .search import BlockSearch, block_index
from .substring import containing, words_containing


def fixed_parts(df: DataFrame, keys: list[str], order: list, size: int = 25) -> DataFrame:
    """Part number and part count of fixed-size parts within each key; safe for
    a key that holds most of the table."""
    d = numbered(df, keys, order, "rn")
    named = {k: f"_t{i}" for i, k in enumerate(keys)}
    total = df.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for k, n in named.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return d.join(total, on).select(*df.columns, "rn", (F.floor((F.col("rn") - 1) / size) + 1).alias("part"),
                                    F.ceil(F.col("_n") / size).alias("parts"))


def value_census(notes: DataFrame, fields: tuple[str, ...] = ("type", "verified", "verification_status")) -> DataFrame:
    """(field, value, n, cover): every value met, and whether it already
    conforms, a rule maps it, or a person has to decide."""
    from ..functions import frontmatter as fm
    from .parsing import mapped_type, mapped_verified
    props = fm.properties(notes).filter(F.col("key").isin(*fields) & ~F.col("is_list"))
    d = props.groupBy(F.col("key").alias("field"), "value").agg(F.count("*").alias("n"))
    v = T.fold_yo(F.col("value"))
    m = mapped_verified(F.col("value"))
    kind = (F.when(F.col("value").isin(rules.TYPES), "conformant")
            .when(~mapped_type(F.col("value"), F.lit(False)).isin("tool-card", "decision"), "rule").otherwise("human"))
    ver = (F.when(v.isin(rules.VERIFIED), "conformant").when(~m["keep_legacy"], "rule")
           .when(m["value"] == "не-проверялось", "human").otherwise("rule"))
    return d.withColumn("cover", F.when(F.col("field") == "type", kind).when(F.col("field") == "verified", ver).otherwise("rule"))


# -- topics and parts ------------------------------------------------------------------

def topic_parts(records: DataFrame, size: int = 25, min_chars: int = 80) -> DataFrame:
    """(topic, part, parts, n, chars, fingerprint) of topic clusters cut in
    parts; parts with too little text drop out.

    ``records(ref, text)``.  A part holds at most ``size`` references, so the
    list its fingerprint is made of is bounded.
    """
    from .parsing import topic_of
    d = records.select("ref", topic_of(F.col("text")).alias("topic"), F.length(T.compact(F.col("text"))).alias("chars"))
    d = cut_lineage(d)  # three passes follow; the texts are read in one
    d = fixed_parts(d, ["topic"], [F.col("ref")], size)
    g = d.groupBy("topic", "part").agg(F.max("parts").alias("parts"), F.count("*").alias("n"), F.sum("chars").alias("chars"),
                                       F.array_sort(F.collect_list("ref")).alias("refs"))
    return g.filter(F.col("chars") >= min_chars).select(
        "topic", "part", "parts", "n", "chars", cluster_fingerprint(F.col("topic"), F.col("part"), F.col("refs")).alias("fingerprint"))


def cluster_fingerprint(topic: Column, part: Column, refs: Column) -> Column:
    key = F.concat_ws(" ", topic, part.cast("string"), F.array_join(F.array_sort(refs), " "))
    return F.substring(F.sha1(key), 1, 10)


def atom_fingerprint(topic: Column, title: Column, sources: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.array(topic, title), F.array_sort(sources))), 1, 10)


# -- attribution ---------------------------------------------------------------------------

def _contained(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: text.contains(w)))


def reattribute(note_refs: DataFrame, notes: DataFrame, sources: DataFrame, min_score: int = 8, share: float = 0.35,
                body_words: int = 160) -> DataFrame:
    """(note, ref, score, kept): which cited sources a note really rests on.

    ``note_refs(note, ref)``, ``notes(note, title, body, text)``,
    ``sources(ref, text)``.  Only the given pairs are scored.  Kept are scores
    not under the floor or a share of the best; with none, the best one.
    """
    n = notes.select("note", F.array_distinct(T.long_words(F.col("title"))).alias("tw"),
                     F.slice(F.array_distinct(T.long_words(F.col("body"))), 1, body_words).alias("bw"),
                     F.array_distinct(T.find_all(F.col("text"), r"https?://[^\s)]+")).alias("urls"),
                     F.array_distinct(F.transform(T.find_all(F.col("text"), r"github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1),
                                                  lambda r: T.sub(F.lower(r), r"\.git$", ""))).alias("repos"))
    s = sources.select("ref", F.lower("text").alias("low"))
    d = note_refs.join(n, "note").join(s, "ref")
    low = F.col("low")
    clean = F.array_distinct(F.transform("urls", lambda u: T.sub(u, r"[.,;]+$", "")))
    hosts = F.filter(F.transform(clean, U.host), lambda h: (h != "") & low.contains(h))
    paths = F.filter(F.transform(clean, lambda u: F.lower(U.path_bits(u))), lambda p: (p != "") & low.contains(p))
    score = (30 * _contained(F.col("repos"), low) + 3 * F.size(hosts) + 12 * F.size(paths)
             + 3 * _contained(F.col("tw"), low) + _contained(F.col("bw"), low))
    d = T.staged(d, score=score).select("note", "ref", "score")
    best = d.groupBy("note").agg(F.max("score").alias("best"), F.min_by("ref", F.struct((-F.col("score")).alias("k"), "ref")).alias("top"))
    d = d.join(best, "note")
    ok = (F.col("score") >= min_score) & (F.col("score") >= F.greatest(F.lit(min_score), F.floor(F.col("best") * share)))
    some = F.col("best") >= min_score  # then the best itself passes both tests
    return d.select("note", "ref", "score", F.when(some, ok).otherwise(F.col("ref") == F.col("top")).alias("kept"))


def _needles(atoms: DataFrame) -> DataFrame:
    """(topic, needle, weight): what of an atom may occur in a record - its long words, and of each source the
    address without scheme, the first parts of its path, and its host."""
    words = F.array_distinct(T.long_words(F.concat_ws("\n", "title", "what", F.array_join("sources", "\n"))))
    bare = F.transform("sources", lambda s: T.sub(T.sub(F.lower(s), r"^https?://", ""), r"^www\.", ""))
    weighed = lambda col, n: F.transform(col, lambda x: F.struct(x.alias("needle"), F.lit(n).alias("weight")))
    rows = F.concat(weighed(words, 1), weighed(bare, 8), weighed(F.transform("sources", lambda s: F.lower(U.path_bits(s))), 6),
                    weighed(F.transform("sources", U.host), 3))
    d = atoms.select(F.col("atom").alias("topic"), F.inline(rows)).filter("needle <> ''")
    return d.groupBy("topic", "needle").agg(F.sum("weight").alias("weight"))


def _record_search(atoms: DataFrame, records: DataFrame, keep: int, ties: bool, block: int) -> BlockSearch:
    """Atoms as topics, records as notes, in one index: a needle's list holds every record whose text contains it.

    A needle of letters and digits alone occurs in a record where a run of them
    contains it, so the vocabulary is matched once; other needles follow their
    rarest word (:func:`.substring.containing`).  Where both tables have a
    column part, an atom meets the records of its part.
    """
    parted = "part" in atoms.columns and "part" in records.columns
    needles = cut_lineage(_needles(atoms))
    run = r"[a-zа-яё0-9]+"
    plain = F.col("needle").rlike(f"^{run}$")
    d = records.select(F.col("ref").alias("path"), F.lower("text").alias("low"))
    runs = d.select("path", F.explode(F.array_distinct(T.find_all(F.col("low"), run))).alias("run"))
    hits = words_containing(runs.select(F.col("run").alias("word")).distinct(), needles.filter(plain).select(F.col("needle").alias("part")).distinct())
    posts = runs.join(hits.withColumnRenamed("word", "run"), "run").select("path", F.col("part").alias("word"))
    others = containing(d, needles.filter(~plain).select("needle").distinct(), "path", "low")
    posts = posts.unionByName(others.select("path", F.col("needle").alias("word"))).withColumn("points", F.lit(1))
    words = needles.select("topic", F.lit(0).alias("n_terms"), F.col("needle").alias("word"), "weight")
    if parted:
        key = lambda part: F.concat_ws("\x1f", part.cast("string"), "word")
        posts = posts.join(records.select(F.col("ref").alias("path"), "part").distinct(), "path").select("path", key(F.col("part")).alias("word"), "points")
        words = words.join(atoms.select(F.col("atom").alias("topic"), "part").distinct(), "topic").select(
            "topic", "n_terms", key(F.col("part")).alias("word"), "weight")
    return BlockSearch(block_index(d, posts, block, repeated=True), words, keep, whole=False, ties=ties)


def record_candidates(atoms: DataFrame, records: DataFrame, keep: int = 6, block: int = 1024) -> DataFrame:
    """(atom, ref, score, rank): the ``keep`` records with the highest overlap with an atom, out of all records."""
    d = _record_search(atoms, records, keep, False, block).best()
    return d.select(F.col("topic").alias("atom"), F.col("path").alias("ref"), "score", "rank")


def atom_sources(atoms: DataFrame, records: DataFrame, block: int = 1024) -> DataFrame:
    """(atom, ref, score): an atom's own valid references, else all records tied at the best overlap.

    ``atoms(atom, title, what, sources, refs[, part])``, ``records(ref, text[, part])``.
    Every record can match; blocks of records whose highest possible score is
    below what an atom has found already are not scored.
    """
    own = atoms.select("atom", F.explode("refs").alias("ref")).join(records.select("ref").distinct(), "ref").select("atom", "ref").distinct()
    if "part" in atoms.columns and "part" in records.columns:
        own = own.join(atoms.select("atom", "part"), "atom").join(records.select("ref", "part"), ["ref", "part"], "left_semi").select("atom", "ref")
    rest = atoms.join(own.select("atom").distinct(), "atom", "left_anti")
    best = _record_search(rest, records, 1, True, block).best()
    return best.select(F.col("topic").alias("atom"), F.col("path").alias("ref"), "score").unionByName(
        own.withColumn("score", F.lit(None).cast("long")))


# -- fits and suggestions ---------------------------------------------------------------------

def project_fit(entries: DataFrame, projects: list[str], keep: int = 5, fallback: int = 3) -> DataFrame:
    """Add ``projects``: names with points, best first, else the first names.
    The project list is a small parameter, so it becomes part of the plan."""
    text = F.concat_ws(" ", "category", "description", "name")
    points = [F.when(text.rlike(item), F.array(*[F.lit(w if name_matches(proj, p) else 0) for p in projects])).otherwise(
        F.array(*[F.lit(0) for _ in projects])) for item, proj, w in rules.PROJECT_FITS]
    total = points[0]
    for p in points[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    named = F.zip_with(total, F.array(*[F.lit(p) for p in projects]), lambda s, n: F.struct((-s).alias("k"), n.alias("name")))
    best = F.slice(F.transform(F.filter(F.array_sort(named), lambda x: x["k"] < 0), lambda x: x["name"]), 1, keep)
    return entries.withColumn("projects", T.let(best, lambda b: F.when(F.size(b) > 0, b).otherwise(
        F.array(*[F.lit(p) for p in projects[:fallback]]))))


def name_matches(pattern: str, name: str) -> bool:
    """Does a project name match a fit pattern (a parameter, not a row)."""
    import re
    return re.search(pattern.replace("(?iu)", "").replace("(?i)", ""), name, re.IGNORECASE) is not None


def chosen_suggestions(suggestions: DataFrame, notes: DataFrame, threshold: float) -> DataFrame:
    """First suggestion of each capability at or above the threshold, for notes
    without the block.  ``suggestions(path, ord, id, score)``."""
    has = notes.filter(F.col("text").rlike(r"(?m)^##\s+Применимые способности")).select("path").distinct()
    return (suggestions.filter(F.col("score") >= threshold).groupBy("path", "id")
            .agg(F.min_by("score", "ord").alias("score"), F.min("ord").alias("ord")).join(has, "path", "left_anti"))


# -- tools, records, modules --------------------------------------------------------------------

def tools(notes: DataFrame, max_sources: int = 6) -> DataFrame:
    """One row per repository: notes, first sources, first non-blank fields.

    ``notes(path, text, role, what, decision)``; a role decides which field a
    note may fill, the smallest path wins.
    """
    d = notes.select("path", "text", "role", "what", "decision", F.explode(U.repositories(F.col("text"))).alias("repo"))

    def first(col: str, role: str) -> Column:
        ok = (F.col("role") == role) & (F.col(col) != "")
        return F.coalesce(F.min_by(F.when(ok, F.col(col)), F.when(ok, F.col("path"))), F.lit("")).alias(col)
    agg = d.groupBy("repo").agg(F.count("*").alias("notes"), first("what", "identity"), first("decision", "decision"))
    urls = d.select("repo", "path", F.posexplode(F.transform(T.find_all(F.col("text"), r"https?://[^\s)]+"),
                                                             lambda u: T.sub(u, r"[.,;]+$", ""))).alias("p", "url"))
    urls = urls.filter(F.col("url").contains(F.col("repo"))).groupBy("repo", "url").agg(F.min(F.struct("path", "p")).alias("o"))
    w = Window.partitionBy("repo").orderBy("o", "url")
    top = (urls.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_sources).groupBy("repo")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "url"))), lambda x: x["url"]), " ").alias("sources")))
    return agg.join(top, "repo", "left")


# fixed values: (term, points)
IMPORTANCE = [("agent", 16), ("codex", 15), ("claude", 15), ("legal", 14), ("юрист", 14), ("investor", 13), ("startup", 13),
              ("стартап", 13), ("quick wins", 12), ("workflow", 11), ("portal", 10), ("marketplace", 10), ("промпт", 8),
              ("skill", 8), ("graph", 7), ("dashboard", 7)]
# fixed values: (terms, topic), first hit wins
RECORD_TOPICS = [
    (["legal", "юрист", "marketplace"], "Legal"),
    (["investor", "cap table", "esop", "founder", "shareholder"], "Investor-ready startup"),
    (["agent", "codex", "claude", "graph"], "Agent OS"),
    (["quick wins", "support", "sales", "onboarding"], "AI business offers"),
    (["prompt", "промпт", "slash"], "Промпты и команды"),
]
RECORD_TOPIC_DEFAULT = "Прочие полезные знания"


def importance(text: Column, notes: Column, atoms: Column, files: Column, extra: tuple[tuple[str, int], ...] = ()) -> Column:
    """Keyword weights, a bonus per kind of outcome, at most ten for files."""
    low = F.lower(text)
    score = F.lit(0)
    for term, w in [*IMPORTANCE, *extra]:
        score = score + F.when(low.contains(term), w).otherwise(0)
    return score + F.when(notes > 0, 6).otherwise(0) + F.when(atoms > 0, 5).otherwise(0) + F.least(files, F.lit(10))


def record_topic(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(RECORD_TOPIC_DEFAULT)
    for terms, topic in reversed(RECORD_TOPICS):
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t)
        out = F.when(hit, topic).otherwise(out)
    return out


def records(results: DataFrame) -> DataFrame:
    """One row per note key: groups, files, outcome counts, score, topic.

    ``results(key, group_id, outcome, files, title, summary)``.
    """
    d = results.withColumn("nf", F.size(F.array_distinct(F.transform("files", lambda f: F.regexp_extract(f, r"([^/]*)$", 1)))))
    g = d.groupBy("key").agg(F.count("*").alias("groups"), F.sum("nf").alias("files"),
                             F.count_if(F.col("outcome") == "note").alias("note"), F.count_if(F.col("outcome") == "atoms").alias("atoms"),
                             F.count_if(F.col("outcome") == "dup").alias("dup"), F.min_by("title", "group_id").alias("title"),
                             F.min_by("summary", "group_id").alias("summary"))
    text = F.concat_ws(" ", "title", "summary")
    return T.staged(g, score=importance(text, F.col("note"), F.col("atoms"), F.col("files")), topic=record_topic(text))


def top_records(recs: DataFrame, keep: int = 20) -> DataFrame:
    return recs.filter("note > 0 or atoms > 0").orderBy(F.desc("score"), F.desc("files"), "key").limit(keep)


def modules(recs: DataFrame, keep: int = 6, width: int = 96) -> DataFrame:
    """Per topic: sums, lead title, the first distinct titles by score."""
    sums = recs.groupBy("topic").agg(F.count("*").alias("n"), F.sum("files").alias("files"), F.sum("score").alias("score"),
                                     F.min_by("title", F.struct((-F.col("score")).alias("k"), "key")).alias("lead"))
    label = F.substring("title", 1, width)
    t = recs.select("topic", label.alias("atom"), "score", "key").filter("atom <> ''")
    one = t.groupBy("topic", F.lower("atom").alias("low")).agg(F.min(F.struct((-F.col("score")).alias("k"), "key", "atom")).alias("x"))
    w = Window.partitionBy("topic").orderBy("x")
    top = (one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).groupBy("topic")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["atom"]), " | ").alias("atoms")))
    return sums.join(top, "topic")


def catalogue(entries: DataFrame) -> DataFrame:
    """First entry of each repository by (list, line)."""
    cols = [c for c in entries.columns if c != "repo"]
    return entries.groupBy("repo").agg(F.min_by(F.struct(*cols), F.struct(*cols[:2])).alias("e")).select("repo", "e.*")


def catalogue_counts(entries: DataFrame) -> DataFrame:
    """(kind, label, n): entries per category and per project category."""
    from .parsing import list_categories
    a = entries.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("category"))
    c = list_categories(F.col("description"), F.col("category"), F.col("name"))
    b = entries.select(F.explode(c).alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("kind", F.lit("project"))
    return a.unionByName(b).select("kind", "label", "n")


def digests(notes: DataFrame, what: list[str], about: list[str], why: list[str]) -> DataFrame:
    """(path, title, what, about, why) with the documented fallbacks."""
    from .parsing import clean_section, title_chain
    t = F.col("text")
    d = T.staged(notes, title=title_chain(t, F.col("base")), w=clean_section(t, what), a=clean_section(t, about), y=clean_section(t, why))
    w = F.coalesce(T.blank_to_null(F.col("w")), F.concat(F.lit("Checked note on \""), "title", F.lit("\".")))
    about_ = F.coalesce(T.blank_to_null(F.col("a")), T.blank_to_null(F.col("w")), F.lit("See the note."))
    return d.select("path", "title", w.alias("what"), about_.alias("about"), F.coalesce(T.blank_to_null(F.col("y")), F.lit("Useful to decide whether to apply it.")).alias("why"))
