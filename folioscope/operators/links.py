"""The link graph between notes: resolution, broken links, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .parsing import lint_service_path, link_action, link_kind, title_chain, wikilinks


def _no_md(v: Column) -> Column:
    return T.sub(v, r"(?i)\.md$", "")


def _base(v: Column) -> Column:
    return F.regexp_extract(v, r"([^/]*)/*$", 1)


def note_keys(notes: DataFrame) -> DataFrame:
    """(key, path): path and file name, each with and without extension."""
    p = F.col("path")
    keys = F.array_distinct(F.array(p, _no_md(p), _base(p), _no_md(_base(p))))
    return notes.select(F.explode(keys).alias("key"), "path").filter("key <> ''")


def best_keys(targets: DataFrame, keys: DataFrame) -> DataFrame:
    """(target, key): the first of the four spellings of a target that exists.

    Works on distinct targets and distinct keys, so a popular target or a file
    name shared by many notes costs one row here.
    """
    t = F.col("target")
    tried = F.array(t, _no_md(t), _base(t), _no_md(_base(t)))
    cand = targets.select("target").distinct().select("target", F.posexplode(tried).alias("rank", "key"))
    known = keys.select("key").distinct()
    return (cand.join(known, "key").groupBy("target").agg(F.min_by("key", "rank").alias("key")))


def resolved_targets(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, path) with every note the winning key names."""
    keys = note_keys(notes)
    return best_keys(links, keys).join(keys, "key").select("target", "path")


def file_keys(notes: DataFrame) -> DataFrame:
    """Directories and file names a link may also point at."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    parts = F.split(folder, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    names = F.array(F.col("path"), _base(F.col("path")), _no_md(_base(F.col("path"))))
    return notes.select(F.explode(F.array_distinct(F.concat(dirs, names))).alias("key")).filter("key <> ''").distinct()


def broken_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links none of whose spellings is a note, a file or a directory."""
    known = note_keys(notes).select("key").union(file_keys(notes)).distinct()
    return links.join(best_keys(links, known), "target", "left_anti")


def linked_notes(links: DataFrame, notes: DataFrame) -> DataFrame:
    return resolved_targets(links, notes).select("path").distinct()


def orphans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Content notes nobody links to."""
    content = notes.filter(~lint_service_path(F.col("path"))).select("path")
    return content.join(linked_notes(links, notes), "path", "left_anti")


# -- wider resolution ---------------------------------------------------------------

def link_norm(v: Column) -> Column:
    v = T.sub(T.sub(v, r"\\+$", ""), r"(?i)\.md$", "")
    return T.squeeze(T.sub(v, "[—–]", "-"))


def strip_date(v: Column) -> Column:
    return T.strip(T.sub(T.sub(link_norm(v), r"^\d{4}-\d{2}-\d{2}\s*[-—–]\s*", ""), r"-\d+$", ""))


def wide_keys(notes: DataFrame) -> DataFrame:
    """Adds the head title, aliases and the date-stripped name to the keys."""
    text, p = F.col("text"), F.col("path")
    quote = r"^['\"]|['\"]$"
    title = T.sub(T.strip(F.regexp_extract(text, r"(?m)^title:\s*(.+)$", 1)), quote, "")
    inline = F.split(F.regexp_extract(text, r"(?m)^aliases:\s*\[([^\]]+)\]", 1), ",")
    block = F.split(F.regexp_extract(text, r"(?m)^aliases:\s*\n((?:\s+-\s+.+\n?)+)", 1), "\n")
    alias = F.transform(F.concat(inline, F.transform(block, lambda x: T.sub(x, r"^\s+-\s+", ""))),
                        lambda x: T.sub(T.strip(x), quote, ""))
    keys = F.concat(F.transform(F.array(p, _no_md(p), _base(_no_md(p)), title), link_norm),
                    F.transform(alias, link_norm), F.array(strip_date(_base(_no_md(p)))))
    folders = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return notes.select(F.explode(F.array_distinct(F.concat(keys, F.array(link_norm(folders))))).alias("key")
                        ).filter("key <> ''").distinct()


def wide_broken(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links unknown even to the wider index, with kind and proposed action."""
    n = link_norm(F.col("target"))
    cand = links.select("target").distinct().select("target", F.explode(F.array_distinct(
        F.array(n, _base(n), strip_date(_base(n))))).alias("key"))
    known = cand.join(wide_keys(notes), "key", "left_semi").select("target").distinct()
    free = n.rlike(r"(?i)^https?://") | n.startswith("#") | (n == "")
    return (links.filter(~free).join(known, "target", "left_anti")
            .withColumn("kind", link_kind(F.col("target")))
            .withColumn("action", link_action(F.col("kind")))
            .withColumn("section", F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("(root)")))


def broken_by_target(broken: DataFrame, examples: int = 5) -> DataFrame:
    """Counts per target; the examples are cut before they are collected."""
    w = Window.partitionBy("target").orderBy("path", "line", "pos")
    first = (broken.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= examples)
             .groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rn", "path", "line"))).alias("ex"))
             .select("target", F.array_join(F.transform("ex", lambda e: F.concat_ws(
                 ":", e["path"], e["line"].cast("string"))), ";").alias("examples")))
    sums = broken.groupBy("target", "kind", "action").agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))
    return sums.join(first, "target")


def broken_by_section(broken: DataFrame) -> DataFrame:
    return broken.groupBy("section").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"),
                                         F.count_distinct("path").alias("n_files"))


def broken_by_file(broken: DataFrame, keep: int = 20) -> DataFrame:
    """Count per file with the first ``keep`` targets in text order."""
    w = Window.partitionBy("path").orderBy("line", "pos")
    first = (broken.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
             .groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "target"))),
                                                           lambda e: e["target"]), ";").alias("targets")))
    return broken.groupBy("path", "section").agg(F.count("*").alias("n")).join(first, "path")


def rough_broken_count(notes: DataFrame) -> DataFrame:
    """A second, independent count of broken links: names instead of keys."""
    ls = wikilinks(notes)
    names = notes.select(F.lower(_no_md(_base(F.col("path")))).alias("name")).union(
        notes.select(F.lower(F.col("section")).alias("name"))).distinct()
    return (ls.withColumn("name", F.lower(_no_md(_base(F.col("target")))))
            .join(names, "name", "left_anti").agg(F.count("*").alias("rough_broken")))


# -- related notes --------------------------------------------------------------------

def related(notes: DataFrame, keep: int = 6) -> DataFrame:
    """Up to ``keep`` related notes: same cluster first, then a shared host.

    ``notes(path, cluster, hosts)``.  Nobody needs more than the first
    ``keep + 1`` members of a cluster, nor more than the first ``2 * keep`` of
    a host (own siblings and the note itself may have to be skipped), so both
    lists are cut before the join and no pair table of a group is ever built.
    """
    by_cluster = Window.partitionBy("cluster").orderBy("path")
    heads = (notes.filter("cluster is not null").select("cluster", "path")
             .withColumn("rn", F.row_number().over(by_cluster)).filter(F.col("rn") <= keep + 1)
             .groupBy("cluster").agg(F.collect_list("path").alias("cands")))
    sib = (notes.join(heads, "cluster").select("path", F.explode("cands").alias("other"), F.lit(0).alias("tier"),
                                               F.col("cluster").alias("mine")))
    hosted = notes.select("path", "cluster", F.explode("hosts").alias("host"))
    by_host = Window.partitionBy("host").orderBy("path")
    hheads = (hosted.withColumn("rn", F.row_number().over(by_host)).filter(F.col("rn") <= 2 * keep)
              .groupBy("host").agg(F.collect_list(F.struct("path", "cluster")).alias("cands")))
    rel = (hosted.join(hheads, "host").select("path", F.col("cluster").alias("mine"), F.explode("cands").alias("c"))
           .filter(~F.coalesce(F.col("c.cluster") == F.col("mine"), F.lit(False)))
           .select("path", F.col("c.path").alias("other"), F.lit(1).alias("tier"), "mine").distinct())
    both = sib.unionByName(rel).filter("path <> other")
    w = Window.partitionBy("path").orderBy("tier", "other")
    return (both.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= keep)
            .select("path", "pos", "other", F.when(F.col("tier") == 0, "sibling").otherwise("host").alias("why")))


def cluster_and_hosts(notes: DataFrame) -> DataFrame:
    cluster = T.blank_to_null(T.strip(F.regexp_extract("text", r'(?m)^cluster_id:\s*"?([^"\n]+)"?', 1)))
    return notes.select("path", title_chain(F.col("text"), _base(F.col("path"))).alias("title"),
                        cluster.alias("cluster"), U.hosts_of(F.col("text")).alias("hosts"))
