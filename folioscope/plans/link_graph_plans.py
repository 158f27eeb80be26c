"""Link resolution over the notes and concept-graph jobs over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import graph as G
from ..operators import links as L
from ..operators import parsing as P
from ..session import cut_lineage, numbered
from .fixtures import graph, notes, pages_rich, with_graph, with_notes, with_rich
from .registry import plan
from .text_plans import LINKS

KEYS = r"""keys AS (SELECT DISTINCT key, path FROM (SELECT path, unnest([path, regexp_replace(path, '\.md$', ''), base, regexp_replace(base, '\.md$', '')]) AS key FROM notes)),
  tried AS (SELECT DISTINCT target, unnest([target, regexp_replace(target, '(?i)\.md$', ''), regexp_extract(target, '[^/]*$'), regexp_replace(regexp_extract(target, '[^/]*$'), '(?i)\.md$', '')]) AS key,
      generate_subscripts([1, 2, 3, 4], 1) AS rank FROM links),
  best AS (SELECT target, arg_min(t.key, rank) AS key FROM tried t WHERE t.key IN (SELECT key FROM keys) GROUP BY target),
  resolved AS (SELECT DISTINCT b.target, k.path FROM best b JOIN keys k ON k.key = b.key),
  known AS (SELECT key FROM keys UNION SELECT section FROM notes),
  broken AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.target = l.target AND t.key IN (SELECT key FROM known)))"""


@plan("link_resolution", with_notes(f", {LINKS}, {KEYS} SELECT l.path, l.line, l.pos, l.target, r.path AS resolved FROM links l JOIN resolved r ON r.target = l.target"))
def link_resolution(spark, sf):
    n = notes(spark, sf)
    ls = P.wikilinks(n)
    hit = L.resolved_targets(ls, n).withColumnRenamed("path", "resolved")
    return ls.join(hit, "target").select("path", "line", "pos", "target", "resolved")


@plan("broken_links", with_notes(f", {LINKS}, {KEYS} SELECT path, line, pos, target FROM broken"))
def broken_links(spark, sf):
    n = notes(spark, sf)
    return L.broken_links(P.wikilinks(n), n).select("path", "line", "pos", "target")


@plan("orphan_notes", with_notes(f", {LINKS}, {KEYS} SELECT path FROM notes WHERE section <> '_drafts' AND path NOT IN (SELECT path FROM resolved)"))
def orphan_notes(spark, sf):
    n = notes(spark, sf)
    return L.orphans(P.wikilinks(n), n)


WIDE = r""", wkeys AS (SELECT DISTINCT key FROM (SELECT unnest([regexp_replace(path, '\.md$', ''), regexp_replace(base, '\.md$', ''), substr(base, 14, length(base) - 16), section,
     regexp_extract(text, '(?m)^title:\s*"?([^"\n]+)', 1)]) AS key FROM notes) WHERE key <> ''),
  wbroken AS (SELECT *, CASE WHEN target = '...' THEN 'placeholder' WHEN target LIKE '%.pdf' THEN 'file-or-asset' WHEN regexp_matches(target, '^[A-Za-z0-9 _-]+$') THEN 'concept' ELSE 'missing-note' END AS kind
    FROM links WHERE regexp_extract(target, '[^/]*$') NOT IN (SELECT key FROM wkeys) AND regexp_replace(target, '^\d{4}-\d{2}-\d{2} - ', '') NOT IN (SELECT key FROM wkeys))"""


def _wide(spark, sf):
    n = notes(spark, sf)
    return L.wide_broken(P.wikilinks(n), n)


@plan("broken_by_target", with_notes(f""", {LINKS}{WIDE} SELECT target, kind, CASE kind WHEN 'placeholder' THEN 'drop or replace with a real note' WHEN 'file-or-asset' THEN 'use a plain link or a wrapper note'
    WHEN 'concept' THEN 'write a short concept note' ELSE 'find the new name, bridge or drop' END AS action, count(*) AS n, count(DISTINCT path) AS n_files,
    array_to_string(list_slice(list(path || ':' || line ORDER BY path, line, pos), 1, 5), ';') AS examples FROM wbroken GROUP BY target, kind"""))
def broken_by_target(spark, sf):
    return L.broken_by_target(_wide(spark, sf))


@plan("broken_by_section", with_notes(f", {LINKS}{WIDE} SELECT section, count(*) AS n, count(DISTINCT target) AS n_targets, count(DISTINCT path) AS n_files FROM wbroken GROUP BY section"))
def broken_by_section(spark, sf):
    return L.broken_by_section(_wide(spark, sf))


@plan("broken_by_file", with_notes(f", {LINKS}{WIDE} SELECT path, section, count(*) AS n, array_to_string(list_slice(list(target ORDER BY line, pos), 1, 20), ';') AS targets FROM wbroken GROUP BY path, section"))
def broken_by_file(spark, sf):
    return L.broken_by_file(_wide(spark, sf))


@plan("broken_two_ways", with_notes(f", {LINKS}, {KEYS} SELECT count(*) AS exact, count(*) AS rough, true AS agree FROM broken"))
def broken_two_ways(spark, sf):
    n = notes(spark, sf)
    a = L.broken_links(P.wikilinks(n), n).agg(F.count("*").alias("exact"))
    both = a.crossJoin(L.rough_broken_count(n).withColumnRenamed("rough_broken", "rough"))  # one row each
    return both.withColumn("agree", F.col("exact") == F.col("rough"))


@plan("related_pages", with_rich(r""", n AS (SELECT CAST(page_id AS STRING) AS path, CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'c' || (page_id % 40) END AS cluster, html FROM pages_rich),
  h AS (SELECT DISTINCT path, cluster, regexp_replace(x, '^www\.', '') AS host FROM (SELECT path, cluster, unnest(regexp_extract_all(html, 'https?://([^/\s)]+)', 1)) AS x FROM n)),
  pairs AS (SELECT a.path, b.path AS other, 0 AS tier FROM n a JOIN n b ON a.cluster = b.cluster AND a.path <> b.path
    UNION ALL SELECT DISTINCT a.path, b.path, 1 FROM h a JOIN h b ON a.host = b.host AND a.path <> b.path AND (a.cluster IS NULL OR b.cluster IS NULL OR a.cluster <> b.cluster))
  SELECT path, pos, other, CASE tier WHEN 0 THEN 'sibling' ELSE 'host' END AS why FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier, other) AS pos FROM pairs) WHERE pos <= 6"""))
def related_pages(spark, sf):
    from ..functions import urls as U
    d = pages_rich(spark, sf).select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 6 != 0, F.concat(
        F.lit("c"), (F.col("page_id") % 40).cast("string"))).alias("cluster"), U.hosts_of(F.col("html")).alias("hosts"))
    return L.related(d)


# -- graph -------------------------------------------------------------------------
NRM = r"""nn AS (SELECT regexp_replace(id, '^([^:]+::)+', '') AS id, label, CASE WHEN file_type IN ('code', 'concept', 'document', 'image', 'paper', 'rationale') THEN file_type ELSE 'concept' END AS file_type, source_file, id AS raw FROM graph_nodes),
  gn AS (SELECT id, arg_min(label, raw || label || source_file) AS label, arg_min(file_type, raw || label || source_file) AS file_type, arg_min(source_file, raw || label || source_file) AS source_file FROM nn GROUP BY id),
  ge AS (SELECT DISTINCT regexp_replace(source, '^([^:]+::)+', '') AS source, regexp_replace(target, '^([^:]+::)+', '') AS target, relation, type, label, source_file FROM graph_edges)"""
LAB = r"regexp_replace(lower(regexp_replace(coalesce(label, id), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
TPL = "(" + ", ".join(f"'{x}'" for x in rules.TEMPLATE_LABELS) + ")"
STRUCT = "|".join(rules.STRUCTURAL_PARTS)
CLEAN = rf"""kn AS (SELECT *, {LAB} AS low FROM gn WHERE file_type = 'code' OR ({LAB} NOT IN {TPL} AND NOT regexp_matches({LAB}, '{STRUCT}'))),
  kp AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM ge WHERE source <> target AND source IN (SELECT id FROM kn) AND target IN (SELECT id FROM kn)),
  deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM kp UNION ALL SELECT v FROM kp) GROUP BY id),
  kd AS (SELECT kn.*, coalesce(degree, 0) AS degree FROM kn LEFT JOIN deg USING (id)),
  canon AS (SELECT low, first(id ORDER BY degree DESC, id) AS new FROM kd WHERE file_type <> 'code' GROUP BY low),
  idmap AS (SELECT id AS old, new FROM kd JOIN canon USING (low) WHERE file_type <> 'code' AND id <> new),
  mn AS (SELECT id, label FROM kn WHERE id NOT IN (SELECT old FROM idmap)),
  mp AS (SELECT DISTINCT least(s, t) AS u, greatest(s, t) AS v FROM (SELECT coalesce(a.new, u) AS s, coalesce(b.new, v) AS t FROM kp LEFT JOIN idmap a ON a.old = u LEFT JOIN idmap b ON b.old = v) WHERE s <> t)"""


def comp_sql(nodes: str, pairs: str, tag: str) -> str:
    return (f"sym{tag} AS (SELECT u AS a, v AS b FROM {pairs} UNION SELECT v, u FROM {pairs}), "
            f"reach{tag} AS (SELECT id, id AS root FROM {nodes} UNION SELECT s.b, r.root FROM reach{tag} r JOIN sym{tag} s ON s.a = r.id WHERE r.root < s.b), "
            f"comp{tag} AS (SELECT id, min(root) AS component FROM reach{tag} GROUP BY id)")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@plan("graph_normalised_nodes", with_graph(f", {NRM} SELECT id, label, file_type, source_file FROM gn"))
def graph_normalised_nodes(spark, sf):
    return G.normalise(*graph(spark, sf))[0]


@plan("graph_normalised_edges", with_graph(f", {NRM} SELECT * FROM ge"))
def graph_normalised_edges(spark, sf):
    return G.normalise(*graph(spark, sf))[1]


@plan("graph_normalise_counts", with_graph(f""", {NRM} SELECT (SELECT count(*) FROM graph_nodes WHERE id LIKE '%::%') AS stripped_namespaces,
  (SELECT count(*) FROM graph_nodes WHERE file_type NOT IN ('', 'code', 'concept', 'document', 'image', 'paper', 'rationale')) AS normalised_file_types,
  (SELECT count(*) FROM graph_nodes) - (SELECT count(*) FROM gn) AS merged_nodes, (SELECT count(*) FROM graph_edges) - (SELECT count(*) FROM ge) AS dropped_edges"""))
def graph_normalise_counts(spark, sf):
    return G.normalise_stats(*graph(spark, sf))


@plan("graph_stats", with_graph("""SELECT 'nodes' AS measure, count(*) AS value FROM graph_nodes UNION ALL SELECT 'edges', count(*) FROM graph_edges
  UNION ALL SELECT 'bad_file_types', count(*) FROM graph_nodes WHERE file_type = 'conzept'
  UNION ALL SELECT 'prefix:' || split_part(id, '::', 1), count(*) FROM graph_nodes GROUP BY ALL"""))
def graph_stats(spark, sf):
    return G.stats(*graph(spark, sf))


@plan("graph_without_templates", with_graph(f", {NRM}, {CLEAN} SELECT id, label, file_type, low = '' AS blank FROM kn"))
def graph_without_templates(spark, sf):
    kept, _, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    return kept.select("id", "label", "file_type", (G.norm_label(F.coalesce("label", "id")) == "").alias("blank"))


@plan("graph_merged_edges", with_graph(f", {NRM}, {CLEAN} SELECT u, v FROM mp"))
def graph_merged_edges(spark, sf):
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    return G.merge_duplicates(kept, edges)[1]


@plan("graph_hyper_edges", with_graph(""" SELECT source, list_transform(ms, lambda m: 'topic::' || regexp_extract(m, '-(.*)$', 1)) AS members FROM (SELECT id AS source, 'none' AS target,
    list(e.target ORDER BY e.target) AS ms FROM graph_nodes n JOIN graph_edges e ON e.source = n.id WHERE e.relation = 'mentions' GROUP BY ALL)"""))
def graph_hyper_edges(spark, sf):
    _, e = graph(spark, sf)
    wide = e.filter("relation = 'mentions'").groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("nodes")).withColumn("target", F.lit("none"))
    ids = e.filter("relation = 'mentions'").select(F.col("target").alias("old"), F.concat(F.lit("topic::"), F.regexp_extract("target", "-(.*)$", 1)).alias("new")).distinct()
    return G.rewrite_ends(wide, ids).select("source", F.col("nodes").alias("members"))


@plan("graph_merge_map", with_graph(f", {NRM}, {CLEAN} SELECT old, new FROM idmap"))
def graph_merge_map(spark, sf):
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    return G.merge_duplicates(kept, edges)[2]


@plan("graph_review_labels", with_graph(f", {NRM} SELECT low AS label, count(*) AS n FROM (SELECT {LAB} AS low FROM gn WHERE file_type <> 'code') WHERE low NOT IN {TPL} GROUP BY low HAVING count(*) >= 4"))
def graph_review_labels(spark, sf):
    return G.frequent_labels(G.normalise(*graph(spark, sf))[0])


@plan("graph_components", recursive(with_graph(f", {NRM}, {CLEAN}, {comp_sql('mn', 'mp', '')} SELECT id, component FROM comp")))
def graph_components(spark, sf):
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    return G.components(nodes, pairs)


@plan("graph_clean_ledger", recursive(with_graph(f""", {NRM}, {CLEAN}, p0 AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM ge WHERE source <> target),
  {comp_sql('gn', 'p0', '0')}, {comp_sql('mn', 'mp', '1')},
  a AS (SELECT 'before' AS state, (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM p0) AS edges, count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM comp0 GROUP BY component)
    UNION ALL SELECT 'after', (SELECT count(*) FROM mn), (SELECT count(*) FROM mp), count(*), max(n) FROM (SELECT count(*) AS n FROM comp1 GROUP BY component))
  SELECT *, largest * 100 // nodes AS largest_pct, (SELECT count(*) FROM gn) - (SELECT count(*) FROM kn) AS dropped, (SELECT count(*) FROM idmap) AS merged FROM a""")))
def graph_clean_ledger(spark, sf):
    return G.clean_ledger(*G.normalise(*graph(spark, sf)))


@plan("graph_dropped_labels", with_graph(f", {NRM}, {CLEAN} SELECT {LAB} AS label, count(*) AS n FROM gn WHERE id NOT IN (SELECT id FROM kn) GROUP BY 1 ORDER BY n DESC, label LIMIT 8"))
def graph_dropped_labels(spark, sf):
    return G.dropped_labels(*G.normalise(*graph(spark, sf)))


@plan("graph_components_extended", recursive(with_graph(f", {NRM}, {CLEAN}, {comp_sql('mn', 'mp', '')} SELECT id, component FROM comp")))
def graph_components_extended(spark, sf):
    """The components of half of the links as a stored table, then the other half applied to it."""
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    nodes, pairs = cut_lineage(nodes), cut_lineage(pairs)
    early = F.crc32("v") % 2 == 0
    first = nodes.filter(F.crc32("id") % 3 > 0)
    inside = pairs.filter(early).join(first.select(F.col("id").alias("u")), "u", "left_semi").join(first.select(F.col("id").alias("v")), "v", "left_semi")
    return G.extend_components(cut_lineage(G.components(first, inside)), nodes, pairs.join(inside, ["u", "v"], "left_anti"))


@plan("graph_modularity", with_graph(f""", {NRM}, {CLEAN}, grp AS (SELECT id, substr(coalesce(label, id), 1, 1) AS c FROM mn),
  ends AS (SELECT a.c AS cu, b.c AS cv FROM mp JOIN grp a ON a.id = u JOIN grp b ON b.id = v), s AS (SELECT c, sum(inner_) AS inside, count(*) AS d FROM (
    SELECT cu AS c, CASE WHEN cu = cv THEN 1 ELSE 0 END AS inner_ FROM ends UNION ALL SELECT cv, 0 FROM ends) GROUP BY c), m AS (SELECT count(*) AS links FROM ends)
  SELECT CAST(links AS BIGINT) AS links, CAST(sum(4 * links * inside - d * d) AS BIGINT) AS gain, round(sum(inside / links - d * d / (4.0 * links * links)), 9) AS modularity FROM s, m GROUP BY links"""))
def graph_modularity(spark, sf):
    """Modularity of the grouping by the first letter of the label."""
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    d = G.modularity(G.weighted(pairs, nodes.select("id", F.substring(F.coalesce("label", "id"), 1, 1).alias("community"))))
    return d.select("links", F.col("gain").cast("bigint").alias("gain"), F.round("modularity", 9).alias("modularity"))


@plan("graph_modular_communities")
def graph_modular_communities(spark, sf):
    """Communities by modularity, each named after its best-connected member."""
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    nodes, pairs = cut_lineage(nodes), cut_lineage(pairs)
    return G.community_labels(G.modular_communities(nodes, pairs), nodes, pairs.select(F.col("u").alias("source"), F.col("v").alias("target")))


@plan("graph_communities")
def graph_communities(spark, sf):
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    comm = G.communities(nodes, pairs)
    return G.community_labels(comm, nodes, pairs.select(F.col("u").alias("source"), F.col("v").alias("target")))


@plan("graph_hubs", with_graph(f", {NRM}, {CLEAN} SELECT mn.id, label, n AS degree FROM (SELECT id, count(*) AS n FROM (SELECT u AS id FROM mp UNION ALL SELECT v FROM mp) GROUP BY id) d JOIN mn USING (id) ORDER BY n DESC, id LIMIT 10"))
def graph_hubs(spark, sf):
    kept, edges, _ = G.drop_templates(*G.normalise(*graph(spark, sf)))
    nodes, pairs, _ = G.merge_duplicates(kept, edges)
    return G.hubs(nodes, pairs.select(F.col("u").alias("source"), F.col("v").alias("target")))


_HALF_A, _HALF_B = "source_file < 'http://t'", "source_file >= 'http://m'"


@plan("graph_union_nodes", with_graph(f""", {NRM} SELECT id, arg_min(label, ord) AS label, arg_min(file_type, ord) AS file_type, arg_min(source_file, ord) AS source_file FROM (
   SELECT * FROM (SELECT id, arg_min(label, raw || label || source_file) AS label, arg_min(file_type, raw || label || source_file) AS file_type, arg_min(source_file, raw || label || source_file) AS source_file, 0 AS ord FROM nn WHERE {_HALF_A} GROUP BY id)
   UNION ALL SELECT * FROM (SELECT id, arg_min(label, raw || label || source_file), arg_min(file_type, raw || label || source_file), arg_min(source_file, raw || label || source_file), 1 AS ord FROM nn WHERE {_HALF_B} GROUP BY id)) GROUP BY id"""))
def graph_union_nodes(spark, sf):
    n, e = graph(spark, sf)
    return G.merge((n.filter(_HALF_A), e.filter(_HALF_A)), (n.filter(_HALF_B), e.filter(_HALF_B)))[0]


@plan("graph_replace_sources", with_graph(f""", {NRM}, files AS (SELECT DISTINCT source_file FROM graph_nodes WHERE id LIKE 'page::%3'),
   stale AS (SELECT id FROM gn WHERE source_file IN (SELECT source_file FROM files) AND (regexp_matches(id, '^[0-9a-f]{{8}}-') OR file_type = 'concept')),
   kept AS (SELECT * FROM ge WHERE source_file NOT IN (SELECT source_file FROM files) AND source NOT IN (SELECT id FROM stale) AND target NOT IN (SELECT id FROM stale)),
   fresh AS (SELECT * FROM ge WHERE source_file IN (SELECT source_file FROM files) AND relation = 'mentions')
   SELECT * FROM kept UNION SELECT * FROM fresh"""))
def graph_replace_sources(spark, sf):
    n, e = G.normalise(*graph(spark, sf))
    files = graph(spark, sf)[0].filter("id like 'page::%3'").select("source_file").distinct()
    fresh_n = n.join(files, "source_file", "left_semi").select(*n.columns)
    fresh_e = e.join(files, "source_file", "left_semi").filter("relation = 'mentions'").select(*e.columns)
    return G.replace_sources((n, e), files, (fresh_n, fresh_e))[1]


_ANCH = """anch AS (SELECT 'p/' || page_id AS source_file, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS l FROM pages)"""


def _extracted(spark, sf):
    from ..functions import text as T
    from .registry import table
    d = table(spark, sf, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("source_file"),
                                         T.find_all(F.col("html"), '<a href="/[^"]*">([^<]*)</a>', 1).alias("l"))
    return d.select("source_file", "l", F.posexplode("l").alias("ord", "label"))


def _slug_sql(e: str) -> str:
    return f"coalesce(nullif(substr(regexp_replace(regexp_replace(lower({e}), '[^a-zа-я0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50), ''), 'node')"


@plan("concept_nodes", f"WITH {_ANCH}, e AS (SELECT source_file, unnest(l) AS label, generate_subscripts(l, 1) AS ord FROM anch) SELECT substr(sha1(source_file), 1, 8) || '-' || {_slug_sql('label')} AS id, label, 'concept' AS file_type, source_file FROM e WHERE ord <= 8")
def concept_nodes(spark, sf):
    return G.concept_nodes(_extracted(spark, sf).select("source_file", "ord", F.col("label").alias("local_id"), "label"))


@plan("concept_edges", f"""WITH {_ANCH}, e AS (SELECT source_file, unnest(l) AS label, generate_subscripts(l, 1) AS ord, l FROM anch)
  SELECT substr(sha1(source_file), 1, 8) || '-' || {_slug_sql('label')} AS source, substr(sha1(source_file), 1, 8) || '-' || {_slug_sql('l[ord + 1]')} AS target, 'next' AS relation, 'INFERRED' AS type, source_file
  FROM e WHERE ord < len(l) AND ord <= 12 AND {_slug_sql('label')} <> {_slug_sql('l[ord + 1]')}""")
def concept_edges(spark, sf):
    d = _extracted(spark, sf).filter(F.col("ord") < F.size("l") - 1)
    return G.concept_edges(d.select("source_file", "ord", F.col("label").alias("source"),
                                    F.get("l", F.col("ord") + 1).alias("target"), F.lit("next").alias("relation")))


@plan("note_parts_by_section", with_notes("""SELECT section, CAST((rn - 1) // 25 + 1 AS BIGINT) AS part, count(*) AS n, min(path) AS first_path, max(parts) AS parts FROM (
  SELECT section, path, row_number() OVER (PARTITION BY section ORDER BY path) AS rn, CAST(ceil(count(*) OVER (PARTITION BY section) / 25) AS BIGINT) AS parts FROM notes) GROUP BY ALL"""))
def note_parts_by_section(spark, sf):
    from ..operators.rollups import fixed_parts
    d = fixed_parts(notes(spark, sf).select("section", "path"), ["section"], [F.col("path")], 25)
    return d.groupBy("section", "part").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("parts").alias("parts"))
