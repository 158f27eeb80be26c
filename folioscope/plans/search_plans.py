"""Search over documents for the topics of ``benchmark``; vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import numbers as N
from ..functions import text as T
from ..operators import search as S
from ..operators import vectors as V
from .registry import plan, table
from .text_plans import STOP_SQL, odistinct, sq


def docs(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("library/"), "source", F.lit("/"), "lang", F.lit(" note "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        "text", "doc_id")


def topics(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("topic"), "text")


DOCS = "docs AS (SELECT 'library/' || source || '/' || lang || ' note ' || doc_id || '.md' AS path, text, doc_id FROM documents)"
TOKS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]{{3,}}'), lambda x: x NOT IN " + STOP_SQL.replace("{", "{{") + ")"


def toks(e: str) -> str:
    return TOKS.format(e)


SCORES = f"""{DOCS}, tt0 AS (SELECT item_id AS topic, {odistinct(toks('text'))} AS terms FROM benchmark),
  tt AS (SELECT topic, terms, len(terms) AS n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM tt0),
  hay AS (SELECT path, {toks("path || chr(10) || text")} AS h, {toks('path')} AS rel FROM docs),
  posts AS (SELECT path, unnest(h) AS term, unnest(list_concat(h[2:], [NULL])) AS nxt, rel FROM hay),
  pt AS (SELECT topic, path, p.term, count(*) AS tf, bool_or(coalesce(nxt = terms[i + 1], false)) AS pair, max(n_terms) AS n_terms, bool_or(list_contains(rel, p.term)) AS named
    FROM posts p JOIN tt ON tt.term = p.term GROUP BY topic, path, p.term),
  sc AS (SELECT topic, path, greatest(CASE WHEN count(*) = max(n_terms) OR bool_or(pair) THEN sum(least(tf, 8) + CASE WHEN named THEN 4 ELSE 0 END) ELSE 0 END,
    max(least(tf, 8) + CASE WHEN named THEN 4 ELSE 0 END)) AS score FROM pt GROUP BY topic, path),
  cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, path) AS rank FROM sc) WHERE rank <= 60)"""


def _cands(spark, sf):
    return S.best_notes(docs(spark, sf), topics(spark, sf))


@plan("topic_search", f"WITH {SCORES} SELECT topic, rank, path, CAST(score AS BIGINT) AS score FROM cands")
def topic_search(spark, sf):
    return _cands(spark, sf).select("topic", "rank", "path", "score")


NORM = r"' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') || ' '"
SNIP = rf"""sn0 AS (SELECT topic, path, rank, score, text, norm, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM (
    SELECT c.topic, c.path, c.rank, c.score, d.text, {NORM} AS norm, terms FROM cands c JOIN docs d USING (path) JOIN tt0 USING (topic))),
  sn1 AS (SELECT *, strpos(norm, ' ' || term || ' ') - 1 AS hit FROM sn0 WHERE strpos(norm, ' ' || term || ' ') > 0),
  sn2 AS (SELECT topic, path, rank, score, i, """ + sq("substr(text, CAST(greatest(hit - 120, 0) + 1 AS INT), CAST(hit + 200 - greatest(hit - 120, 0) AS INT))") + r""" AS s FROM sn1),
  sn3 AS (SELECT topic, path, rank, score, s, min(i) AS i FROM sn2 WHERE s <> '' GROUP BY ALL),
  sn AS (SELECT topic, path, rank, score, string_agg(s, ' … ' ORDER BY i) AS insight FROM (SELECT *, row_number() OVER (PARTITION BY topic, path ORDER BY i) AS o FROM sn3) WHERE o <= 3 GROUP BY ALL)"""


@plan("search_findings", f"WITH {SCORES}, {SNIP} SELECT topic, path, rank, regexp_extract(text, 'https?://\\S+') AS source, insight, CAST(least(5, 2 + score // 4) AS BIGINT) AS relevance FROM sn JOIN docs USING (path)")
def search_findings(spark, sf):
    return S.findings(_cands(spark, sf), docs(spark, sf), topics(spark, sf))


@plan("search_themes", f"WITH {SCORES}, {SNIP} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY rank) AS pos, path AS title, insight AS points FROM sn QUALIFY row_number() OVER (PARTITION BY topic ORDER BY rank) <= 12")
def search_themes(spark, sf):
    return S.themes(S.findings(_cands(spark, sf), docs(spark, sf), topics(spark, sf)))


@plan("search_evidence", f"""WITH {SCORES}, w AS (SELECT c.topic, c.path, terms, text, CAST(unnest(range(0, length(text), 800)) AS INT) AS s FROM cands c JOIN docs USING (path) JOIN tt0 USING (topic)),
  ws AS (SELECT topic, path, s, substr(text, s + 1, 1000) AS body, len(list_intersect(terms, list_distinct({toks("substr(text, s + 1, 1000)")}))) AS n FROM w),
  b AS (SELECT *, row_number() OVER (PARTITION BY topic, path ORDER BY n DESC, s) AS o FROM ws)
  SELECT topic, path, md5(substr(string_agg('[' || (s + 1) || '–' || (s + length(body)) || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY s), 1, 2500)) AS digest FROM b WHERE o <= 2 GROUP BY topic, path""")
def search_evidence(spark, sf):
    d = S.with_texts(_cands(spark, sf), docs(spark, sf), topics(spark, sf))
    return d.select("topic", "path", F.md5(S.evidence(F.col("text"), F.col("terms"))).alias("digest"))


FACETS = [("motion", ["ing ", "tion"]), ("place", ["hier", "dans", "the "]), ("people", ["elle", "para"])]
_FN = {f: " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in xs) for f, xs in FACETS}
FACET = (f"CASE WHEN greatest({', '.join(_FN.values())}) = 0 THEN 'general' "
         + " ".join(f"WHEN {_FN[f]} = greatest({', '.join(_FN.values())}) THEN '{f}'" for f, _ in FACETS) + " END")


@plan("search_shards", f"""WITH {SCORES}, f AS (SELECT topic, path, rank, {FACET} AS facet FROM (SELECT c.*, lower(d.path || chr(10) || d.text) AS t FROM cands c JOIN docs d USING (path)))
  SELECT topic, facet, shard, count(*) AS n, min(rank) AS first_rank FROM (SELECT *, (row_number() OVER (PARTITION BY topic, facet ORDER BY rank) - 1) // 6 + 1 AS shard FROM f) GROUP BY ALL""")
def search_shards(spark, sf):
    d = _cands(spark, sf).join(docs(spark, sf).select("path", "text"), "path")
    d = d.withColumn("facet", S.facet_of(F.concat_ws("\n", "path", "text"), FACETS)).drop("text")
    return S.shards(d, ("topic", "facet")).groupBy("topic", "facet", "shard").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


@plan("search_shard_cap", f"""WITH {SCORES}, s AS (SELECT topic, (rank - 1) // 6 + 1 AS shard, count(*) AS n FROM cands GROUP BY ALL)
  SELECT topic, count(*) AS shards, count(*) FILTER (shard <= 8) AS kept, CAST(coalesce(sum(n) FILTER (shard > 8), 0) AS BIGINT) AS dropped_notes FROM s GROUP BY topic""")
def search_shard_cap(spark, sf):
    return S.shard_cap(S.shards(_cands(spark, sf)), max_shards=8)


VOTES = f"""{DOCS}, qw AS (SELECT item_id AS topic, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zа-яё0-9][a-zа-яё0-9-]*'),
   lambda x: length(x) >= 3 AND x NOT IN {STOP_SQL}))) AS w FROM benchmark), dw AS (SELECT DISTINCT w FROM qw),
  hit AS (SELECT path, w FROM docs JOIN dw ON contains(lower(text), w)), v AS (SELECT topic, path, count(*) AS votes FROM hit JOIN qw USING (w) GROUP BY ALL),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY votes DESC, path) AS pos FROM v) WHERE pos <= 7)"""


@plan("vote_ranking", f"WITH {VOTES} SELECT topic, path, votes, pos FROM ranked")
def vote_ranking(spark, sf):
    return S.vote_ranking(docs(spark, sf), topics(spark, sf))


_EXPECT = "SELECT item_id AS topic, CASE item_id % 3 WHEN 0 THEN ' Note ' || (item_id * 7) || '.md' WHEN 1 THEN 'src' || (item_id % 20) || '/' ELSE 'no such name ' || item_id END AS expect FROM benchmark"


def _expected(spark, sf):
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i.alias("topic"), F.when(i % 3 == 0, F.concat(F.lit(" Note "), (i * 7).cast("string"), F.lit(".md")))
                                                .when(i % 3 == 1, F.concat(F.lit("src"), (i % 20).cast("string"), F.lit("/")))
                                                .otherwise(F.concat(F.lit("no such name "), i.cast("string"))).alias("expect"))


@plan("retrieval_hits", f"WITH {VOTES}, x AS ({_EXPECT}) SELECT x.topic, coalesce(bool_or(contains(lower(path), lower(expect))), false) AS hit FROM x LEFT JOIN ranked r USING (topic) GROUP BY x.topic")
def retrieval_hits(spark, sf):
    return S.hit_at(S.vote_ranking(docs(spark, sf), topics(spark, sf)), _expected(spark, sf))


@plan("retrieval_missing", f"WITH {DOCS}, x AS ({_EXPECT}) SELECT topic FROM x WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE contains(lower(d.path), lower(x.expect)))")
def retrieval_missing(spark, sf):
    return S.missing_expectations(docs(spark, sf), _expected(spark, sf))


@plan("retrieval_cases", f"""WITH {SCORES}, c AS (SELECT b.item_id AS topic, d.path, b.item_id % 2 = 0 AS must_hit FROM benchmark b JOIN docs d ON d.doc_id IN (b.item_id, b.item_id * 3))
  SELECT topic, path, must_hit FROM c WHERE must_hit <> ((topic, path) IN (SELECT (topic, path) FROM cands))""")
def retrieval_cases(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("topic"), (F.col("item_id") % 2 == 0).alias("must_hit"),
                                             F.explode(F.array_distinct(F.array("item_id", F.col("item_id") * 3))).alias("doc_id"))
    cases = b.join(docs(spark, sf), "doc_id").select("topic", "path", "must_hit")
    return S.must_and_must_not(_cands(spark, sf), cases)


@plan("retrieval_totals", """SELECT 'method' || (doc_id % 3) AS method, count(*) FILTER (quality = 1) AS hits, count(*) FILTER (quality <> 1) AS misses,
   count(*) FILTER (quality = 1) < count(*) FILTER (toxic = 0) - 20 AS regressed FROM labels GROUP BY ALL""")
def retrieval_totals(spark, sf):
    d = table(spark, sf, "labels").withColumn("method", F.concat(F.lit("method"), (F.col("doc_id") % 3).cast("string")))
    base = d.groupBy("method").agg((F.count_if(F.col("toxic") == 0) - 20).alias("hits"))
    return S.retrieval_totals(d.select("method", F.col("doc_id").alias("topic"), (F.col("quality") == 1).alias("hit")), base).drop("before")


@plan("document_snippets", rf"""SELECT doc_id, t AS term, {sq("substr(text, CAST(greatest(hit - 120, 0) + 1 AS INT), CAST(hit + 200 - greatest(hit - 120, 0) AS INT))")} AS snippet FROM (
  SELECT doc_id, text, t, strpos(norm, ' ' || t || ' ') - 1 AS hit FROM (SELECT doc_id, text, {NORM} AS norm FROM documents), (SELECT unnest(['that', 'nicht', 'dans']) AS t)) WHERE hit >= 0""")
def document_snippets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in ("that", "nicht", "dans")])).alias("term"))
    return T.staged(d, snippet=T.snippet(F.col("text"), F.col("term"))).filter("snippet is not null").select("doc_id", "term", "snippet")


# -- vectors -------------------------------------------------------------------------
def vec_notes(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.lpad(v.cast("string"), 6, "0").alias("id"), F.col("embedding").alias("vec"),
        F.concat(F.lit("topic"), F.col("label").cast("string"), F.lit(" group"), (v % 3).cast("string")).alias("title"))


VEC = """n AS (SELECT lpad(CAST(vec_id AS STRING), 6, '0') AS id, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id % 3 AS grp FROM embeddings),
  p AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.vec, b.vec) AS cos, (CAST(a.label = b.label AS INT) + CAST(a.grp = b.grp AS INT)) / 2.0 AS sim FROM n a, n b),
  s AS (SELECT *, least(1.0, cos + CASE WHEN sim >= 0.5 THEN 0.3 * sim ELSE 0 END) AS combined FROM p)"""
MERGE, FLAG = 0.65, 0.5
LISTS = f"""l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, cos DESC, sim DESC, other DESC) AS pos FROM s WHERE combined >= {FLAG}) WHERE pos <= 8),
  be AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(combined) AS combined, max(cos) AS cos FROM l WHERE id <> other GROUP BY ALL),
  ends AS (SELECT a, b, e, row_number() OVER (PARTITION BY e ORDER BY combined DESC, a, b) AS rn FROM (SELECT a, b, combined, unnest([a, b]) AS e FROM be)),
  mut AS (SELECT be.* FROM be WHERE (SELECT count(*) FROM ends x WHERE x.a = be.a AND x.b = be.b AND rn <= 4) = 2)"""


@plan("vector_top_k", f"WITH {VEC} SELECT id, other, pos, round(cos, 6) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other DESC) AS pos FROM p) WHERE pos <= 3 AND cos >= 0.1")
def vector_top_k(spark, sf):
    n = vec_notes(spark, sf).drop("title")
    return V.nearest(n, n, 3, cos_floor=0.1, titles=False).select("id", "other", "pos", F.round("cos", 6).alias("cos"))


@plan("vector_titled_top_k", f"WITH {VEC} SELECT id, other, pos, round(cos, 6) AS cos, round(combined, 6) AS combined FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY combined DESC, cos DESC, sim DESC, other DESC) AS pos FROM s) WHERE pos <= 3 AND cos >= 0.3")
def vector_titled_top_k(spark, sf):
    n = vec_notes(spark, sf)
    return V.nearest(n, n, 3, cos_floor=0.3).select("id", "other", "pos", F.round("cos", 6).alias("cos"), F.round("combined", 6).alias("combined"))


@plan("vector_pairs", f"WITH {VEC} SELECT id AS a, other AS b, round(cos, 6) AS cos, round(sim, 6) AS title_sim, round(combined, 6) AS combined, CASE WHEN combined >= 0.9 THEN 'merge' WHEN combined >= 0.72 THEN 'flag' ELSE 'new' END AS zone FROM s WHERE id < other AND combined >= 0.45")
def vector_pairs(spark, sf):
    d = V.pairs(vec_notes(spark, sf), 0.45)
    return d.select("a", "b", *[F.round(c, 6).alias(c) for c in ("cos", "title_sim", "combined")], "zone")


@plan("vector_neighbours", f"WITH {VEC}, {LISTS} SELECT id AS note, other, pos, round(combined, 6) AS combined FROM l WHERE id <> other")
def vector_neighbours(spark, sf):
    return V.neighbours(vec_notes(spark, sf), merge=MERGE, flag=FLAG).select("note", "other", "pos", F.round("combined", 6).alias("combined"))


@plan("best_pair_edges", f"WITH {VEC}, {LISTS} SELECT a, b, round(combined, 6) AS combined, round(cos, 6) AS cos FROM be")
def best_pair_edges(spark, sf):
    d = V.best_edges(V.neighbours(vec_notes(spark, sf), merge=MERGE, flag=FLAG))
    return d.select("a", "b", F.round("combined", 6).alias("combined"), F.round("cos", 6).alias("cos"))


@plan("mutual_edges", f"WITH {VEC}, {LISTS} SELECT a, b, round(combined, 6) AS combined FROM mut")
def mutual_edges(spark, sf):
    d = V.mutual(V.best_edges(V.neighbours(vec_notes(spark, sf), merge=MERGE, flag=FLAG)))
    return d.select("a", "b", F.round("combined", 6).alias("combined"))


@plan("duplicate_clusters", f"""WITH RECURSIVE {VEC}, {LISTS}, sym AS (SELECT a, b FROM mut UNION SELECT b, a FROM mut),
  reach AS (SELECT a AS id, a AS root FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.id WHERE r.root < s.b),
  comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
  m AS (SELECT c.id, component, '2024-02-' || lpad(CAST(1 + CAST(c.id AS INT) % 5 AS STRING), 2, '0') AS date, 100 + CAST(c.id AS INT) % 4 AS chars FROM comp c),
  z AS (SELECT component, CASE WHEN bool_or(mut.combined >= {MERGE}) THEN 'merge' ELSE 'flag' END AS zone FROM mut JOIN comp ON comp.id = mut.a GROUP BY component)
  SELECT component, zone, count(*) AS size, first(id ORDER BY date DESC, chars DESC, id) AS canon, first(date ORDER BY date DESC, chars DESC, id) AS date,
    first(chars ORDER BY date DESC, chars DESC, id) AS chars FROM m JOIN z USING (component) GROUP BY component, zone""")
def duplicate_clusters(spark, sf):
    n = vec_notes(spark, sf)
    i = F.col("id").cast("int")
    meta = n.select("id", F.concat(F.lit("2024-02-"), F.lpad((1 + i % 5).cast("string"), 2, "0")).alias("date"), (100 + i % 4).alias("chars"))
    return V.duplicate_report(n, meta, merge=MERGE, flag=FLAG).select("component", "zone", "size", "canon", "date", "chars")


@plan("vector_rerank", f"""WITH {VEC}, q AS (SELECT lpad(CAST(item_id AS STRING), 6, '0') AS id, text FROM benchmark), d AS (SELECT lpad(CAST(doc_id AS STRING), 6, '0') AS other, 'note ' || doc_id || chr(10) || substr(text, 1, 400) AS head FROM documents),
  pool AS (SELECT * FROM (SELECT p.id, p.other, cos, row_number() OVER (PARTITION BY p.id ORDER BY cos DESC, p.other DESC) AS pos FROM p WHERE p.id IN (SELECT id FROM q) AND p.other IN (SELECT other FROM d)) WHERE pos <= 30),
  st AS (SELECT pool.*, list_distinct(list_transform(list_filter(regexp_extract_all(lower(q.text), '[a-zа-я0-9]+'), lambda x: length(x) >= 2), lambda x: substr(x, 1, 5))) AS qs,
    list_distinct(list_transform(list_filter(regexp_extract_all(lower(d.head), '[a-zа-я0-9]+'), lambda x: length(x) >= 2), lambda x: substr(x, 1, 5))) AS ds FROM pool JOIN q USING (id) JOIN d USING (other)),
  sh AS (SELECT *, len(list_intersect(qs, ds)) / len(qs) AS share FROM st)
  SELECT id, rank, other, round(cos, 6) AS cos, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, pos) AS rank FROM sh) WHERE rank <= 5""")
def vector_rerank(spark, sf):
    v = vec_notes(spark, sf).select("id", "vec")
    q = table(spark, sf, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("id"), "text")
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("id"), F.concat(
        F.lit("note "), F.col("doc_id").cast("string")).alias("title"), "text")
    r = V.rerank(v.join(q, "id"), v.join(d, "id"))
    return r.select("id", "rank", "other", F.round("cos", 6).alias("cos"), F.round("share", 6).alias("share"))


@plan("index_append", """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS batch, len(embedding) AS width,
   round(CAST(CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 5) AS head FROM embeddings""")
def index_append(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    old = e.withColumn("batch", F.lit(1))
    new = e.filter("id % 3 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec"), F.lit(2).alias("batch"))
    d = V.last_write_wins(old, new)
    return d.select("id", "batch", F.size("vec").alias("width"), F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("head"))


@plan("title_similarity", r"""SELECT a.doc_id, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) ELSE 0 END, 6) AS sim,
  round(least(1.0, 0.6 + CASE WHEN len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.5 THEN 0.3 * len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) ELSE 0 END), 6) AS combined
  FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-zа-я0-9]+'), lambda x: length(x) >= 2)) AS t FROM documents) a
  JOIN (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-zа-я0-9]+'), lambda x: length(x) >= 2)) AS t FROM documents) b ON b.doc_id = a.doc_id + 1""")
def title_similarity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.get(T.lines_of(F.col("text")), F.lit(0)).alias("title"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    shared, small = V.title_words(F.col("title"), F.col("other"))
    j = T.staged(d.join(nxt, "doc_id"), shared=shared, small=small)
    j = T.staged(j, s=F.when(F.col("small") > 0, F.col("shared") / F.col("small")).otherwise(0.0))
    # three tenths of a whole number before it is divided: a double of a ratio would move ties of the sixth digit
    lift = F.when(F.col("s") >= V.TITLE_MIN, F.col("shared") * 3 / 10 / F.col("small")).otherwise(0.0)
    return j.select("doc_id", N.half_up(F.col("s"), 6).alias("sim"), N.half_up(F.least(F.lit(1.0), 0.6 + lift), 6).alias("combined"))
