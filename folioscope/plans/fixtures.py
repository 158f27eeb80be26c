"""Views derived from the given tables, spelled once for Spark and DuckDB.

``notes`` turns every document into a Markdown note whose head, sections, links
and faults follow from the document number; ``graph_nodes``/``graph_edges`` read
the links of ``pages`` as a concept graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from .registry import table

_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a derived input once per session and read it back, as the jobs of a
    real corpus would: a columnar scan with pruning instead of an expression."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{abs(hash(sf_dir)):x}-{name}"
        build().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])

# two engines, five spellings
_SPARK = {"sha": "sha2({}, 256)", "hours": "timestampadd(HOUR, {}, TIMESTAMP '2024-01-01 00:00:00')"}
_DUCK = {"sha": "sha256({})", "hours": "(TIMESTAMP '2024-01-01 00:00:00' + to_hours({}))"}

SECTIONS = ["02 Знания", "08 AI и Инструменты", "02 Здоровье", "03 Проекты", "01 Право и Юриспруденция",
            "09 Технологии", "_drafts"]
REMARKS = ["Данный подход является ключевым для команды.",
           "В современном мире стоит отметить, что это не просто идея, а метод.",
           "Таким образом, не только скорость, но и качество растёт.",
           "Мы проверили сборку на трёх машинах и записали время.",
           "Комплексный подход в рамках проекта, на основе данных — это :contentReference[1].",
           "raw ocr IMG_1234.PNG intake-draft",
           "See https://github.com/acme/tool-@k and v1.2.3 on 2024-05-0@d, run scripts/check.py twice."]


def _case(expr: str, options: list[str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(options))
    return f"CASE {expr} {arms} ELSE '{default if default is not None else options[-1]}' END"


def _notes(d: dict[str, str]) -> str:
    nl = "chr(10)"
    k = "CAST(k AS STRING)"
    day = "lpad(CAST(1 + k % 28 AS STRING), 2, '0')"
    name = "concat('note ', {})"
    remark = _case("k % 7", REMARKS)
    remark = f"replace(replace({remark}, '@k', CAST(k % 9 AS STRING)), '@d', CAST(1 + k % 9 AS STRING))"
    head = f"""concat(
      'title: "Note ', {k}, ' ', CASE k % 4 WHEN 0 THEN 'agent memory' WHEN 1 THEN 'trading desk'
         WHEN 2 THEN 'api gateway' ELSE 'weekly log' END, '"', {nl},
      'type: ', {_case("k % 8", ["concept", "tool-card", "decision", "synthesis", "agent-research", "reference",
                                  "tool-map", "old-digest"])}, {nl},
      'source: ', CASE WHEN k % 9 = 0 THEN '' ELSE concat('https://www.site', CAST(k % 13 AS STRING), '.example.com/p/', {k}) END, {nl},
      'verified: ', {_case("k % 5", ["подтверждён", "не-проверялось", "true", "false",
                                      "непроверяемо-методом (видео)"])}, {nl},
      'subject: ', {_case("k % 4", ["world", "self", "", "planet"])}, {nl},
      CASE WHEN k % 3 = 0 THEN concat('source_type: video', {nl}) ELSE '' END,
      CASE WHEN k % 10 = 3 THEN concat('data_class: public', {nl}) WHEN k % 10 = 7 THEN concat('data_class: secret', {nl}) ELSE '' END,
      CASE WHEN k % 23 = 0 THEN concat('section: 77 Unknown', {nl}) ELSE '' END,
      CASE WHEN k % 12 = 0 THEN concat('project: alpha', {nl}, 'repo: acme/tool', {nl}, 'stars: 12', {nl},
                                       'license: MIT', {nl}, 'risk: low', {nl}) ELSE '' END,
      'project_categories: [', CASE k % 6 WHEN 0 THEN 'данные, "unknown-kind"' WHEN 1 THEN '' ELSE 'Прочие сигналы знаний' END, ']', {nl},
      'projects: [', CASE WHEN k % 12 = 0 THEN 'client-law, "atlas"' ELSE 'atlas' END, ']', {nl},
      'sources:', {nl}, '  - "inbox/file-', {k}, '.pdf"', {nl}, '  - notes-', CAST(k % 50 AS STRING), '.docx', {nl},
      CASE WHEN k % 5 = 0 THEN concat('updated: 2024-06-', {day}, {nl}) ELSE '' END,
      CASE WHEN k % 2 = 0 THEN concat('created: 2024-03-', {day}, {nl}) ELSE '' END,
      CASE WHEN k % 6 = 0 THEN concat('status: "final"', {nl}, 'verified_by: desk', {nl}, 'verification_status: "verified"', {nl},
                                      'enrichment: "external-research"', {nl}) ELSE '' END,
      '# a comment', {nl})"""
    body = f"""concat(
      '# Note ', {k}, {nl}, {nl},
      '## Короткий ответ', {nl}, {remark}, {nl},
      text, {nl},
      '## Что это', {nl}, '- Проект Атлас хранит записи о работе и помогает найти прежние решения.', {nl},
      '### Подробно', {nl}, 'Second level text for [[', CASE WHEN k % 2 = 0 THEN concat('2024-01-', lpad(CAST(1 + ((7 * k) % n) % 28 AS STRING), 2, '0'), ' - ') ELSE '' END,
        'note ', CAST((7 * k) % n AS STRING), '|alias]] and `code [[hidden inline]]`.', {nl},
      CASE WHEN k % 17 = 0 THEN concat('Broken [[missing ', CAST(k % 5 AS STRING), '#part]] and [[...]] and [[scan.pdf]].', {nl}) ELSE '' END,
      CASE WHEN k % 19 = 0 THEN concat('```', {nl}, '[[hidden fence]]', {nl}, '```', {nl}) ELSE '' END,
      '## Как это поможет мне', {nl}, CASE WHEN k % 4 = 1 THEN 'Ничего конкретного.' ELSE 'Для Атласа: Прочие сигналы знаний.' END, {nl},
      CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN concat('## Достоверность', {nl})
           WHEN k % 3 = 0 THEN concat('## Достоверность', {nl}, 'Сверено 2024-05-0', CAST(1 + k % 9 AS STRING), ' по первоисточнику.', {nl})
           ELSE concat('## Достоверность', {nl}, 'Сверено по первоисточнику.', {nl}) END,
      CASE WHEN k % 6 = 0 THEN concat('Факты, добавленные до атомизации:', {nl}, '- first fact', {nl}, '- second fact', {nl},
           '## Источники', {nl}, 'Публичные источники:', {nl}, '- https://www.site', CAST(k % 13 AS STRING), '.example.com/p/', {k}, {nl}) ELSE '' END,
      CASE WHEN k % 2 = 0 THEN concat('## Следующее действие', {nl}, 'Локальные source refs:', {nl}, '- local-media:', substr(h, 1, 16), {nl}) ELSE '' END)"""
    return f"""SELECT path, base, section, text, mtime, k FROM (SELECT
      concat(section, '/', base) AS path, base, section, k, {d['hours'].format('CAST(k AS INT)')} AS mtime,
      CASE WHEN k % 97 = 0 THEN body
           WHEN k % 89 = 0 THEN concat('---', {nl}, head, replace(body, concat({nl}, '---', {nl}), {nl}))
           WHEN k % 83 = 0 THEN concat('---', {nl}, head, 'type: again', {nl}, '---', {nl}, body)
           WHEN k % 79 = 0 THEN concat('---', {nl}, head, '!! odd line', {nl}, '---', {nl}, body)
           ELSE concat('---', {nl}, CASE WHEN k % 6 = 0 THEN replace(head, 'подтверждён', 'подтвержден') ELSE head END, '---', {nl}, body) END AS text
      FROM (SELECT k, {_case("k % 7", SECTIONS)} AS section,
        concat('2024-01-', {day}, ' - ', {name.format(k)}, '.md') AS base, {head} AS head, {body} AS body
        FROM (SELECT doc_id AS k, text, {d['sha'].format('text')} AS h, (SELECT count(*) FROM documents) AS n FROM documents) q0) q1) q2"""


NOTES_DUCK = f"notes AS ({_notes(_DUCK)})"
NOTES_SPARK = _notes(_SPARK)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "notes", lambda: spark.sql(
        "WITH documents AS (SELECT doc_id, text FROM {docs}) " + NOTES_SPARK, docs=table(spark, sf_dir, "documents")))


# -- concept graph of the pages ------------------------------------------------
# One document node per page, one concept node per (page, anchor text), one edge
# between them.  Ids carry a namespace and two spellings of the file type, so
# normalisation has something to do.
def _graph_nodes(anchors: str, sha: str) -> str:
    return f"""SELECT concat('page::', CAST(page_id AS STRING)) AS id, concat('Page ', CAST(page_id AS STRING)) AS label,
          'document' AS file_type, url AS source_file FROM pages
      UNION ALL
      SELECT concat('kb::', substr({sha}(url), 1, 8), '-', lower(label)) AS id,
          CASE WHEN label = 'it' THEN 'Источник' ELSE label END AS label,
          CASE page_id % 5 WHEN 0 THEN 'conzept' WHEN 1 THEN '' WHEN 2 THEN 'code' ELSE 'concept' END AS file_type,
          url AS source_file FROM ({anchors}) a"""


def _graph_edges(anchors: str, sha: str) -> str:
    return f"""SELECT concat('page::', CAST(page_id AS STRING)) AS source,
          concat('kb::', substr({sha}(url), 1, 8), '-', lower(label)) AS target, 'mentions' AS relation,
          CASE page_id % 3 WHEN 0 THEN 'EXTRACTED' ELSE 'INFERRED' END AS type, label, url AS source_file FROM ({anchors}) a
      UNION ALL
      SELECT concat('kb::', substr({sha}(url), 1, 8), '-', lower(label)) AS source, concat('page::', CAST(page_id AS STRING)) AS target,
          'part_of' AS relation, 'EXTRACTED' AS type, '' AS label, url AS source_file FROM ({anchors}) a WHERE page_id % 4 = 0"""


_ANCHOR_RX = '<a href="/[^"]*">([^<]*)</a>'
_ANCH_SPARK = ("SELECT page_id, url, explode(array_distinct(regexp_extract_all(html, '" + _ANCHOR_RX + "', 1))) AS label FROM pages")
_ANCH_DUCK = ("SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '" + _ANCHOR_RX + "', 1))) AS label FROM pages")
GRAPH_DUCK = (f"graph_nodes AS ({_graph_nodes(_ANCH_DUCK, 'sha1')}), graph_edges AS ({_graph_edges(_ANCH_DUCK, 'sha1')})")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    pre = "WITH pages AS (SELECT page_id, url, html FROM {p}) "
    # one address on two pages gives a node twice with two file types: the page that comes first decides, as a scan would
    nodes = _graph_nodes(_ANCH_SPARK, "sha1").replace("url AS source_file FROM", "url AS source_file, page_id AS seq FROM")
    return (stored(spark, sf_dir, "graph_nodes", lambda: spark.sql(pre + nodes, p=pages)),
            stored(spark, sf_dir, "graph_edges", lambda: spark.sql(pre + _graph_edges(_ANCH_SPARK, "sha1"), p=pages)))


# -- pages with the marks real sites carry --------------------------------------
_RICH = """concat(html,
  CASE page_id % 2 WHEN 0 THEN concat('<meta name="description" content="Desc ', CAST(page_id AS STRING), ' ">')
       ELSE concat('<meta content="Alt ', CAST(page_id AS STRING), '" property="og:description">') END,
  '<script type="application/ld+json">', CASE page_id % 5
     WHEN 0 THEN concat('{"@type":"Article","name":" Page ', CAST(page_id AS STRING), ' "}')
     WHEN 1 THEN '[{"@type":["News","Post"],"headline":"H1"},{"@type":"Thing"},{"x":1}]'
     WHEN 2 THEN '{"@graph":[{"@type":"Org","name":"O"},{"@type":"Org","name":"O"},{"title":"T"}]}'
     WHEN 3 THEN '{broken' ELSE '{"note":"none"}' END, '</script>',
  '<script>fetch("/api/v1/items/', CAST(page_id AS STRING), '"); var u = "', {origin}, '/v2/list"; var w = "https://other.example.org/api/x";</script>',
  '<p>See https://github.com/acme/tool-', CAST(page_id % 7 AS STRING), '.git, https://github.com/acme/tool-', CAST(page_id % 7 AS STRING),
  '/releases http://localhost:80/x http://192.168.1.', CAST(page_id % 200 AS STRING), '/a http://10.0.0.1 http://100.72.0.9/ https://www.site',
  CAST(page_id % 11 AS STRING), '.example.com/p?q=1. and github.com/org/repo-', CAST(page_id % 4 AS STRING), '; http://[fe80::1]/z http://a.local/</p>',
  '<p>', CASE page_id % 3 WHEN 0 THEN 'Open source agent memory with security review and a browser.' WHEN 1 THEN 'Terraform and observability for startups.' ELSE '' END, '</p>',
  '<a href="/docs/start">Start</a> <a href="guide.html#x">User <b>Guide</b></a> <a href="https://swagger.io/x">API</a> <a href="//cdn.example.com/a">x</a> <a href="?page=3">next</a>')"""


def rich_html(origin: str) -> str:
    return _RICH.replace("{origin}", origin)


RICH_DUCK = ("pages_rich AS (SELECT page_id, url, "
             + rich_html("regexp_extract(url, '^https?://[^/?#]+')") + " AS html FROM pages)")


def pages_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = rich_html("regexp_extract(url, '^https?://[^/?#]+', 0)")
    return stored(spark, sf_dir, "pages_rich", lambda: table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", f"{html} AS html"))


def with_rich(sql: str) -> str:
    return f"WITH {RICH_DUCK} {sql}"


def with_notes(sql: str) -> str:
    return f"WITH {NOTES_DUCK} {sql}"


def with_graph(sql: str) -> str:
    return f"WITH {GRAPH_DUCK} {sql}"
