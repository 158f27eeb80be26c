"""Streams over the given tables, run to the end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import job_life as L
from ..streaming import jobs as S
from .registry import plan, table
from .rollup_plans import RUNS, STEP


def _source(spark, sf, name):
    """A given table as a stream, be it one file or a folder of parts.

    A file source lists folders or globs; the last letter as a class makes the
    path a glob that matches the table alone.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _room(spark, name):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex[:8]}"


@plan("observation_stream", RUNS)
def observation_stream(spark, sf):
    i = F.col("event_id")
    obs = _source(spark, sf, "events").select(F.col("user_id").alias("run_id"), (i % 4).alias("tier"), (i % 7 > 0).alias("deep"),
                                              F.when(i % 11 == 0, "failed").when(i % 3 == 0, "cached").otherwise("processed").alias("status"))
    room = _room(spark, "runs")
    S.run_available(S.run_status(obs), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return S.latest_per_key(spark, f"{room}/out", ["run_id"])


@plan("new_file_stream", "SELECT sha256(text) AS sha256, length(any_value(text)) AS n_chars FROM documents WHERE length(text) >= 40 GROUP BY sha256(text)")
def new_file_stream(spark, sf):
    docs = _source(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    room = _room(spark, "files")
    extract = S.accept_new(lambda d: d.withColumn("text", F.when(F.length("content") >= 40, F.col("content"))), room)
    S.run_available(S.unseen(docs, ["sha256"]), extract, f"{room}/cp")
    return spark.read.parquet(f"{room}/accepted").select("sha256", F.length("text").alias("n_chars"))


@plan("feed_stream", "SELECT user_id AS channel, event_type AS id, count(*) > 0 AS seen FROM events GROUP BY ALL")
def feed_stream(spark, sf):
    e = _source(spark, sf, "events").select(F.col("user_id").alias("channel"), F.col("event_type").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    room = _room(spark, "feed")
    S.run_available(S.fresh_items(e, ["channel", "id"], "ts", "60 days"), S.batch_writer(f"{room}/out"), f"{room}/cp")
    return spark.read.parquet(f"{room}/out").select("channel", "id", F.lit(True).alias("seen"))


@plan("ratchet_stream", "SELECT event_type AS gate, min(event_id % 1000 + 7) AS ceiling FROM events GROUP BY event_type")
def ratchet_stream(spark, sf):
    e = _source(spark, sf, "events").select(F.col("event_type").alias("gate"), (F.col("event_id") % 1000 + 7).alias("failures"))
    room = _room(spark, "ratchet")
    S.run_available(S.ceilings(e), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return S.latest_per_key(spark, f"{room}/out", ["gate"])


@plan("floor_stream", "SELECT event_type AS gate, max(event_id % 1000 + 7) AS floor FROM events GROUP BY event_type")
def floor_stream(spark, sf):
    e = _source(spark, sf, "events").select(F.col("event_type").alias("gate"), (F.col("event_id") % 1000 + 7).alias("floor"))
    room = _room(spark, "floors")
    S.run_available(S.floors(e), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return S.latest_per_key(spark, f"{room}/out", ["gate"])


@plan("red_check_stream", """WITH c AS (SELECT CAST(user_id AS STRING) AS "check", ts, event_type <> 'view' AS red FROM events), g AS (SELECT "check", max(ts) AS green FROM c WHERE NOT red GROUP BY ALL)
   SELECT c."check", epoch_us(min(ts)) AS first_red_us FROM c LEFT JOIN g ON g."check" = c."check" WHERE red AND (green IS NULL OR ts > green) GROUP BY c."check" """)
def red_check_stream(spark, sf):
    d = S.latest_per_key(spark, _red_checks(spark, sf), ["check"]).drop("kind").distinct()
    return d.filter("first_red_at is not null").select("check", F.unix_micros("first_red_at").alias("first_red_us"))


def _red_checks(spark, sf):
    e = _source(spark, sf, "events").select(F.col("user_id").cast("string").alias("check"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "view").alias("red"))
    room = _room(spark, "red")
    S.run_available(S.red_since(e, LATE_DAYS, RED_DAYS), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return f"{room}/out"


#: Event time trails the newest report by so many days; a check may be red for so many.
LATE_DAYS, RED_DAYS = 7, 1


@plan("overdue_check_stream", f"""WITH c AS (SELECT CAST(user_id AS STRING) AS "check", ts, event_type <> 'view' AS red FROM events), g AS (SELECT "check", max(ts) AS green FROM c WHERE NOT red GROUP BY ALL),
   f AS (SELECT c."check", min(ts) AS first FROM c LEFT JOIN g ON g."check" = c."check" WHERE red AND (green IS NULL OR ts > green) GROUP BY c."check")
   SELECT "check", epoch_us(first) AS first_red_us FROM f WHERE epoch_ms(first) + {RED_DAYS} * 86400000 < (SELECT epoch_ms(max(ts)) - {LATE_DAYS} * 86400000 FROM c)""")
def overdue_check_stream(spark, sf):
    """What the timers raise: checks red for too long by event time, silent ones included."""
    d = spark.read.parquet(_red_checks(spark, sf)).filter("kind = 'overdue'")
    return d.select("check", F.unix_micros("first_red_at").alias("first_red_us")).distinct()


@plan("life_cycle_stream", f"SELECT user_id AS item, arg_max({STEP}, ts) AS status, count(*) AS events FROM events GROUP BY user_id")
def life_cycle_stream(spark, sf):
    e = _source(spark, sf, "events").selectExpr("user_id AS item", "ts", "event_id AS seq", f"{STEP} AS status")
    room = _room(spark, "items")
    S.run_available(S.item_states(e), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return S.latest_per_key(spark, f"{room}/out", ["item"])


@plan("refresh_stream", "SELECT doc_id, length(text) AS n FROM documents")
def refresh_stream(spark, sf):
    d = _source(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    room = _room(spark, "refresh")
    sink = S.refresh_changed(lambda x: x.select("cache_key", F.col("path").alias("doc_id"), F.length("text").alias("n")), f"{room}/out")
    S.run_available(S.changed(d, {"version": "1"}), sink, f"{room}/cp")
    return spark.read.parquet(f"{room}/out").select("doc_id", "n")


@plan("message_stream", "SELECT role, count(*) AS n, max(conv_id) AS last_conv FROM conversations GROUP BY role")
def message_stream(spark, sf):
    m = _source(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.max("conv_id").alias("last_conv"))
    room = _room(spark, "messages")
    S.run_available(m, S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return S.latest_per_key(spark, f"{room}/out", ["role"])


#: A log of jobs over the events: three jobs for each fingerprint, twelve kinds of rows in the log.
_ACTIONS = ("submit", "submit", "submit", "start", "start", "start", "fail", "complete", "cancel", "retry", "recover", "block")


def _next_status() -> str:
    return "CASE e.action || ':' || r.s[e.j] " + " ".join(
        f"WHEN '{a}:{x}' THEN '{y}'" for a, m in L.STEPS.items() for x, y in m.items()) + " END"


_LIFE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, (event_id // 12) % 3 + 1 AS j, {list(_ACTIONS)}[event_id % 12 + 1] AS action,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT k, 0::BIGINT AS n, ['', '', ''] AS s, [0, 0, 0] AS a, [0, 0, 0]::BIGINT[] AS c, NULL::BIGINT AS seq, NULL::BIGINT AS j, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, NULL::VARCHAR AS before, NULL::BIGINT AS of
      FROM (SELECT DISTINCT k FROM e)
    UNION ALL SELECT k, n, list_transform([1, 2, 3], lambda i: CASE WHEN i = j AND outcome = 'applied' THEN CASE action WHEN 'submit' THEN 'queued' ELSE nxt END ELSE s[i] END),
      list_transform([1, 2, 3], lambda i: CASE WHEN i = j AND outcome = 'applied' AND action = 'start' THEN a[i] + 1 ELSE a[i] END),
      list_transform([1, 2, 3], lambda i: CASE WHEN i = j AND outcome = 'applied' AND action = 'submit' THEN n ELSE c[i] END), seq, j, action, outcome, before, CASE outcome WHEN 'duplicate' THEN of END
    FROM (SELECT *, CASE WHEN action = 'submit' THEN CASE WHEN of IS NOT NULL THEN 'duplicate' WHEN before = '' THEN 'applied' ELSE 'illegal' END
        WHEN nxt IS NOT NULL THEN 'applied' WHEN before <> '' AND action IN {L.HARMLESS} THEN 'ignored' ELSE 'illegal' END AS outcome FROM (
      SELECT e.*, r.s, r.a, r.c, r.s[e.j] AS before, {_next_status()} AS nxt,
        list_min(list_transform(list_filter([1, 2, 3], lambda i: r.s[i] IN {L.LIVE}), lambda i: {{'c': r.c[i], 'i': i}})).i AS of
      FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1)))"""


def _life(spark, sf):
    at = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") % 12 + 1).cast("int"))
    user = F.col("user_id").cast("string")
    log = _source(spark, sf, "events").select(user.alias("fingerprint"), F.concat_ws("-", user, F.floor(F.col("event_id") / 12) % 3).alias("job"),
                                              F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), at.alias("action"))
    room = _room(spark, "life")
    S.run_available(L.job_life(log), S.batch_writer(f"{room}/out"), f"{room}/cp", "update")
    return f"{room}/out"


@plan("job_life_stream", _LIFE_SQL + """ SELECT k || '-' || (i - 1) AS job, s[i] AS status, a[i] AS attempts FROM (SELECT k, arg_max(s, n) AS s, arg_max(a, n) AS a, unnest([1, 2, 3]) AS i FROM r GROUP BY k) WHERE s[i] <> ''""")
def job_life_stream(spark, sf):
    d = spark.read.parquet(_life(spark, sf)).filter("kind = 'state'").groupBy("job").agg(F.max_by(F.struct("status", "attempts"), "epoch").alias("v"))
    return d.select("job", "v.status", "v.attempts").filter("status <> ''")


@plan("job_faults_stream", _LIFE_SQL + """ SELECT k || '-' || (j - 1) AS job, seq, action, outcome AS kind, before, k || '-' || (of - 1) AS of FROM r WHERE outcome <> 'applied'""")
def job_faults_stream(spark, sf):
    """Side output of the life cycle: duplicate submissions, illegal and ignored steps."""
    d = spark.read.parquet(_life(spark, sf)).filter("kind <> 'state'")
    d = d.groupBy("job", "seq").agg(F.max_by(F.struct("action", "kind", F.col("status").alias("before"), "of"), "epoch").alias("v"))
    return d.select("job", "seq", "v.*").filter("kind <> 'applied'")
