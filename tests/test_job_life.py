"""The life of jobs: the stream against a plain replay of the log, in any order of arrival."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from folioscope.session import shared_dir
from folioscope.streaming import job_life as life
from folioscope.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
LOG = "fingerprint string, job string, ts timestamp, seq long, action string"


def run(spark, root, batches, initial=None, late_days=7.0):
    """One file, one trigger for each batch; the newest row of each job and event."""
    folder, out = f"{root}/in-{uuid.uuid4().hex}", f"{root}/out-{uuid.uuid4().hex}"
    cp = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    first = None if initial is None else spark.createDataFrame(initial, "fingerprint string, job string, status string, attempts long, ts timestamp, seq long")
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
        log = spark.readStream.schema(LOG).parquet(folder)
        jobs.run_available(life.job_life(log, first, late_days), jobs.batch_writer(out), cp, "update")
    d = spark.read.parquet(out)
    states = d.filter("kind = 'state'").groupBy("job").agg(F.max_by(F.struct("status", "attempts"), "epoch").alias("v")).collect()
    side = d.filter("kind <> 'state'").groupBy("job", "seq").agg(F.max_by(F.struct("kind", "status", "of"), "epoch").alias("v")).collect()
    return ({r["job"]: tuple(r["v"]) for r in states if r["v"]["status"]}, {(r["job"], r["seq"]): tuple(r["v"]) for r in side if r["v"]["kind"] != "applied"})


def plain(rows):
    """A replay in the order of the log, written out as the queue states it."""
    status, attempts, born, side = {}, {}, {}, {}
    for fp, job, ts, seq, action in sorted(rows, key=lambda r: (r[2], r[3])):
        was = status.get(job, "")
        group = [j for j in status if (j.split("/")[0]) == job.split("/")[0]]
        if action == "submit":
            live = sorted((born[j], j) for j in group if status[j] in ("queued", "running", "stopping", "completed"))
            if live:
                side[job, seq] = ("duplicate", was, live[0][1])
            elif was:
                side[job, seq] = ("illegal", was, None)
            else:
                status[job], attempts[job], born[job] = "queued", 0, (ts, seq)
        elif action == "start" and was == "queued":
            status[job], attempts[job] = "running", attempts[job] + 1
        elif action in ("complete", "fail") and was in ("running", "stopping"):
            status[job] = "cancelled" if was == "stopping" else {"complete": "completed", "fail": "failed"}[action]
        elif action == "block" and was in ("running", "stopping"):
            status[job] = "blocked"
        elif action == "cancel" and was in ("queued", "running", "stopping"):
            status[job] = "cancelled" if was == "queued" else "stopping"
        elif action == "retry" and was in ("failed", "blocked", "cancelled"):
            status[job] = "queued"
        elif action == "recover" and was in ("running", "stopping", "blocked"):
            status[job] = {"running": "queued", "stopping": "cancelled", "blocked": "failed"}[was]
        else:
            side[job, seq] = ("ignored" if was and action in ("cancel", "recover") else "illegal", was, None)
    return {j: (status[j], attempts[j]) for j in status}, side


def log_of(rnd, n, minutes=1.0):
    actions = ["submit"] * 3 + ["start"] * 4 + ["complete", "fail", "fail", "block", "cancel", "retry", "retry", "recover"]
    rows = []
    for i in range(n):
        fp = rnd.choice(["hot", "hot", "a", "b"])
        rows.append((fp, f"{fp}/{rnd.randint(0, 2)}", T0 + dt.timedelta(minutes=minutes * (i // 2)), i, rnd.choice(actions)))
    return rows


def test_any_order_of_arrival_gives_the_replay(spark, tmp_path):
    rnd = random.Random(5)
    rows = log_of(rnd, 120)
    want = plain(rows)
    assert len(want[0]) > 4 and {v[0] for v in want[1].values()} == {"duplicate", "illegal", "ignored"}
    assert run(spark, tmp_path, [rows]) == want
    mixed = rows[:]
    rnd.shuffle(mixed)
    # three triggers in no order, some rows twice
    assert run(spark, tmp_path, [mixed[:50], mixed[50:90] + mixed[:5], mixed[90:]]) == want


def test_the_fold_keeps_what_it_stands_for(spark, tmp_path):
    rows = log_of(random.Random(8), 120, minutes=240)
    third = len(rows) // 3
    parts = [rows[:third], rows[third:2 * third], rows[2 * third:]]
    # older than the fold: told, not applied
    old = ("hot", "hot/9", T0 - dt.timedelta(days=1), 999, "submit")
    states, side = run(spark, tmp_path, [*parts, [old]], late_days=0.5)
    want, faults = plain(rows)
    assert states == want and side == {**faults, ("hot/9", 999): ("late", None, None)}


def test_initial_jobs_and_missing_fields(spark, tmp_path):
    start = [("f", "f/1", "running", 2, T0, 1), ("g", "g/1", "failed", 1, T0, 2)]
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("f", "f/2", at(1), 10, "submit"), ("f", "f/1", at(2), 11, "cancel"), ("f", "f/1", at(3), 12, "complete"), ("g", "g/1", at(1), 13, "retry"),
            ("g", "g/1", at(2), 14, "start"), (None, "solo", at(1), 15, "submit"), (None, "solo", at(2), 16, "odd"), ("f", None, at(1), 17, "submit"), ("f", "f/3", None, 18, "submit")]
    states, side = run(spark, tmp_path, [rows], start)
    assert states == {"f/1": ("cancelled", 2), "g/1": ("running", 2), "solo": ("queued", 0)}
    assert side == {("f/2", 10): ("duplicate", "", "f/1"), ("solo", 16): ("illegal", "queued", None)}
