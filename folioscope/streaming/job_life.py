"""The life of jobs as one stateful stream: attempts, cancels, retries, duplicate
submissions, and what the life cycle does not allow as a side output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import STATE_STORE

# What each action makes of a job.  "stopping" is a running job that was asked to
# cancel, "blocked" a failed one whose processes may still run.
STEPS = {
    "start": {"queued": "running"},
    "complete": {"running": "completed", "stopping": "cancelled"},
    "fail": {"running": "failed", "stopping": "cancelled"},
    "block": {"running": "blocked", "stopping": "blocked"},
    "cancel": {"queued": "cancelled", "running": "stopping", "stopping": "stopping"},
    "retry": {"failed": "queued", "blocked": "queued", "cancelled": "queued"},
    "recover": {"running": "queued", "stopping": "cancelled", "blocked": "failed"},
}
#: A job in one of these keeps others of its fingerprint out.
LIVE = ("queued", "running", "stopping", "completed")
#: Asked of a job they do not fit, these change nothing and are no fault.
HARMLESS = ("cancel", "recover")

COLUMNS = {"kind": "string", "job": "string", "ts": "timestamp", "seq": "long", "action": "string", "status": "string", "attempts": "long", "of": "string"}
_STATE = "status string, attempts long, ts long, seq long"
_TAIL = "ts long, seq long, job string, action string, outcome string, status string, of string"


def step(jobs: dict[str, tuple], ts: int, seq: int, job: str, action: str) -> tuple[str, str, str | None]:
    """Apply one event to ``jobs`` (job: status, attempts, submitted ts and seq).

    Returns the outcome, the status the job had before, and for a duplicate the
    live job that was submitted first.
    """
    before, attempts, *born = jobs.get(job, ("", 0, ts, seq))
    if action == "submit":
        live = [(v[2], v[3], j) for j, v in jobs.items() if v[0] in LIVE]
        if live:
            return "duplicate", before, min(live)[2]
        if before:
            return "illegal", before, None
        jobs[job] = ("queued", 0, ts, seq)
        return "applied", before, None
    after = STEPS.get(action, {}).get(before)
    if after is None:
        return "ignored" if before and action in HARMLESS else "illegal", before, None
    jobs[job] = (after, attempts + (action == "start"), *born)
    return "applied", before, None


class JobLife(StatefulProcessor):
    """State of one fingerprint: its jobs now, its jobs at the fold, and the events after the fold.

    Events in order touch the map of present states and are appended to the
    list.  One that arrives late replays the list from the fold.  Once the list
    spans twice the lateness, its older half goes into the fold, so neither a
    busy fingerprint nor a long run lets it grow without end.
    """

    def __init__(self, late_days: float):
        self.late = int(late_days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getMapState("now", "job string", _STATE)
        self.base = handle.getMapState("base", "job string", _STATE)
        self.tail = handle.getListState("tail", _TAIL)
        # where the fold ends, and the first and last event of the list
        self.marks = handle.getValueState("marks", "fold_ts long, fold_seq long, first_ts long, last_ts long, last_seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            value = (r.status, int(r.attempts), int(pd.Timestamp(r.ts).value // 1000), int(r.seq))
            self.now.updateValue((r.job,), value)
            self.base.updateValue((r.job,), value)

    @staticmethod
    def _load(state) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in state.iterator()}

    @staticmethod
    def _save(state, old: dict, new: dict) -> None:
        for job in old.keys() - new.keys():
            state.removeKey((job,))
        for job, value in new.items():
            if old.get(job) != value:
                state.updateValue((job,), value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = []
        for b in rows:
            us = b.ts.to_numpy().astype("datetime64[us]").astype(np.int64).tolist()
            given += zip(us, b.seq.tolist(), b.job.tolist(), b.action.tolist())
        given.sort(key=lambda e: (e[0], e[1], str(e[2]), str(e[3])))
        fold_ts, fold_seq, first, last_ts, last_seq = self.marks.get() if self.marks.exists() else (None,) * 5
        fold = None if fold_ts is None else (fold_ts, fold_seq)
        last = fold if last_ts is None else (last_ts, last_seq)
        # one event for each place in the log; the fold is final
        new: list[tuple] = []
        out: list[tuple] = []
        for e in given:
            if fold is not None and e[:2] <= fold:
                if e[:2] < fold:
                    out.append(("late", e[2], e[0], e[1], e[3], None, None, None))
            elif not new or new[-1][:2] != e[:2]:
                new.append(e)
        if new:
            before = self._load(self.now)
            told: dict[tuple, tuple] = {}
            if last is None or new[0][:2] > last:
                jobs, kept, events = dict(before), [], new
            else:
                kept_rows = [tuple(r) for r in self.tail.get()]
                told = {r[:2]: r[4:] for r in kept_rows}
                jobs, kept = self._load(self.base), None
                events = sorted([r[:4] for r in kept_rows] + [e for e in new if e[:2] not in told], key=lambda e: e[:2])
            done = []
            for e in events:
                outcome, was, of = step(jobs, *e)
                done.append((*e, outcome, was, of))
                if told.get(e[:2]) != (outcome, was, of) and (outcome != "applied" or e[:2] in told):
                    out.append((outcome, e[2], e[0], e[1], e[3], was, None, of))
            if kept is None:
                self.tail.put(done)
                first = done[0][0]
            else:
                self.tail.appendList(done)
                first = done[0][0] if first is None else first
            last = done[-1][:2]
            self._save(self.now, before, jobs)
            for job in jobs.keys() | before.keys():
                if jobs.get(job) != before.get(job):
                    status, attempts, ts, seq = jobs.get(job, ("", 0, None, None))
                    out.append(("state", job, ts, seq, None, status, attempts, None))
            if last[0] - first > 2 * self.late:
                events = [tuple(r) for r in self.tail.get()]
                old = self._load(self.base)
                jobs, cut = dict(old), last[0] - self.late
                gone = [e for e in events if e[0] < cut]
                for e in gone:
                    step(jobs, *e[:4])
                self._save(self.base, old, jobs)
                events = events[len(gone):]
                self.tail.put(events)
                fold, first = gone[-1][:2], events[0][0]
            self.marks.update((*(fold or (None, None)), first, *last))
        if out:
            d = pd.DataFrame(out, columns=list(COLUMNS)).astype({"seq": "Int64", "attempts": "Int64"})
            d["ts"] = pd.to_datetime(d["ts"].astype("Int64"), unit="us")
            d.insert(0, "key", key[0])
            yield d

    def close(self) -> None:
        pass


def job_life(events: DataFrame, initial: DataFrame | None = None, late_days: float = 7) -> DataFrame:
    """(key, kind, job, ts, seq, action, status, attempts, of) in update mode.

    ``events(fingerprint, job, ts, seq, action)``: the log of a queue; the key of
    a job is its fingerprint, or the job itself where that is null.  ``initial``
    (fingerprint, job, status, attempts, ts, seq) holds the jobs of an earlier
    run with the place of their submission.

    Rows of kind "state" give a job's status and attempts whenever a trigger
    changes them, with the place of its submission; an empty status takes back
    a job that a late event made a duplicate.  The other kinds are the side
    output: "duplicate" (submitted while the live job ``of`` had the fingerprint),
    "illegal", "ignored" (a cancel or a recovery that changes nothing) with the
    status before, and "late" (older than the fold, not applied).  An event
    whose outcome a later trigger changes is told again, as "applied" where it
    turns out to fit; the newest row of (job, seq) counts.

    Inside ``late_days`` neither the order of triggers nor that inside a trigger
    matters; a repeated place (ts, seq) of a fingerprint counts once.  Events
    with a null ts, seq, job or action have no place in the log and are left out.
    """
    spark = events.sparkSession
    spark.conf.set(*STATE_STORE)
    key = F.coalesce("fingerprint", "job").alias("key")
    d = events.filter("ts is not null and seq is not null and job is not null and action is not null").select(
        key, "job", "ts", F.col("seq").cast("long").alias("seq"), "action")
    start = None if initial is None else initial.select(key, "job", "status", "attempts", "ts", "seq").groupBy("key")
    schema = "key string, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return d.groupBy("key").transformWithStateInPandas(JobLife(late_days), schema, "Update", "None", start)

