"""Polling loops as Structured Streaming queries.

A query keeps its position in the checkpoint, which replaces offset files and
"already seen" lists.  Sinks write one folder per batch and overwrite it on a
retry, so a batch that runs twice leaves the same data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import path_exists
from ..sources.files import FILE_SCHEMA


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop, as a timer-driven poll would."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(sink).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_epochs(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches written so far, none before the first."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key from the per-batch change folders."""
    d = spark.read.parquet(path)
    cols = [c for c in d.columns if c not in (*keys, "epoch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("_v")).select(*keys, "_v.*")


# -- files -------------------------------------------------------------------------

def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files of a folder as (name, sha256, content)."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def unseen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First sight of each key.  The keys live in the state store, partitioned
    and checkpointed with the query, so no batch reads what earlier ones wrote."""
    return stream.dropDuplicates(keys)


def accept_new(extract: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Sink for :func:`unseen` content: each row is extracted once; a row whose
    extraction gives null text goes to the retry table and is tried again with
    the next batch.

    ``out/accepted`` and ``out/retry`` hold one folder per batch; a batch reads
    the retry folder of the one before it and nothing else.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        again = read_epochs(spark, f"{out}/retry/epoch={epoch - 1}")
        rows = batch if again is None else batch.unionByName(again.select(*batch.columns))
        extract(rows).write.mode("overwrite").parquet(f"{out}/_work/epoch={epoch}")
        result = spark.read.parquet(f"{out}/_work/epoch={epoch}")
        result.filter("text is not null").drop("content").write.mode("overwrite").parquet(f"{out}/accepted/epoch={epoch}")
        result.filter("text is null").select(*batch.columns).write.mode("overwrite").parquet(f"{out}/retry/epoch={epoch}")
    return sink


# -- feeds and messages ----------------------------------------------------------------

def fresh_items(stream: DataFrame, keys: list[str], ts: str, horizon: str) -> DataFrame:
    """First sight of each item.  State older than the horizon is dropped, so it
    must exceed the time an item stays in its feed."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


# -- ledgers -----------------------------------------------------------------------------

def run_status(stream: DataFrame) -> DataFrame:
    """Observation log per run, in update mode; equal to the batch roll-up."""
    from ..operators.ledgers import run_summary
    return run_summary(stream)


def ceilings(stream: DataFrame) -> DataFrame:
    """Ratchet: the lowest count seen per gate."""
    return stream.groupBy("gate").agg(F.min("failures").alias("ceiling"))


def floors(stream: DataFrame) -> DataFrame:
    """Ratchet upwards: the highest floor set per batch."""
    return stream.groupBy("gate").agg(F.max("floor").alias("floor"))


#: Lists and timers in keyed state live in Spark's RocksDB store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RedChecks(StatefulProcessor):
    """State of one check: its newest green, its first red since, and a list of the reds after that green.

    Reds are appended; the list is only read when a green arrives, or once a
    lateness period to fold what is too old to be uncovered.  A timer stands at
    the first red plus ``days``.
    """

    def __init__(self, late_days: float, days: float):
        self.late, self.due_ms = int(late_days * 86_400_000_000), int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "green long, first long, folded long")
        self.reds = handle.getListState("reds", "ts long")

    def _row(self, check: str, kind: str, green: int | None, first: int | None) -> pd.DataFrame:
        at = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        return pd.DataFrame({"check": [check], "kind": [kind], "last_green": [at(green)], "first_red_at": [at(first)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        green, first, folded = self.known.get() if self.known.exists() else (None, None, None)
        new, greens = [], []
        for b in rows:
            ts, red = b.ts.to_numpy().astype("datetime64[us]").astype(np.int64), b.red.to_numpy(dtype=bool)
            new += ts[red].tolist()
            greens += ts[~red].tolist()
        before = first
        newest = max(greens, default=None)
        advanced = newest is not None and (green is None or newest > green)
        green = newest if advanced else green
        new = [t for t in new if green is None or t > green]
        folded = min(new, default=None) if folded is None else folded
        late = max(new, default=None)
        if advanced or late is not None and late - folded > self.late:
            reds = np.unique(np.array([r[0] for r in self.reds.get()] + new, np.int64))
            reds = reds if green is None else reds[reds > green]
            if len(reds):
                reds = np.union1d(reds[:1], reds[reds >= reds[-1] - self.late])
            self.reds.put([(int(t),) for t in reds]) if len(reds) else self.reds.clear()
            first, folded = (int(reds[0]), int(reds[-1])) if len(reds) else (None, None)
        elif new:
            self.reds.appendList([(t,) for t in new])
            first = min(new) if first is None else min(first, *new)
        self.known.update((green, first, folded))
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.due_ms)
            if first is not None:
                self.handle.registerTimer(first // 1000 + self.due_ms)
        yield self._row(key[0], "state", green, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        green, first, _ = self.known.get() if self.known.exists() else (None, None, None)
        if first is not None and first // 1000 + self.due_ms <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key[0], "overdue", green, first)

    def close(self) -> None:
        pass


def red_since(stream: DataFrame, late_days: float = 7, days: float = 1) -> DataFrame:
    """(check, kind, last_green, first_red_at) in update mode.

    ``stream(check string, ts timestamp, red boolean)``.  Rows of kind "state"
    follow each trigger in which a check reports; neither the order inside a
    trigger nor that of triggers matters: a check's state is its newest green and
    the reds after it, so a green that arrives late uncovers the red that follows
    it.  Reds older than ``late_days`` before the newest one fold into their
    first, which bounds the list of a check that stays red; a green later than
    that is taken as at the end of the folded stretch.

    A row of kind "overdue" comes from a timer once event time has passed the
    first red by ``days`` and no green has come: a check that falls silent while
    red is raised by the reports of others.  A stream without a watermark gets
    one of ``late_days``.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    timed = stream if stream._jdf.logicalPlan().toString().startswith("EventTimeWatermark") else stream.withWatermark("ts", f"{int(late_days * 86_400)} seconds")
    return timed.groupBy("check").transformWithStateInPandas(
        RedChecks(late_days, days), "check string, kind string, last_green timestamp, first_red_at timestamp", "Update", "EventTime")


def overdue(states: DataFrame, now: str, days: float = 1) -> DataFrame:
    """Checks that have been red for more than ``days`` at a given time, from their last states;
    the stream raises them by itself (:func:`red_since`)."""
    since = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("first_red_at")
    return states.filter(since > int(days * 86_400_000_000)).select("check", "first_red_at")


def item_states(stream: DataFrame) -> DataFrame:
    """Status of each item by replay of its event log, in update mode."""
    return stream.groupBy("item").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.count("*").alias("events"))


def changed(stream: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Rows with their settings key, once per content and settings."""
    from ..operators.changes import settings_key
    return unseen(settings_key(stream, settings), ["cache_key"])


def refresh_changed(compute: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """Sink for :func:`changed` rows: what is derived from them, a folder per batch."""
    def sink(batch: DataFrame, epoch: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return sink
