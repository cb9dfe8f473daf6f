"""Processing jobs: a keyed state machine over a stream of events, and its batch twin.

Events: job_id, seq, event, step, detail. States go queued, running, then succeeded or failed; a
terminal state stays. A step is upserted by name, and keeps its first start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What each event makes of a job.
STATUS = {"created": "queued", "running": "running", "step": "running", "succeeded": "succeeded", "failed": "failed"}
TERMINAL = ("succeeded", "failed")
OUT = "job_id string, status string, last_seq long, steps int"


class JobTracker(StatefulProcessor):
    """Last status of a job and the steps it has had; late and repeated events (by seq) change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "status string, last_seq long")
        self.steps = handle.getMapState("steps", "name string", "first_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.job.get() if self.job.exists() else ("queued", -1)
        events = pd.concat(list(rows)).sort_values("seq")
        for e in events.itertuples():
            if e.seq <= last or status in TERMINAL:
                continue
            status, last = STATUS.get(e.event, status), e.seq
            if e.event == "step" and not self.steps.containsKey((e.step,)):
                self.steps.updateValue((e.step,), (int(e.seq),))
        self.job.update((status, int(last)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "last_seq": [int(last)], "steps": [sum(1 for _ in self.steps.keys())]})

    def close(self) -> None:
        pass


def track(events: DataFrame) -> DataFrame:
    """The running state of each job, updated with every micro-batch."""
    return events.groupBy("job_id").transformWithStateInPandas(JobTracker(), OUT, "Update", "None")


class PatientTracker(JobTracker):
    """A tracker that fails a job once the watermark is past its last event by ``patience`` and it hasn't ended. A later event doesn't revive it."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for out in super().handleInputRows(key, iter([batch]), timerValues):
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if out.status[0] not in TERMINAL:
                self.handle.registerTimer(int(batch.ms.max()) + self.patience_ms)
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self.job.get()
        if status not in TERMINAL:
            self.job.update(("failed", last))
            yield pd.DataFrame({"job_id": [key[0]], "status": ["failed"], "last_seq": [int(last)], "steps": [sum(1 for _ in self.steps.keys())]})


def track_patiently(events: DataFrame, patience_seconds: int, late: str = "0 seconds") -> DataFrame:
    """``track`` over events with ts (timestamp), where a job without an event for ``patience_seconds`` of event time fails, by a timer of its key."""
    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(PatientTracker(1000 * patience_seconds), OUT, "Update", "EventTime")


def latest_patiently(events: DataFrame, patience_seconds: int) -> DataFrame:
    """The same over a finished table whose latest event is as far as time has come: jobs that were left waiting are failed."""
    now = events.agg(F.max("ts").alias("now"))
    seen = events.groupBy("job_id").agg(F.max("ts").alias("ts"))
    out = latest(events).join(seen, "job_id").join(F.broadcast(now))
    stuck = ~F.col("status").isin(*TERMINAL) & (F.col("ts") + F.make_interval(secs=F.lit(patience_seconds)) <= F.col("now"))
    return out.select("job_id", F.when(stuck, "failed").otherwise(F.col("status")).alias("status"), "last_seq", "steps")


def running_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job_id, status, last_seq as of the last finished batch of the stream with this checkpoint, read from its state store, whether the stream runs or not."""
    state = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
    return state.select("key.job_id", "value.status", "value.last_seq")


def job_steps(spark: SparkSession, checkpoint: str) -> DataFrame:
    """job_id, step, first_seq: the steps that each job has had, from the same state."""
    state = spark.read.format("statestore").option("stateVarName", "steps").load(checkpoint)
    return state.select("key.job_id", F.col("user_map_key.name").alias("step"), F.col("user_map_value.first_seq").alias("first_seq"))


def latest(events: DataFrame) -> DataFrame:
    """The same over a finished table: the state after the first terminal event, or after the last event."""
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    rows = events.dropDuplicates(["job_id", "seq"]).withColumn("status", F.try_element_at(known, F.col("event")))
    w = Window.partitionBy("job_id")
    end = F.min(F.when(F.col("status").isin(*TERMINAL), F.col("seq"))).over(w)
    live = rows.withColumn("end", end).where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    return live.groupBy("job_id").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"), F.max("seq").alias("last_seq"), F.count_distinct(F.when(F.col("event") == "step", F.col("step"))).cast("int").alias("steps"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows of event time (an extension: the jobs need no windows)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
