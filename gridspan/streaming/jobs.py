"""Jobs as logs of status events: current state, progress, single flight, expiry, dead letters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import importable

TERMINAL = ("completed", "failed", "deleted")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"), F.count(F.lit(1)).alias("n_events"))


def progress(events: DataFrame) -> DataFrame:
    """Running counts of each job, event by event."""
    so_far = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("job_id", "seq", F.count(F.lit(1)).over(so_far).alias("processed"), F.sum("succeeded").over(so_far).alias("succeeded"), F.sum("failed").over(so_far).alias("failed"))


def may_start(requested: DataFrame, events: DataFrame) -> DataFrame:
    """Requests of jobs that aren't running: the single-flight guard."""
    running = latest(events).filter(~F.col("status").isin(*TERMINAL)).select("job_id")
    return requested.join(running, "job_id", "left_anti")


def unexpired(rows: DataFrame, now: int) -> DataFrame:
    """Rows whose time to live, an epoch second, hasn't passed; without one they stay."""
    return rows.filter(F.col("ttl").isNull() | (F.col("ttl") > now))


def append_result(jobs: DataFrame, job_id: str, result) -> DataFrame:
    """Adds to the list of results of one job and no other."""
    return jobs.withColumn("results", F.when(F.col("job_id") == job_id, F.array_append(F.coalesce("results", F.array().cast("array<string>")), result)).otherwise(F.col("results")))


def running(events: DataFrame) -> DataFrame:
    """The current state of jobs that haven't ended."""
    return latest(events).filter(~F.col("status").isin(*TERMINAL))


def archived(events: DataFrame) -> DataFrame:
    """The last state of jobs that have ended: what is archived and removed from the running ones, by one more event."""
    return latest(events).filter(F.col("status").isin(*TERMINAL))


def status_of(events: DataFrame, job_id) -> DataFrame:
    """A job's state: the running one if there is one, else the archived one; no row if it was deleted or never was."""
    return latest(events.filter(F.col("job_id") == job_id)).filter("status <> 'deleted'")


def delete_jobs(events: DataFrame, gone: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with a ``deleted`` one for each job of ``gone`` that there is, the files of those jobs to be removed).

    ``files`` has job_id and path. Jobs that are deleted already, or unknown, stay as they are.
    """
    there = latest(events).filter("status <> 'deleted'").join(gone.select("job_id"), "job_id", "left_semi")
    ends = there.select("job_id", (F.col("seq") + 1).alias("seq"), F.lit("deleted").alias("status"), "ts")
    return events.unionByName(ends, allowMissingColumns=True), files.join(there.select("job_id"), "job_id", "left_semi")


STATE = "status string, seq long, processed long, succeeded long, failed long"


def live_state(events: DataFrame, keep: str = "30 days") -> DataFrame:
    """Streaming: the state of each job after each batch of its events; jobs are forgotten after ``keep`` without one.

    The time is wall time, for which Spark runs batches without data. A run with ``availableNow``
    ends only where ``spark.sql.streaming.noDataMicroBatches.enabled`` is false.
    """
    importable(events.sparkSession)
    ms = int(keep.split()[0]) * 86_400_000

    def step(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        status, last, processed, succeeded, failed = state.get if state.exists else ("pending", -1, 0, 0, 0)
        for frame in frames:
            top = frame["seq"].idxmax()
            if frame["seq"][top] > last:  # as in latest(): the event of the highest number counts
                status, last = frame["status"][top], int(frame["seq"][top])
            processed, succeeded, failed = processed + len(frame), succeeded + int(frame["succeeded"].sum()), failed + int(frame["failed"].sum())
        state.update((status, last, processed, succeeded, failed))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame([(key[0], status, processed, succeeded, failed)], columns=["job_id", "status", "processed", "succeeded", "failed"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, processed long, succeeded long, failed long", STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_queue(messages: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, dead: str, checkpoint: str, attempts: int = 3):
    """Streaming: valid messages go through ``work`` to ``done``, others to ``dead``.

    ``work`` may give a column ``error``: messages with one are tried again, ``attempts``
    times in all, and are dead then, with the error and the number of attempts. What has an
    error harms no other message. The checkpoint is what redelivers after a crash; each
    attempt of a batch is a folder that is overwritten.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.filter(~F.col("ok")).withColumns({"error": F.lit("unreadable"), "attempts": F.lit(0)}).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}/attempt=0")
        left = rows.filter("ok")
        for k in range(1, attempts + 1):
            result = work(left)
            if "error" not in result.columns:
                result = result.withColumn("error", F.lit(None).cast("string"))
            tried = f"{checkpoint}-tried/batch={batch_id}/attempt={k}"
            result.write.mode("overwrite").parquet(tried)
            result = spark.read.schema(result.schema).parquet(tried)
            result.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{done}/batch={batch_id}/attempt={k}")
            bad = result.filter("error IS NOT NULL")
            if bad.isEmpty():
                break
            left = bad.select(*rows.columns)
            if k == attempts:
                bad.withColumn("attempts", F.lit(k)).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}/attempt={k}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class TimedCache:
    """Persisted DataFrames by key for some seconds; keys are dropped by prefix when their table changes."""

    def __init__(self, spark: SparkSession, seconds: float, clock: Callable[[], float]):
        self.spark, self.seconds, self.clock = spark, seconds, clock
        self.held: dict[str, tuple[DataFrame, float]] = {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.held.get(key)
        if found and self.clock() - found[1] < self.seconds:
            return found[0]
        if found:
            found[0].unpersist()
        frame = make().persist()
        self.held[key] = (frame, self.clock())
        return frame

    def drop(self, prefix: str = "") -> int:
        gone = [k for k in self.held if k.startswith(prefix)]
        for k in gone:
            self.held.pop(k)[0].unpersist()
        return len(gone)
