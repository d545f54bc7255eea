"""Keyed state: streams against their table forms, across restarts, with clocks that the tests turn."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridspan.plans import fixtures
from gridspan.streaming import state

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 5, 1, 12, 0, 0)


class Stream:
    """A folder of files as a stream that runs to its end, stops, and goes on from its checkpoint."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.place, self.schema, self.make = spark, tmp_path, schema, make
        (tmp_path / "in").mkdir()

    def run(self, *batches):
        """Each batch is a file and a micro-batch of its own, in order; the rows that came out of this run."""
        for rows in batches:
            df = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
            df.coalesce(1).write.mode("append").parquet(str(self.place / "in"))
        before = self.seen() if (self.place / "out").exists() else []
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(self.place / "in"))
        query = self.make(stream).writeStream.format("parquet").option("path", str(self.place / "out")).option("checkpointLocation", str(self.place / "checkpoint")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
        after = self.seen()
        for row in before:
            after.remove(row)
        return after

    def seen(self):
        return [tuple(r) for r in self.spark.read.parquet(str(self.place / "out")).collect()]


# -- verdicts ---------------------------------------------------------------------------------


def test_verdicts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Files in order of time: every request gets the verdict that the table form gives."""
    rows = fixtures.requests(spark, SF).select("event_id", "client", "route_class", "ts")
    limits, schema = {"view": 3, "click": 2}, rows.schema
    days = sorted(r[0] for r in rows.select(F.to_date("ts")).distinct().collect())
    parts = [rows.filter(F.to_date("ts").between(a, b)) for a, b in ((days[0], days[9]), (days[10], days[20]), (days[21], days[-1]))]
    stream = Stream(spark, tmp_path, schema, lambda d: state.rate_verdicts(d, limits, 1, 86_400))
    got = stream.run(parts[0]) + stream.run(*parts[1:])
    want = [tuple(r) for r in state.rate_verdicts(rows, limits, 1, 86_400).collect()]
    assert sorted(got) == sorted(want) and {r[6] for r in want} == {True, False}


def test_a_window_counts_over_batches_and_restarts(spark, tmp_path):
    schema = "event_id long, client long, route_class string, ts timestamp"
    at = lambda i, s, c="write": (i, 1, c, T0 + timedelta(seconds=s))
    stream = Stream(spark, tmp_path, schema, lambda d: state.rate_verdicts(d, {"write": 3}, 100, 60))
    first = stream.run([at(1, 0), at(2, 10)], [at(3, 20), at(4, 30), at(5, 30, "other")])
    assert {r[0]: (r[5], r[6], r[7]) for r in first} == {1: (1, True, 2), 2: (2, True, 1), 3: (3, True, 0), 4: (4, False, 0), 5: (1, True, 99)}
    second = stream.run([at(6, 59), at(7, 60)], [at(8, 119)])
    assert {r[0]: (r[5], r[6]) for r in second} == {6: (5, False), 7: (1, True), 8: (2, True)}


def test_counts_go_with_their_windows(spark, tmp_path):
    """Once the watermark has passed a window its count is gone; rows of state stay as few as open windows."""
    schema = "event_id long, client long, route_class string, ts timestamp"
    seen = []
    stream = Stream(spark, tmp_path, schema, lambda d: state.rate_verdicts(d, {"write": 3}, 100, 60))
    for k in range(5):
        stream.run([(k * 10 + i, i, "write", T0 + timedelta(minutes=10 * k, seconds=i)) for i in range(4)], [(k * 10 + 9, 0, "write", T0 + timedelta(minutes=10 * k + 5))])
    held = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "counts").load()
    seen = held.count()
    assert seen <= 5


# -- redelivery -------------------------------------------------------------------------------

LOG = "message_id long, kind string, ts timestamp, body string"


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_messages_come_back_until_they_are_dead(spark, tmp_path):
    """The stream is stopped between all attempts: counts and times live in its state."""
    stream = Stream(spark, tmp_path, LOG, state.deliveries)
    tick = lambda n: [(-1, "tick", minutes(n), None)]
    out = stream.run([(1, "message", minutes(0), "a"), (2, "message", minutes(1), "b"), (3, "message", minutes(2), "c")])
    assert sorted(out) == [(1, "delivery", 1, minutes(0), "a"), (2, "delivery", 1, minutes(1), "b"), (3, "delivery", 1, minutes(2), "c")]
    assert stream.run([(2, "done", minutes(10), None), *tick(14)]) == []
    # 1 is due at 15, 3 at 17; a batch sees the watermark of the one before
    assert sorted(stream.run(tick(16), tick(16))) == [(1, "delivery", 2, minutes(15), "a")]
    assert sorted(stream.run([(1, "message", minutes(16), "again"), *tick(20)], tick(20))) == [(3, "delivery", 2, minutes(17), "c")]
    assert sorted(stream.run([(3, "done", minutes(21), None), *tick(31)], tick(31))) == [(1, "delivery", 3, minutes(30), "a")]
    assert sorted(stream.run(tick(46), tick(46))) == [(1, "dead", 3, minutes(45), "a")]
    assert stream.run(tick(500), tick(500), tick(501)) == []
    assert sorted(stream.run([(1, "message", minutes(502), "new")])) == [(1, "delivery", 1, minutes(502), "new")]


def test_an_answer_in_one_batch_with_what_came_before(spark, tmp_path):
    """All of a log in one batch: what was due before an answer is handed out first; an answer after the last is too late."""
    stream = Stream(spark, tmp_path, LOG, state.deliveries)
    log = [(1, "message", minutes(0), "a"), (1, "done", minutes(31), None), (2, "message", minutes(0), "b"), (2, "done", minutes(50), None), (3, "done", minutes(0), None), (3, "message", minutes(0), "c")]
    assert sorted(stream.run(log)) == [(1, "delivery", 1, minutes(0), "a"), (1, "delivery", 2, minutes(15), "a"), (1, "delivery", 3, minutes(30), "a"), (2, "dead", 3, minutes(45), "b"), (2, "delivery", 1, minutes(0), "b"), (2, "delivery", 2, minutes(15), "b"), (2, "delivery", 3, minutes(30), "b"), (3, "delivery", 1, minutes(0), "c")]


def test_deliveries_agree_with_the_table_form(spark, tmp_path):
    """Attempts and ends of the test messages, their log in many batches, against the closed form."""
    messages = fixtures.queue_messages(spark, SF).withColumn("message_id", F.col("message_id"))
    now = messages.agg(F.max("sent")).first()[0] + timedelta(days=1)
    log = messages.select("message_id", F.lit("message").alias("kind"), F.col("sent").alias("ts"), F.lit("x").alias("body")).unionByName(messages.filter("done IS NOT NULL").select("message_id", F.lit("done").alias("kind"), F.col("done").alias("ts"), F.lit(None).cast("string").alias("body")))
    edge = messages.agg(F.percentile_approx(F.unix_seconds("sent"), 0.5)).first()[0]
    parts = [log.filter(F.unix_seconds("ts") <= edge), log.filter(F.unix_seconds("ts") > edge), spark.createDataFrame([(-1, "tick", now, None)], LOG), spark.createDataFrame([(-1, "tick", now, None)], LOG)]
    out = Stream(spark, tmp_path, log.schema, state.deliveries).run(*parts)
    want = {r.message_id: (r.attempts, r.state) for r in state.receipts_of(messages, F.lit(now)).collect()}
    got = {}
    for i, kind, attempt, _, _ in out:
        held = got.get(i, (0, "done"))
        got[i] = (max(held[0], attempt), "dead" if kind == "dead" or held[1] == "dead" else "done")
    assert got == want and {s for _, s in want.values()} == {"done", "dead"}


# -- lives of jobs ----------------------------------------------------------------------------

JOBS = "job_id long, kind string, seq long, status string, ts timestamp, succeeded int, failed int"


def event(job, seq, day, status="processing", good=0, kind="reapply"):
    return (job, kind, seq, status, T0 + timedelta(days=day), good, 0)


def test_an_expired_job_starts_anew(spark, tmp_path):
    stream = Stream(spark, tmp_path, JOBS, state.job_lives)
    out = stream.run([event(1, 1, 0, "pending"), event(1, 2, 1, good=3), event(2, 1, 0, kind="extract")])
    assert sorted(r[:4] for r in out) == [(1, 1, "processing", 2), (2, 1, "processing", 1)]
    out = stream.run([event(1, 3, 6.9, "completed", 2)])
    assert [r[:5] for r in out] == [(1, 1, "completed", 3, 5)]
    # day 7 ends the first life, even if the timer has not gone off; the job of 30 days lives on
    out = stream.run([event(1, 4, 7, "pending", 1), event(2, 2, 29, "completed")])
    assert sorted(r[:5] for r in out) == [(1, 1, "completed", 3, 5), (1, 2, "pending", 1, 1), (2, 1, "completed", 2, 0)]
    # the clock goes far on: state is gone, so that the next life is the first that is remembered
    stream.run([event(9, 1, 60)], [event(9, 2, 60)])
    out = stream.run([event(1, 5, 61, "pending"), event(2, 3, 61, "pending")])
    assert sorted(r[:4] for r in out) == [(1, 1, "pending", 1), (2, 1, "pending", 1)]


@pytest.mark.parametrize("frame", [10_000, 3])
def test_lives_of_a_table(spark, frame):
    """Jobs walked through in batches of any size, against a plain walk."""
    rows = fixtures.job_events(spark, SF).withColumn("kind", F.when(F.col("job_id") % 2 == 0, "reapply").otherwise("extract"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(frame))
    try:
        got = sorted((r.job_id, r.life, r.status, r.processed, r.succeeded, r.failed) for r in state.lives_of(rows).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.seq)):
        old = held.get(r.job_id)
        if old is None or r.ts.replace(microsecond=r.ts.microsecond // 1000 * 1000) >= old["ends"]:
            if old:
                want.append(old)
            began = r.ts.replace(microsecond=r.ts.microsecond // 1000 * 1000)
            old = held[r.job_id] = {"job": r.job_id, "life": old["life"] + 1 if old else 1, "seq": -1, "n": 0, "good": 0, "bad": 0, "ends": began + timedelta(days=7 if r.kind == "reapply" else 30)}
        if r.seq > old["seq"]:
            old["seq"], old["status"] = r.seq, r.status
        old["n"], old["good"], old["bad"] = old["n"] + 1, old["good"] + r.succeeded, old["bad"] + r.failed
    want += held.values()
    assert got == sorted((w["job"], w["life"], w["status"], w["n"], w["good"], w["bad"]) for w in want) and max(g[1] for g in got) > 2
