"""Keyed state with timers: a verdict for each request, redelivery of messages, lives of jobs.

The stateful forms are streams and need the RocksDB state store, which ``build_session`` sets.
Their state goes away by itself: by a timer on the event time, which the watermark drives, so that a
run that is stopped and started again takes up where it was. Each has a table form, which
says of a whole log what the stream says of it in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..session import importable
from .windows import LIMITS, watermarked

# The queue's time out of sight and greatest number of receipts; days that jobs of each kind are kept.
OUT_OF_SIGHT, RECEIPTS = 900, 3
KEEP_DAYS = {"extract": 30, "normalize": 30, "reapply": 7}
DEFAULT_DAYS = 30

# Instants go through Python as milliseconds, which no time zone shifts.
VERDICTS = "event_id long, client long, route_class string, ts timestamp, window_start long, place long, admitted boolean, left long"
DELIVERIES = "message_id long, kind string, attempt int, at long, body string"
LIVES = "job_id long, life int, status string, processed long, succeeded long, failed long, began long, ends long"


def _stateful(rows: DataFrame, key: str | list[str], processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    importable(rows.sparkSession)
    timed = watermarked(rows, late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def _instants(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({c: F.timestamp_millis(c) for c in names})


def _only_timer(handle, at: int | None) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at is not None:
        handle.registerTimer(at)


# -- requests ---------------------------------------------------------------------------------


def limit_of(route_class: Column, limits: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, n in limits.items():
        out = F.when(route_class == name, n).otherwise(out)
    return out


class _Verdicts(StatefulProcessor):
    """Requests of one client and class: a count for each fixed window that is still open."""

    def __init__(self, limits: dict[str, int], default: int, seconds: int):
        self.limits, self.default, self.width = limits, default, 1000 * seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        limit = self.limits.get(key[1], self.default)
        for frame in rows:
            frame = frame.sort_values(["ts", "event_id"], ignore_index=True)
            start = frame["ms"] // self.width * self.width
            before = {s: self.counts.getValue((s,))[0] if self.counts.containsKey((s,)) else 0 for s in start.unique().tolist()}
            place = frame.groupby(start).cumcount() + 1 + start.map(before)
            for s, n in place.groupby(start).max().items():
                self.counts.updateValue((int(s),), (int(n),))
                self.handle.registerTimer(int(s) + self.width)
            yield pd.DataFrame({"event_id": frame["event_id"], "client": key[0], "route_class": key[1], "ts": frame["ts"], "window_start": start, "place": place, "admitted": place <= limit, "left": (limit - place).clip(lower=0)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.removeKey((expiredTimerInfo.getExpiryTimeInMs() - self.width,))
        return iter(())

    def close(self) -> None:
        pass


def rate_verdicts(requests: DataFrame, limits: dict[str, int] = LIMITS, default: int = 100, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Each request of ``requests`` (event_id, client, route_class, ts) with its verdict.

    The first so many of a client and class in a fixed window are admitted, all others are
    not; ``left`` is how many more the window admits. As a stream requests count in the order they come, those of
    a batch by time and id, and a window's count goes when the watermark passes its end; as a
    table they count by time and id.
    """
    if requests.isStreaming:
        return _instants(_stateful(requests.select("event_id", "client", "route_class", "ts"), ["client", "route_class"], _Verdicts(limits, default, seconds), VERDICTS, late), "window_start")
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    at = Window.partitionBy("client", "route_class", "window_start").orderBy("ts", "event_id")
    limit = limit_of(F.col("route_class"), limits, default)
    placed = rows.withColumn("window_start", start).withColumn("place", F.row_number().over(at).cast("long"))
    return placed.select("event_id", "client", "route_class", "ts", "window_start", "place", (F.col("place") <= limit).alias("admitted"), F.greatest(limit - F.col("place"), F.lit(0)).cast("long").alias("left"))


# -- messages ---------------------------------------------------------------------------------


class _Deliveries(StatefulProcessor):
    """One message: how often it was received and until when it is out of sight."""

    def __init__(self, seconds: int, receipts: int):
        self.wait, self.receipts = 1000 * seconds, receipts

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("message", "attempt int, due long, body string")

    def _until(self, now: int, held: tuple | None) -> tuple[tuple | None, list[tuple]]:
        """What happens up to ``now`` without an answer."""
        out = []
        while held is not None and held[1] <= now:
            attempt, due, body = held
            if attempt >= self.receipts:
                out.append(("dead", attempt, due, body))
                held = None
            else:
                out.append(("delivery", attempt + 1, due, body))
                held = (attempt + 1, due + self.wait, body)
        return held, out

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], kind, attempt, at, body) for kind, attempt, at, body in found], columns=["message_id", "kind", "attempt", "at", "body"])

    def _keep(self, held: tuple | None) -> None:
        _only_timer(self.handle, held and held[1])
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, found = tuple(self.held.get()) if self.held.exists() else None, []
        log = pd.concat(rows).sort_values(["ms", "kind"], ascending=[True, False])  # of one time the message before its answer
        for kind, body, now in zip(log["kind"], log["body"], log["ms"].tolist(), strict=True):
            held, out = self._until(now, held)
            found += out
            if kind == "message" and held is None:
                held = (1, now + self.wait, body)
                found.append(("delivery", 1, now, body))
            elif kind == "done" and held is not None:
                held = None
        self._keep(held)
        if found:
            yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            held, found = self._until(timerValues.getCurrentWatermarkInMs(), tuple(self.held.get()))
            self._keep(held)
            if found:
                yield self._rows(key, found)

    def close(self) -> None:
        pass


def deliveries(log: DataFrame, seconds: int = OUT_OF_SIGHT, receipts: int = RECEIPTS, late: str = "0 seconds") -> DataFrame:
    """Streaming: what is handed out of a queue, and what goes to the dead letters.

    ``log`` has message_id, kind, ts and body: a ``message`` that was sent, or ``done`` when its
    work has ended well. A message is handed out at once, then out of sight for ``seconds``;
    what isn't done by then is handed out again, and dead after ``receipts`` times. Each message's count and
    time are state, so they outlive restarts, and are gone once it is done or dead. Time is that of the log: its
    watermark sets off what nobody answers, so a quiet queue wants a clock among its rows
    (any row of another id, such as kind ``tick``). A second message of an id that is under way is passed over.
    """
    return _instants(_stateful(log.select("message_id", "kind", F.col("body").cast("string").alias("body"), "ts"), "message_id", _Deliveries(seconds, receipts), DELIVERIES, late), "at")


def receipts_of(messages: DataFrame, now: Column, seconds: int = OUT_OF_SIGHT, receipts: int = RECEIPTS) -> DataFrame:
    """The table form: ``message_id, attempts, state`` of messages (message_id, sent, done) as of ``now``.

    ``done`` is when the work ended well, or null. State is done, dead or under way.
    """
    until = F.least(F.coalesce("done", now), now)
    waits = F.floor((F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))) / F.lit(1_000_000 * seconds))
    in_time = F.col("done").isNotNull() & (F.col("done") <= now) & (waits < receipts)
    state = F.when(in_time, "done").when(waits >= receipts, "dead").otherwise("under way")
    return messages.filter(F.col("sent") <= now).select("message_id", F.least(waits + 1, F.lit(receipts)).cast("int").alias("attempts"), state.alias("state"))


# -- jobs -------------------------------------------------------------------------------------


class _Lives(StatefulProcessor):
    """One job: its state from its first event until its time to live has passed."""

    def __init__(self, keep: dict[str, int], default: int):
        self.keep, self.default = keep, default

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "life int, status string, seq long, processed long, succeeded long, failed long, began long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        found = []
        log = pd.concat(rows).sort_values(["ms", "seq"])
        for kind, seq, status, now, succeeded, failed in zip(log["kind"], log["seq"].tolist(), log["status"], log["ms"].tolist(), log["succeeded"].tolist(), log["failed"].tolist(), strict=True):
            if held is None or now >= held[7]:
                if held is not None:
                    found.append(held)
                held = ((held or (0,))[0] + 1, "pending", -1, 0, 0, 0, now, now + 86_400_000 * self.keep.get(kind, self.default))
            life, last, last_seq, n, good, bad, began, ends = held
            held = (life, *((status, seq) if seq > last_seq else (last, last_seq)), n + 1, good + succeeded, bad + failed, began, ends)
        self.held.update(held)
        _only_timer(self.handle, held[7])
        found.append(held)
        yield self._rows(key, found)

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], life, status, n, good, bad, began, ends) for life, status, _, n, good, bad, began, ends in found], columns=["job_id", "life", "status", "processed", "succeeded", "failed", "began", "ends"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_lives(events: DataFrame, keep: dict[str, int] = KEEP_DAYS, default: int = DEFAULT_DAYS, late: str = "1 hour") -> DataFrame:
    """Streaming: the state of each job after each batch of its events (job_id, kind, seq, status, ts, succeeded, failed).

    A job lives so many days of its kind from its first event on. What comes later starts it
    anew, with counts from nothing; its state is gone when the watermark has passed its end, and
    ``life`` counts on only while it is remembered. A life that ended within a batch is given too.
    """
    return _instants(_stateful(events.select("job_id", "kind", "seq", "status", "ts", "succeeded", "failed"), "job_id", _Lives(keep, default), LIVES, late), "began", "ends")


def lives_of(events: DataFrame, keep: dict[str, int] = KEEP_DAYS, default: int = DEFAULT_DAYS) -> DataFrame:
    """The table form: every life of every job, ``job_id, life, status, processed, succeeded, failed, began, ends``.

    A job's events are dealt to one task and walked through in order; nothing but the current
    life is held, so that a job may have any number of events.
    """
    importable(events.sparkSession)
    days = F.lit(default)
    for kind, n in keep.items():
        days = F.when(F.col("kind") == kind, n).otherwise(days)
    rows = events.select("job_id", "seq", "status", (F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"), "succeeded", "failed", (days.cast("long") * 86_400_000).alias("keep"))
    dealt = rows.repartition("job_id").sortWithinPartitions("job_id", "at", "seq")
    columns = ["job_id", "life", "status", "processed", "succeeded", "failed", "began", "ends"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, life, held = None, 0, None
        for frame in frames:
            found = []
            for own, seq, status, at, good, bad, wait in frame.itertuples(index=False, name=None):
                if own != job or at >= held[6]:
                    if held is not None:
                        found.append((job, life, held[0], *held[2:7]))
                    life = 1 if own != job else life + 1
                    job, held = own, ("pending", -1, 0, 0, 0, at, at + wait)
                held = (*((status, seq) if seq > held[1] else held[:2]), held[2] + 1, held[3] + good, held[4] + bad, *held[5:])
            if found:
                yield pd.DataFrame(found, columns=columns)
        if held is not None:
            yield pd.DataFrame([(job, life, held[0], *held[2:7])], columns=columns)

    return _instants(dealt.mapInPandas(walk, LIVES), "began", "ends")
