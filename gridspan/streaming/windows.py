"""Event-time operators. Each works on a streaming DataFrame and, unchanged, on a batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests a minute by class of route.
LIMITS = {"general": 100, "search": 30, "write": 20}


def watermarked(events: DataFrame, late: str | None, ts: str = "ts") -> DataFrame:
    """A watermark needs an instant, so times without a zone are cast first."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def rate_windows(requests: DataFrame, limits: dict[str, int] = LIMITS, default: int = 100, length: str = "1 minute", late: str | None = None) -> DataFrame:
    """Requests of each client and class per fixed window, and how many were over the limit."""
    limit = F.lit(default)
    for name, n in limits.items():
        limit = F.when(F.col("route_class") == name, n).otherwise(limit)
    counts = watermarked(requests, late).groupBy(F.window("ts", length).alias("w"), "client", "route_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "client", "route_class", "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("rejected"))


def tumbling(events: DataFrame, length: str, by: list[str], late: str | None = None) -> DataFrame:
    return _counted(watermarked(events, late).groupBy(F.window("ts", length).alias("w"), *by), by)


def sliding(events: DataFrame, length: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    return _counted(watermarked(events, late).groupBy(F.window("ts", length, step).alias("w"), *by), by)


def sessions(events: DataFrame, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    return _counted(watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), *by), by)


def _counted(grouped, by: list[str]) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One event per key: as a stream the first to come while the watermark remembers it, as a table the first by ``order``."""
    if events.isStreaming:
        return watermarked(events, late).dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("e")).select("e.*")
