"""Medians of groups of any size: exact by counting, or from sketches that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Bits of a value that a round tells apart: a group has at most so many counts, 2 to that power.
BITS = 12
#: Size of a sketch; the rank of what it gives is off by less than RANK_ERROR of all values, in 99 of 100 cases.
SKETCH, RANK_ERROR = 400, 0.01


def selected(rows: DataFrame, by: list[str], value: str, ranks: Column, bits: int = BITS) -> DataFrame:
    """``*by, rank, value``: of each group the values at ``ranks``, an array over ``n`` of places from 0 on; exact.

    ``value`` is a whole number, nulls are left out. Each round counts a digit of ``bits`` bits: of all values
    first, then of those that agree with a searched one so far. Counts are added up before
    they are shuffled; a group has at most 2 ** ``bits`` of them a searched rank, however many rows it
    has and however they repeat. So many rounds as the widest value has digits, each a pass over the rows.
    """
    spark = rows.sparkSession
    place = scratch(spark, "selected")
    plain = rows.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.col(value).cast("long").alias("v")).filter("v IS NOT NULL")
    group = [f"g{i}" for i in range(len(by))]
    ends = plain.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends.write.parquet(f"{place}/ends")
    ends = spark.read.schema(ends.schema).parquet(f"{place}/ends")
    width = ends.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    if width is None:
        return ends.select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], F.lit(0).cast("long").alias("rank"), F.col("low").alias("value"))
    rounds = max(1, -(-int(width).bit_length() // bits))
    searched = ends.select(*group, "low", F.explode(F.array_distinct(ranks)).alias("rank")).withColumns({"left": F.col("rank").cast("long"), "prefix": F.lit(0).cast("long")})
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    for k in reversed(range(rounds)):
        shift = k * bits
        wanted = searched.select(*group, "low", "prefix").distinct()
        off = F.col("r.v") - F.col("w.low")
        at = [*same("r", "w"), F.shiftright(off, shift + bits) == F.col("w.prefix")]
        counts = plain.alias("r").join(wanted.alias("w"), at).groupBy(*[F.col(f"w.{g}").alias(g) for g in group], F.col("w.prefix").alias("prefix"), F.shiftright(off, shift).alias("next")).agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*group, "prefix").orderBy("next"))
        found = searched.alias("s").join(counts.withColumn("upto", upto).alias("c"), [*same("s", "c"), F.col("s.prefix") == F.col("c.prefix"), F.col("s.left") < F.col("c.upto"), F.col("s.left") >= F.col("c.upto") - F.col("c.m")])
        narrowed = found.select(*[F.col(f"s.{g}").alias(g) for g in group], "s.low", "s.rank", (F.col("s.left") - F.col("c.upto") + F.col("c.m")).alias("left"), F.col("c.next").alias("prefix"))
        narrowed.write.parquet(f"{place}/{k}")
        searched = spark.read.schema(narrowed.schema).parquet(f"{place}/{k}")
    return searched.select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], "rank", (F.col("low") + F.col("prefix")).alias("value"))


def exact_medians(rows: DataFrame, by: list[str], value: str, scale: int = 2) -> DataFrame:
    """``*by, median``: the mean of the middle values of each group, of decimals with ``scale`` places."""
    whole = rows.withColumn("__whole", F.round(F.col(value).cast("decimal(38,6)") * 10**scale).cast("long"))
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    found = selected(whole, by, "__whole", middle)
    return found.groupBy(*by).agg((F.avg("value") / 10**scale).alias("median"))


def median_sketches(rows: DataFrame, by: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """``*by, sketch``: of each group a sketch of its values, of bounded size; sketches of parts can be kept and merged."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_medians(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``*by, n, median``: from the sketches of all parts of each group, within RANK_ERROR of the middle rank."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median"))
