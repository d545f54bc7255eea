"""Comparison of districts on one lane and step, with a fallback lane."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COMPARED_TYPES, EDUCATION_ORDER
from .cells import education_order
from .quantiles import exact_medians
from .ranking import numbered


def resolve_lane(combos: Iterable[str], education: str, credits: int, include_fallback: bool = True) -> tuple[str, int, bool]:
    """(education, credits, exact): the lane itself, else the best one that isn't above it.

    Of the target's education only credits up to the target's count, of lower ones any;
    higher education wins, then higher credits. ValueError where nothing is left.
    """
    lanes = [(e, int(c)) for e, _, c in (x.partition("+") for x in combos) if c.isdigit()]
    if (education, credits) in lanes:
        return education, credits, True
    level = EDUCATION_ORDER.get(education, 0)
    fit = [(EDUCATION_ORDER.get(e, 0), c, e) for e, c in lanes if EDUCATION_ORDER.get(e, 0) <= level and (e != education or c <= credits)]
    if not include_fallback or not fit:
        raise ValueError(f"no data for {education}+{credits}" + ("" if include_fallback else " without fallback"))
    _, c, e = max(fit)
    return e, c, False


def resolve_lanes(targets: DataFrame, combos: DataFrame) -> DataFrame:
    """resolve_lane for a table of targets (education, credits) against a table of lanes.

    The lanes come as one array of a few dozen entries; each target folds over it, so that
    there is neither a theta join nor a shuffle of targets.
    """
    lanes = combos.select(education_order("education", 0).alias("level"), F.col("credits").cast("int").alias("credits"), "education").distinct().agg(F.collect_list(F.struct("level", "credits", "education")).alias("lanes"))
    level = education_order("education", 0)
    fit = F.filter("lanes", lambda x: (x["level"] <= level) & ((x["education"] != F.col("education")) | (x["credits"] <= F.col("credits"))))
    exact = F.exists("lanes", lambda x: (x["education"] == F.col("education")) & (x["credits"] == F.col("credits")))
    best = F.array_max(fit)
    joined = targets.select(F.col("education"), F.col("credits").cast("int").alias("credits")).join(F.broadcast(lanes))
    return joined.select(
        "education",
        "credits",
        F.when(exact, F.col("education")).otherwise(best["education"]).alias("query_education"),
        F.when(exact, F.col("credits")).otherwise(best["credits"]).alias("query_credits"),
        exact.alias("is_exact"),
    )


def _shown(keep: str) -> list[Column]:
    year, period = F.coalesce("school_year", F.lit("")), F.coalesce("period", F.lit(""))
    if keep == "latest":
        return [year.desc(), period.desc(), F.col("salary").desc()]
    return [year, period, F.col("salary").desc()]


def compare(cells: DataFrame, districts: DataFrame, education: str, credits: int, step: int, keep: str = "oldest", rank_by: str = "first_seen", year: str | None = None, district_type: str | None = None, types: tuple[str, ...] = COMPARED_TYPES) -> DataFrame:
    """Ranked districts on one lane and step.

    Of a district's years and periods one is shown, the oldest or the latest. Ranks follow
    either the place of a district's best row in the order of falling salaries
    (``first_seen``) or the shown salary (``salary``). Districts of other types are left out.
    The filter reaches the scan; cells stored by district need no shuffle up to the ranking, which deals
    a row per district out by ranges.
    """
    at = cells.filter((F.col("education") == education) & (F.col("credits") == credits) & (F.col("step") == step) & F.col("district_id").isNotNull())
    if year is not None:
        at = at.filter(F.col("school_year") == year)
    own = Window.partitionBy("district_id")
    seen = F.min(F.struct((-F.col("salary")).alias("s"), "school_year", "district_id", "period")).over(own)
    shown = at.withColumn("seen", seen).withColumn("n", F.row_number().over(own.orderBy(*_shown(keep)))).filter("n = 1")
    kind = F.coalesce("district_type", F.lit("unknown"))
    named = shown.join(districts.select("district_id", "name", "district_type", "towns"), "district_id", "left").filter(kind.isin(*types))
    if district_type is not None:
        named = named.filter(kind == district_type)
    order = [F.col("seen")] if rank_by == "first_seen" else [F.col("salary").desc(), F.col("school_year"), F.col("district_id"), F.col("period")]
    return numbered(named, *order).select("rank", "district_id", F.col("name").alias("district_name"), "district_type", "towns", "school_year", "period", "education", "credits", "step", "salary")


def spread_of(ranked: DataFrame) -> DataFrame:
    """First and last by rank and what lies between, with the number of rows."""
    return ranked.agg(F.min_by("salary", "rank").alias("highest"), F.max_by("salary", "rank").alias("lowest"), F.count(F.lit(1)).alias("n")).withColumn("difference", F.col("highest") - F.col("lowest"))


def statistics(cells: DataFrame, *by: str) -> DataFrame:
    """Least, greatest, mean and median salary of each group, which may be of any size."""
    plain = cells.groupBy(*by).agg(F.min("salary").alias("min_salary"), F.max("salary").alias("max_salary"), F.avg(F.col("salary").cast("double")).alias("avg_salary"), F.count(F.lit(1)).alias("n"))
    medians = exact_medians(cells, list(by), "salary").select(*[F.col(c).alias(f"__{c}") for c in by], F.col("median").alias("median_salary"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return plain.join(medians, same, "left").select(*by, "min_salary", "max_salary", "avg_salary", "median_salary", "n")


def top(cells: DataFrame, k: int) -> DataFrame:
    """The k best paid cells; a limit is the feature."""
    return cells.orderBy(F.col("salary").desc(), "school_year", "district_id", "period", "education", "credits", "step").limit(k)


# -- maps -------------------------------------------------------------------------------------


def town_ranks(ranked: DataFrame) -> DataFrame:
    """Best rank, and its district and salary, of each town."""
    towns = ranked.select("rank", "district_id", "salary", F.explode("towns").alias("town")).withColumn("town", F.lower(F.trim("town")))
    return towns.groupBy("town").agg(F.min("rank").alias("rank"), F.min_by("district_id", "rank").alias("district_id"), F.min_by("salary", "rank").alias("salary"), F.collect_set("district_id").alias("__all")).withColumn("n_districts", F.size("__all")).drop("__all")


# The three colours of the scale, as red, green and blue.
LOW, MIDDLE, HIGH = (239, 68, 68), (250, 204, 21), (34, 197, 94)


def colours(ranked: DataFrame) -> DataFrame:
    """Position in [0, 1], best first, and its colour on a scale of two parts; a single row gets 1.

    Ranks run from 1 to the number of rows, as ``compare`` gives them and ``reranked`` makes them.
    """
    last = ranked.agg(F.max("rank").alias("n")).scalar()
    out = ranked.withColumn("position", 1 - F.when(last > 1, (F.col("rank") - 1) / (last - 1)).otherwise(0.0))
    low = F.col("position") < 0.5
    part = F.when(low, F.col("position") * 2).otherwise((F.col("position") - 0.5) * 2)
    for k, channel in enumerate(("red", "green", "blue")):
        a = F.when(low, F.lit(LOW[k])).otherwise(F.lit(MIDDLE[k]))
        b = F.when(low, F.lit(MIDDLE[k])).otherwise(F.lit(HIGH[k]))
        out = out.withColumn(channel, F.floor(a + (b - a) * part + 0.5).cast("int"))
    return out
