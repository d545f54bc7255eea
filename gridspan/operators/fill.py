"""Completion of sparse grids: down the steps of a lane, then across missing lanes.

The order-dependent procedure has a closed form when lanes are taken in key order; everything
below is built-in expressions over one row per schedule, so that there is one shuffle, by schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDUCATION_ORDER, SCHEDULE
from .cells import education_order


def lanes_by_schedule(cells: DataFrame, dealt: bool = False) -> DataFrame:
    """``lanes``: each real lane with its steps in order. Both aggregations follow one exchange, or none where cells are ``dealt`` by district, as stored ones are."""
    steps = F.sort_array(F.collect_list(F.struct("step", "salary")))
    return (
        (cells if dealt else cells.repartition(*SCHEDULE))
        .groupBy(*SCHEDULE, "education", "credits")
        .agg(steps.alias("steps"))
        .groupBy(*SCHEDULE)
        .agg(F.collect_list(_lane(F.col("education"), F.col("credits"), F.lit(0), F.col("education"), F.col("credits"), F.concat_ws("+", "education", "credits"), F.col("steps"))).alias("lanes"))
    )


def _lane(education: Column, credits: Column, filled: Column, root_education: Column, root_credits: Column, source: Column, steps: Column) -> Column:
    return F.struct(credits.cast("int").alias("credits"), filled.cast("int").alias("filled"), education_order(education).alias("place"), education.alias("education"), root_education.alias("root_education"), root_credits.cast("int").alias("root_credits"), source.alias("source"), steps.alias("steps"))


def _best(lanes: Column) -> Column:
    """Highest credits, a real lane before a filled one, lower education first."""
    return F.array_max(F.transform(lanes, lambda x: F.struct(x["credits"].alias("c"), (-x["filled"]).alias("f"), (-x["place"]).alias("p"), x.alias("lane"))))["lane"]


def with_missing_lanes(schedules: DataFrame, combos: dict[str, list[int]]) -> DataFrame:
    """Adds to ``lanes`` those of ``combos`` (credits by education) that can be filled.

    A missing lane takes the next lower real lane of its education, else its lowest; without
    any, the best lane, real or filled, of lower educations, and all lanes of the education share
    that root. ``source`` is the lane it is copied from: the one before it where there is one.
    """
    out = schedules
    for education in sorted(EDUCATION_ORDER, key=EDUCATION_ORDER.get):
        if combos.get(education):
            out = _with_lanes_of(out, education, sorted(combos[education]))
    return out


def _with_lanes_of(schedules: DataFrame, education: str, credits: list[int]) -> DataFrame:
    own = F.filter("lanes", lambda x: x["education"] == education)
    lower = F.filter("lanes", lambda x: x["place"] < EDUCATION_ORDER[education])
    wanted = F.array(*[F.lit(c).cast("int") for c in credits])
    had = F.transform(own, lambda x: x["credits"])
    # what is used several times comes out of a generator, for the planner would write it out each time
    helped = F.struct(own.alias("__own"), had.alias("__had"), _best(lower).alias("__lower"), F.array_except(wanted, had).alias("__wanted"))
    out = schedules.select(*SCHEDULE, "lanes", F.inline(F.array(helped)))

    def lane(c: Column) -> Column:
        below = F.filter("__own", lambda x: x["credits"] < c)
        real = F.when(F.size(below) > 0, F.array_max(below)).otherwise(F.array_min("__own"))
        root = F.when(F.size("__own") > 0, real).otherwise(F.col("__lower"))
        before = F.array_max(F.filter(F.concat("__had", "__wanted"), lambda k: k < c))
        name = F.when(before.isNotNull(), F.concat(F.lit(f"{education}+"), before.cast("string"))).otherwise(F.concat_ws("+", root["education"], root["credits"].cast("string")))
        return _lane(F.lit(education), c, F.lit(1), root["root_education"], root["root_credits"], name, root["steps"])

    fits = (F.size("__own") > 0) | F.col("__lower").isNotNull()
    new = F.when(fits, F.transform("__wanted", lane)).otherwise(F.filter("lanes", lambda x: F.lit(False)))
    return out.select(*SCHEDULE, F.explode(F.array(F.concat("lanes", new))).alias("lanes"))


def spread(schedules: DataFrame, max_step: int) -> DataFrame:
    """The calculated cells of every lane: steps 1 to ``max_step`` that have no real cell.

    A step takes the highest real step up to it, else the lowest real step of its root lane.
    """
    lane = schedules.select(*SCHEDULE, F.explode("lanes").alias("lane")).select(*SCHEDULE, "lane.*")
    stepped = lane.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(max_step))))
    at = F.filter("steps", lambda x: x["step"] <= F.col("step"))
    chosen = stepped.withColumn("from", F.when(F.size(at) > 0, F.element_at(at, -1)).otherwise(F.col("steps")[0]))
    return chosen.filter((F.col("filled") == 1) | (F.col("from.step") != F.col("step"))).select(
        *SCHEDULE,
        "education",
        "credits",
        "step",
        F.col("from.salary").alias("salary"),
        F.lit(True).alias("is_calculated"),
        F.struct(F.col("root_education").alias("education"), F.col("root_credits").alias("credits"), F.col("from.step").alias("step")).alias("is_calculated_from"),
        F.col("source").alias("source_edu_credit"),
        F.col("from.step").alias("source_step"),
    )


def fill_down(cells: DataFrame, max_step: int, dealt: bool = False) -> DataFrame:
    """Calculated cells of the lanes that a schedule has."""
    return spread(lanes_by_schedule(cells, dealt), max_step)


def fill_missing(cells: DataFrame, max_step: int, combos: dict[str, list[int]], dealt: bool = False) -> DataFrame:
    """Calculated cells of the lanes that a schedule lacks, alone: lanes that it has leave before their steps are spread."""
    every = with_missing_lanes(lanes_by_schedule(cells, dealt), combos)
    return spread(every.withColumn("lanes", F.filter("lanes", lambda x: x["filled"] == 1)), max_step)


def fill_grid(cells: DataFrame, max_step: int, combos: dict[str, list[int]], dealt: bool = False) -> DataFrame:
    """Calculated cells of all lanes: those a schedule has and those it lacks."""
    return spread(with_missing_lanes(lanes_by_schedule(cells, dealt), combos), max_step)


def complete(cells: DataFrame, max_step: int, combos: dict[str, list[int]]) -> DataFrame:
    """Real and calculated cells together."""
    real = cells.select(*SCHEDULE, "education", "credits", "step", "salary", F.lit(False).alias("is_calculated"))
    return real.unionByName(fill_grid(cells, max_step, combos), allowMissingColumns=True)


def combos_of(cells: DataFrame) -> tuple[int, dict[str, list[int]]]:
    """(max step, credits by education): a few numbers, whatever the number of cells."""
    found: dict[str, list[int]] = {}
    top = 0
    for education, credits, step in cells.groupBy("education", "credits").agg(F.max("step")).collect():
        found.setdefault(education, []).append(credits)
        top = max(top, step)
    return top, {e: sorted(c) for e, c in found.items()}
