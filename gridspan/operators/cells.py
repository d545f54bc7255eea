"""Schedules and what is derived from their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDUCATION_ORDER, LANE, SCHEDULE


def lane_key(education: Column | str = "education", credits: Column | str = "credits") -> Column:
    """``M+30``."""
    return F.concat_ws("+", education, F.col(credits).cast("string") if isinstance(credits, str) else credits.cast("string"))


def canonical_lane(key: Column) -> Column:
    """``B`` and ``B+0`` are one lane: the latter."""
    return F.when(F.instr(key, "+") > 0, key).otherwise(F.concat(key, F.lit("+0")))


def education_order(education: Column | str = "education", unknown: int = 99) -> Column:
    column = F.col(education) if isinstance(education, str) else education
    out = F.lit(unknown)
    for letter, place in EDUCATION_ORDER.items():
        out = F.when(column == letter, place).otherwise(out)
    return out


def with_defaults(cells: DataFrame) -> DataFrame:
    """Cells as they are read: types set, an absent ``is_calculated`` is false."""
    calculated = F.coalesce(F.col("is_calculated"), F.lit(False)) if "is_calculated" in cells.columns else F.lit(False)
    return cells.withColumns({"credits": F.col("credits").cast("int"), "step": F.col("step").cast("int"), "is_calculated": calculated})


def real(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.coalesce(F.col("is_calculated"), F.lit(False))) if "is_calculated" in cells.columns else cells


def schedule_of(cells: DataFrame, district_id, year: str | None = None) -> DataFrame:
    """A district's cells; ``year`` is a prefix of the school year."""
    out = cells.filter(F.col("district_id") == district_id)
    return out.filter(F.col("school_year").startswith(year)) if year else out


def cell_at(cells: DataFrame, district_id, year: str, period: str, education: str, credits: int, step: int) -> DataFrame:
    """The one cell of a full key, or no row; every part of the key reaches the scan."""
    key = {"district_id": district_id, "school_year": year, "period": period, "education": education, "credits": credits, "step": step}
    out = cells
    for c, value in key.items():
        out = out.filter(F.col(c) == value)
    return out.limit(1)


def catalogue_of(cells: DataFrame, year: str | None = None) -> DataFrame:
    """The schedules that there are, in order; ValueError if none is of the year that is asked for."""
    out = cells.filter(F.col("school_year") == year) if year else cells
    found = out.select("school_year", "period").distinct()
    if year and found.isEmpty():
        raise ValueError(f"no schedules for {year}")
    return found.orderBy(*schedule_order())


def nested_schedules(cells: DataFrame) -> DataFrame:
    """One row per schedule with its cells as a sorted array."""
    return cells.groupBy(*SCHEDULE).agg(F.array_sort(F.collect_list(F.struct("education", "credits", "step", "salary"))).alias("cells"), F.count(F.lit(1)).alias("n_cells"))


def schedule_order() -> list[Column]:
    """Years ascending with unparsed ones first, periods descending."""
    return [F.regexp_extract("school_year", r"(\d{4})", 1).try_cast("int").asc_nulls_first(), F.col("period").desc()]


def district_metadata(cells: DataFrame) -> DataFrame:
    """Per district: salary range, latest year, years and (year, period) pairs in order."""
    return cells.groupBy("district_id").agg(
        F.min("salary").alias("min_salary"),
        F.max("salary").alias("max_salary"),
        F.max("school_year").alias("latest_year"),
        F.array_sort(F.collect_set("school_year")).alias("years"),
        F.array_sort(F.collect_set(F.struct("school_year", "period"))).alias("schedules"),
    )


def global_maxima(cells: DataFrame) -> DataFrame:
    """One row: the highest step and all lanes in order."""
    return cells.agg(F.max("step").alias("max_step"), F.array_sort(F.collect_set(lane_key())).alias("combos"))


def merged_maxima(old: DataFrame, new: DataFrame) -> DataFrame:
    """Maxima of two one-row tables together."""
    return old.unionByName(new).agg(F.max("max_step").alias("max_step"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("combos")))).alias("combos"))


def metadata_change(old_max: Column, old_combos: Column, new_max: Column, new_combos: Column) -> Column:
    """Whether new maxima need a fill of everything: struct(changed, needs_fill). Without old maxima: (true, false)."""
    grown = (new_max > old_max) | (F.size(F.array_except(new_combos, old_combos)) > 0)
    return F.when(old_max.isNull(), F.struct(F.lit(True).alias("changed"), F.lit(False).alias("needs_fill"))).otherwise(F.struct(grown.alias("changed"), grown.alias("needs_fill")))


def availability_rows(cells: DataFrame) -> DataFrame:
    """Highest step of each lane that a district has in a year and period."""
    return cells.groupBy("school_year", "period", "district_id", lane_key().alias("combo")).agg(F.max("step").alias("max_step"))


def availability(cells: DataFrame) -> DataFrame:
    """The same as a map per district: lane to highest step."""
    return availability_rows(cells).groupBy("school_year", "period", "district_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("combo", "max_step")))).alias("lanes"))


def lane_options(cells: DataFrame) -> DataFrame:
    """Credits on offer per education level."""
    return cells.groupBy("education").agg(F.array_sort(F.collect_set("credits")).alias("credits"))


def pivot_grid(cells: DataFrame, lanes: list[str]) -> DataFrame:
    """Step rows by lane columns. The lanes are given, so that no pass is needed to find them."""
    return cells.withColumn("lane", lane_key()).groupBy(*SCHEDULE, "step").pivot("lane", lanes).agg(F.max("salary"))


def unpivot_grid(grid: DataFrame, lanes: list[str]) -> DataFrame:
    """The inverse of pivot_grid; empty places are dropped."""
    long = grid.unpivot([*SCHEDULE, "step"], [F.col(f"`{x}`") for x in lanes], "lane", "salary").filter("salary IS NOT NULL")
    parts = F.split("lane", r"\+")
    return long.select(*SCHEDULE, parts[0].alias("education"), parts[1].cast("int").alias("credits"), "step", "salary")


def suppress_calculated(cells: DataFrame, dealt: bool = False) -> DataFrame:
    """Drops lanes that are calculated throughout, then steps that are in the lanes left; cells ``dealt`` by district are not shuffled."""
    lane_real = F.max((~F.col("is_calculated")).cast("int")).over(Window.partitionBy(*SCHEDULE, *LANE))
    step_real = F.max((~F.col("is_calculated")).cast("int")).over(Window.partitionBy(*SCHEDULE, "step"))
    return (cells if dealt else cells.repartition(*SCHEDULE)).withColumn("__real", lane_real).filter("__real = 1").withColumn("__real", step_real).filter("__real = 1").drop("__real")


def highlight(filled: DataFrame, education: str, credits: int, step: int) -> DataFrame:
    """Where a looked-up cell is shown: itself if real, else the cell that it was calculated from."""
    at = filled.filter((F.col("education") == education) & (F.col("credits") == credits) & (F.col("step") == step))
    root = lambda name: F.when(F.col("is_calculated"), F.col(f"is_calculated_from.{name}")).otherwise(F.col(name))
    return at.select(*SCHEDULE, root("education").alias("education"), root("credits").alias("credits"), root("step").alias("step"), "salary")


def copy_lane(cells: DataFrame, old: tuple[str, int], new: tuple[str, int]) -> DataFrame:
    """Adds a lane with another one's values; cells that the new lane has already stay."""
    at = lambda lane: (F.col("education") == lane[0]) & (F.col("credits") == lane[1])
    copied = cells.filter(at(old)).withColumns({"education": F.lit(new[0]), "credits": F.lit(new[1]).cast("int")})
    have = cells.filter(at(new)).select(*SCHEDULE, "step")
    return cells.unionByName(copied.join(have, [*SCHEDULE, "step"], "left_anti"))


def relabel_lane(cells: DataFrame, old: tuple[str, int], new: tuple[str, int]) -> DataFrame:
    hit = (F.col("education") == old[0]) & (F.col("credits") == old[1])
    return cells.withColumns({"education": F.when(hit, new[0]).otherwise(F.col("education")), "credits": F.when(hit, new[1]).otherwise(F.col("credits")).cast("int")})


def delete_lane(cells: DataFrame, lane: tuple[str, int]) -> DataFrame:
    return cells.filter((F.col("education") != lane[0]) | (F.col("credits") != lane[1]))


def check_lane(education: str, credits: int, step: int, max_step: int, credits_on_offer: list[int]) -> None:
    """Parameters of a comparison against the maxima; ValueError says what is wrong."""
    if education not in EDUCATION_ORDER:
        raise ValueError(f"education must be one of {', '.join(EDUCATION_ORDER)}")
    if not 1 <= step <= max_step:
        raise ValueError(f"step must be from 1 to {max_step}")
    if credits not in credits_on_offer:
        raise ValueError(f"credits must be one of {', '.join(map(str, sorted(credits_on_offer)))}")


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def edit_counts(cells: DataFrame) -> DataFrame:
    """Edited and calculated cells per schedule, from flags ``is_edited`` and ``is_calculated``."""
    return cells.groupBy(*SCHEDULE).agg(F.count_if("is_edited").alias("edited"), F.count_if(F.col("is_calculated") & ~F.col("is_edited")).alias("calculated"), F.count(F.lit(1)).alias("n"))


def new_schedules(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Of wanted schedules (district, year, period) those that don't exist yet."""
    return wanted.join(cells.select(*SCHEDULE), SCHEDULE, "left_anti")


def year_options(start: Column, n: int = 3) -> Column:
    """School years from a starting year on, as an array of texts."""
    return F.transform(F.sequence(start, start + (n - 1)), lambda y: F.concat_ws("-", y.cast("string"), (y + 1).cast("string")))
