"""Who has data and who lacks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_period
from ..schemas import COMPARED_TYPES, SCHEDULE


def missing_contracts(districts: DataFrame, cells: DataFrame, year: str, period: str | None = None, types: tuple[str, ...] = COMPARED_TYPES) -> DataFrame:
    """Eligible districts without a schedule in a year and period."""
    have = cells.filter((F.col("school_year") == year) & (normalize_period(F.col("period")) == normalize_period(F.lit(period)))).select("district_id").distinct()
    return districts.filter(F.lower(F.coalesce("district_type", F.lit("unknown"))).isin(*types)).join(have, "district_id", "left_anti")


def missing_by_schedule(districts: DataFrame, cells: DataFrame, types: tuple[str, ...] = COMPARED_TYPES) -> DataFrame:
    """Every schedule (year, period) that some district has and an eligible district lacks: a row for each of these.

    The schedules, some dozens, come as one array that each district unfolds, so that there is no theta join.
    """
    known = cells.agg(F.array_sort(F.collect_set(F.struct("school_year", "period"))).alias("s")).scalar()
    eligible = districts.filter(F.lower(F.coalesce("district_type", F.lit("unknown"))).isin(*types))
    each = eligible.withColumn("__s", F.explode(known)).withColumns({"school_year": F.col("__s.school_year"), "period": F.col("__s.period")}).drop("__s")
    return each.join(cells.select(*SCHEDULE).distinct(), SCHEDULE, "left_anti")


def present(districts: DataFrame, cells: DataFrame, year: str, period: str) -> DataFrame:
    return districts.join(cells.filter((F.col("school_year") == year) & (F.col("period") == period)).select("district_id"), "district_id", "left_semi")


def by_type(districts: DataFrame, cells: DataFrame, year: str) -> DataFrame:
    """Districts per type with and without data in a year."""
    have = cells.filter(F.col("school_year") == year).select("district_id").distinct().withColumn("has", F.lit(1))
    return districts.join(have, "district_id", "left").groupBy("district_type").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("with_data")).withColumn("missing", F.col("n") - F.col("with_data"))


def report(cells: DataFrame) -> DataFrame:
    """Districts, lanes and cells per year and period."""
    return cells.groupBy("school_year", "period").agg(F.count_distinct("district_id").alias("districts"), F.count_distinct("education", "credits").alias("lanes"), F.count(F.lit(1)).alias("cells"))


def combos(cells: DataFrame) -> DataFrame:
    """The lanes that each year and period has, as a sorted set."""
    return cells.groupBy("school_year", "period").agg(F.array_sort(F.collect_set(F.concat_ws("+", "education", F.col("credits").cast("string")))).alias("combos"))


def record_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("district_id").agg(F.count(F.lit(1)).alias("records"), F.array_sort(F.collect_set("school_year")).alias("years"))


def completeness(found: DataFrame, expected: int) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("found")).withColumn("missing", F.lit(expected).cast("long") - F.col("found"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Files that succeeded or failed, per extraction method."""
    return results.groupBy("method").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def missing_as_csv(missing: DataFrame) -> DataFrame:
    """The columns of the export: towns in one field, defaults for what is absent. Write with quoteAll."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))
    return missing.select(text("name").alias("District Name"), text("district_type").alias("Type"), F.coalesce(F.nullif(F.concat_ws("; ", "towns"), F.lit("")), F.lit("N/A")).alias("Towns"))
