"""Changes of tables as plans: each returns the new table, so that nothing is written on a dry run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_period
from ..operators import fill
from ..operators.cells import global_maxima, real
from ..operators.records import last_of_key
from ..schemas import CELL_KEY


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of existing ones with their key."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_districts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All cells of the districts that ``new`` has are replaced by it."""
    return existing.join(new.select("district_id").distinct(), "district_id", "left_anti").unionByName(new, allowMissingColumns=True)


def patch(existing: DataFrame, changes: DataFrame, key: str, columns: list[str], stamp: Column | None = None) -> DataFrame:
    """Sets the columns that a change supplies (not null) and, if given, the time of change."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    out = existing.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    if stamp is not None:
        out = out.withColumn("updated_at", F.when(F.col("__hit"), stamp).otherwise(F.col("updated_at")))
    return out.select(*existing.columns)


def delete_districts(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the districts in ``gone``."""
    return {name: t.join(gone.select("district_id"), "district_id", "left_anti") for name, t in tables.items()}


def merge_lane_maps(left: Column, right: Column) -> Column:
    """Two lane maps as one; the right one's values win."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def rename_periods(availability: DataFrame) -> DataFrame:
    """Availability under normalised periods; districts and lanes that meet are merged, later spellings win."""
    lanes = availability.select("school_year", normalize_period(F.col("period")).alias("new_period"), "period", "district_id", F.explode("lanes").alias("combo", "max_step"))
    won = lanes.groupBy("school_year", "new_period", "district_id", "combo").agg(F.max_by("max_step", "period").alias("max_step"))
    return won.groupBy("school_year", F.col("new_period").alias("period"), "district_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("combo", "max_step")))).alias("lanes"))


def set_contracts(districts: DataFrame, files: DataFrame, prefix: str = "contracts/") -> DataFrame:
    """``contract_pdf`` from a listing of names; ``status``: updated, same or not_found."""
    keys = files.select(F.lower("name").alias("key"), F.concat(F.lit(prefix), "name", F.lit(".pdf")).alias("found")).groupBy("key").agg(F.min("found").alias("found"))
    joined = districts.withColumn("key", F.lower("name")).join(keys, "key", "left")
    return joined.withColumn("status", F.when(F.col("found").isNull(), "not_found").when(F.col("found").eqNullSafe(F.col("contract_pdf")), "same").otherwise("updated")).withColumn("contract_pdf", F.coalesce("found", "contract_pdf")).drop("key", "found")


def apply_records(existing: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, maxima) after new records of some districts: their cells replaced, then filled.

    Periods are normalised once, at the start; of records with one key the last counts. The
    fill uses the maxima after the change and only touches the districts that changed.
    """
    new = last_of_key(records.withColumn("period", normalize_period(F.col("period")))).select(*CELL_KEY, F.col("salary").cast("decimal(12,2)").alias("salary"))
    base = replace_districts(real(existing).select(*CELL_KEY, "salary"), new)
    top, combos = fill.combos_of(base)
    changed = base.join(new.select("district_id").distinct(), "district_id", "left_semi")
    rest = existing.join(new.select("district_id").distinct(), "district_id", "left_anti")
    return rest.unionByName(fill.complete(changed, top, combos), allowMissingColumns=True), global_maxima(base)
