"""Availability, catalogue and maxima kept up by changes of districts, not made anew.

What a district has in a schedule are its facts: its lanes and their highest steps. Facts lie in
folders by bucket of district, and a change rewrites only the buckets of its districts. The
catalogue, the lanes and the steps are counts of facts; what a replaced district had is
subtracted, what it has now is added, and a count of nothing goes. Every change is a version of its own:

    root/facts/version=3/bucket=17/    facts of that bucket since version 3
    root/counts/version=3/             kind, key, n
    root/map/version=3/                for every bucket its version; written last, it makes the change one

So a batch that comes again, after it was done or after it was broken off, changes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import lane_key

BUCKETS = 64
#: Into how many parts a bucket's districts are dealt when it is written.
SLICES = 8
CHANGE = "district_id long, seq long, cells array<struct<school_year:string,period:string,education:string,credits:int,step:int>>"
FACTS = "school_year string, period string, district_id long, combo string, max_step int"
COUNTS = "kind string, key string, n long"
MAP = "bucket int, version long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The changes that are whole, in order; their number is that of the batches kept."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/map")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath() for s in files.listStatus(place)]
    return sorted(int(p.getName().split("=")[1]) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _map(spark: SparkSession, root: str, version: int | None) -> dict[int, int]:
    """Bucket to version, a row for each bucket."""
    return {} if version is None else {b: v for b, v in spark.read.schema(MAP).parquet(f"{root}/map/version={version}").collect()}


def _facts(spark: SparkSession, root: str, held: dict[int, int]) -> DataFrame:
    paths = [p for b, v in sorted(held.items()) if _exists(spark, p := f"{root}/facts/version={v}/bucket={b}")]
    return spark.read.schema(FACTS).parquet(*paths) if paths else spark.createDataFrame([], FACTS)


def counted(facts: DataFrame) -> DataFrame:
    """``kind, key, n``: districts of each schedule, and facts of each lane and each highest step."""
    schedules = facts.select("district_id", "school_year", "period").distinct().groupBy(F.concat_ws("#", "school_year", "period").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("schedule").alias("kind"), "key", "n")
    pairs = facts.groupBy("combo", "max_step").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(F.struct(F.lit("lane").alias("kind"), F.col("combo").alias("key")), F.struct(F.lit("step").alias("kind"), F.col("max_step").cast("string").alias("key")))
    others = pairs.select("n", F.inline(kinds)).groupBy("kind", "key").agg(F.sum("n").alias("n")).select("kind", "key", "n")
    return schedules.unionByName(others)


def apply_changes(changes: DataFrame, version: int, root: str, buckets: int = BUCKETS) -> bool:
    """Replaces the districts of ``changes`` (CHANGE) as change number ``version``; False if that is done already.

    Of several changes of a district the one of the highest ``seq`` counts; one with no cells removes it.
    Only the buckets of changed districts are read and written, and counts change by
    what their districts had and have.
    """
    spark = changes.sparkSession
    done = versions(spark, root)
    if version in done:
        return False
    last = max((v for v in done if v < version), default=None)
    held = _map(spark, root, last)
    latest = changes.groupBy("district_id").agg(F.max_by("cells", "seq").alias("cells")).withColumn("bucket", F.pmod(F.xxhash64("district_id"), F.lit(buckets)).cast("int"))
    place = f"{root}/changes/version={version}"
    latest.write.mode("overwrite").parquet(place)
    latest = spark.read.schema(latest.schema).parquet(place)
    touched = sorted(r[0] for r in latest.select("bucket").distinct().collect())
    old = _facts(spark, root, {b: held[b] for b in touched if b in held})
    stay = old.join(latest.select("district_id"), "district_id", "left_anti").select(*old.columns)
    new = latest.select("district_id", F.inline("cells")).select("school_year", "period", "district_id", lane_key().alias("combo"), F.col("step").alias("max_step"))
    # what stays and the new cells are dealt once, a bucket to several tasks, grouped there and written
    parted = stay.unionByName(new).withColumns({"bucket": F.pmod(F.xxhash64("district_id"), F.lit(buckets)).cast("int"), "slice": F.pmod(F.xxhash64("district_id", F.lit("slice")), F.lit(SLICES))})
    facts = parted.repartition("bucket", "slice").groupBy("bucket", "slice", "school_year", "period", "district_id", "combo").agg(F.max("max_step").alias("max_step"))
    facts.select(*old.columns, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/facts/version={version}")
    # the touched buckets as they were and as they lie there now: districts that stay cancel out
    change = counted(_facts(spark, root, dict.fromkeys(touched, version))).unionByName(counted(old).withColumn("n", -F.col("n")))
    if last is not None:
        change = change.unionByName(spark.read.schema(COUNTS).parquet(f"{root}/counts/version={last}"))
    change.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{root}/counts/version={version}")
    now = {**held, **dict.fromkeys(touched, version)}
    spark.createDataFrame(sorted(now.items()), MAP).coalesce(1).write.mode("overwrite").parquet(f"{root}/map/version={version}")
    return True


def keep_up(changes: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS):
    """Streaming: each batch of changes is a version, numbered by the batch."""
    return changes.writeStream.foreachBatch(lambda rows, k: apply_changes(rows, k, root, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def availability_now(spark: SparkSession, root: str) -> DataFrame:
    """``school_year, period, district_id, combo, max_step`` as of the last change."""
    done = versions(spark, root)
    return _facts(spark, root, _map(spark, root, done[-1] if done else None))


def counts_now(spark: SparkSession, root: str) -> DataFrame:
    done = versions(spark, root)
    return spark.read.schema(COUNTS).parquet(f"{root}/counts/version={done[-1]}") if done else spark.createDataFrame([], COUNTS)


def catalogue_now(spark: SparkSession, root: str) -> DataFrame:
    """``school_year, period, n_districts``: the schedules that some district has."""
    parts = F.split("key", "#", 2)
    return counts_now(spark, root).filter("kind = 'schedule'").select(parts[0].alias("school_year"), parts[1].alias("period"), F.col("n").alias("n_districts"))


def maxima_now(spark: SparkSession, root: str) -> DataFrame:
    """One row: the highest step and all lanes in order, from counts alone."""
    counts = counts_now(spark, root)
    return counts.agg(F.max(F.when(F.col("kind") == "step", F.col("key").cast("int"))).alias("max_step"), F.array_sort(F.collect_list(F.when(F.col("kind") == "lane", F.col("key")))).alias("combos"))


def changes_of(cells: DataFrame, seq: int) -> DataFrame:
    """Each district of ``cells`` replaced by its cells there, which are bounded by its schedules."""
    return cells.groupBy("district_id").agg(F.collect_list(F.struct("school_year", "period", "education", F.col("credits").cast("int").alias("credits"), F.col("step").cast("int").alias("step"))).alias("cells")).select("district_id", F.lit(seq).cast("long").alias("seq"), "cells")


def removals_of(districts: DataFrame, seq: int) -> DataFrame:
    return districts.select("district_id", F.lit(seq).cast("long").alias("seq"), F.from_json(F.lit("[]"), CHANGE.split("cells ")[1]).alias("cells"))
