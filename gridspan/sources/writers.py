"""Writers. Tables are Parquet partitioned by school year; replacing a partition is one overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Options for writing many small files: a task that is done moves its files itself, so that the driver doesn't move each in
#: turn at the end. A write that breaks off may leave some; it is whole when _SUCCESS is there.
MANY_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def write_cells(cells: DataFrame, path: str, buckets: int = 16) -> None:
    """Partitioned by school year and sorted by lane and step, so that a comparison reads a few row groups.

    A year is written by ``buckets`` tasks, dealt by district.
    """
    cells.repartition("school_year", F.pmod(F.xxhash64("district_id"), F.lit(buckets))).sortWithinPartitions("education", "credits", "step").write.mode("overwrite").partitionBy("school_year").parquet(path)


def replace_partitions(cells: DataFrame, path: str) -> None:
    """Overwrites the partitions that occur in ``cells`` and no other."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("school_year").parquet(path)


def as_backups(cells: DataFrame, applied_at: str) -> DataFrame:
    """One document per district with all its records in order."""
    record = F.struct("district_id", "district_name", "school_year", "period", "education", "credits", "step", F.col("salary").cast("double").alias("salary"))
    return cells.groupBy("district_id").agg(F.max("district_name").alias("district_name"), F.sort_array(F.collect_list(record)).alias("records")).select("district_id", "district_name", F.lit(applied_at).alias("applied_at"), F.size("records").alias("records_count"), "records")


def write_backups(cells: DataFrame, path: str, applied_at: str, mode: str = "overwrite") -> None:
    """A folder for each district. In a new folder (``mode`` error) tasks put their own files in place; replaced ones are moved by the driver, one after another."""
    as_backups(cells, applied_at).withColumn("folder", F.col("district_name")).write.mode(mode).options(**MANY_FILES).partitionBy("folder").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
