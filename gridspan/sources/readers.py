"""Readers with explicit schemas: no pass over the data to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BACKUPS, OCR_BLOCKS, RECORDS, SOURCE_DISTRICT

# The categories of the district source file and the type that each stands for.
CATEGORIES = {"municipal": "municipal", "regional_academic": "regional_academic", "regional_vocational": "regional_vocational", "county_agricultural": "county_agricultural", "charter": "charter"}

#: Tasks to a core that list folders.
LISTERS = 4


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of extracted records; salary as decimal."""
    return spark.read.schema(RECORDS).option("multiLine", True).json(path).withColumn("salary", F.col("salary").cast("decimal(12,2)"))


def backups(spark: SparkSession, path: str) -> DataFrame:
    """The records of backup documents, one row each."""
    return spark.read.schema(BACKUPS).option("multiLine", True).json(path).select(F.col("district_id").alias("backup_of"), "applied_at", F.explode("records").alias("r")).select("backup_of", "applied_at", "r.*")


def district_file(spark: SparkSession, path: str) -> DataFrame:
    """Districts of a JSON object of category to list, in order: blank names are dropped, members become towns."""
    schema = ", ".join(f"{c} array<{SOURCE_DISTRICT}>" for c in CATEGORIES)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(kind).alias("kind"), F.coalesce(c, F.array().cast(f"array<{SOURCE_DISTRICT}>")).alias("list")) for k, (c, kind) in enumerate(CATEGORIES.items())])
    rows = raw.select(F.explode(parts).alias("p")).select("p.no", "p.kind", F.posexplode("p.list").alias("pos", "d"))
    name = F.trim("d.district")
    return rows.filter(name != "").select((F.col("no") * 1_000_000 + F.col("pos")).alias("pos"), name.alias("name"), F.coalesce("d.address", F.lit("")).alias("main_address"), F.coalesce("d.district_url", F.lit("")).alias("district_url"), F.coalesce(F.lower("d.type"), "kind").alias("district_type"), F.filter(F.transform(F.coalesce("d.members", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "").alias("towns"))


def mixed_items(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three kinds of items of one mixed table, told by the prefix of their sort key: districts, towns and schedules.

    The lines are JSON objects with PK and SK; other kinds are left out. One scan each: the
    prefix reaches the reader, and only the columns of a kind are parsed.
    """
    items = spark.read.schema("PK string, SK string, name string, district_type string, town_name string, school_year string, period string, education string, credits int, step int, salary double").json(path)
    district = F.substring_index("PK", "#", -1).alias("district_id")
    return {
        "districts": items.filter("SK = 'METADATA'").select(district, "name", "district_type"),
        "towns": items.filter(F.col("SK").startswith("TOWN#")).select(district, F.coalesce("town_name", F.substring_index("SK", "#", -1)).alias("town")),
        "cells": items.filter(F.col("SK").startswith("SCHEDULE#")).select(district, "school_year", "period", "education", "credits", "step", F.col("salary").cast("decimal(12,2)").alias("salary")),
    }


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files below a folder with their size and time; their content is not read."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    # many folders to a task, for otherwise each has one of its own
    spark.conf.set(tasks, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    finally:
        spark.conf.set(tasks, before)
    return found.select("path", "length", "modificationTime")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def ocr_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"Blocks array<struct<{', '.join(x.replace(' ', ':', 1) for x in OCR_BLOCKS.split(', '))}>>").option("multiLine", True).json(path).select(F.explode("Blocks").alias("b")).select("b.*")


def town_features(spark: SparkSession, path: str) -> DataFrame:
    """Town names of GeoJSON features; shapes are for display only."""
    return spark.read.schema("features array<struct<properties:struct<TOWN:string>>>").option("multiLine", True).json(path).select(F.explode("features.properties.TOWN").alias("town"))


def messages(bodies: DataFrame, schema: str = "job_id string, district_id string, s3_key string") -> DataFrame:
    """Fields of JSON message bodies; ``ok`` is false where a body can't be read."""
    return bodies.withColumn("m", F.from_json("body", schema)).select(*bodies.columns, "m.*", (F.col("m").isNotNull() & F.col("m.job_id").isNotNull()).alias("ok"))
