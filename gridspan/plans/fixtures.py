"""The model's tables from the star schema of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.layout import bucket_number, mark_of, store_cells, store_districts, stored_once

#: Names of an interim town list: customers of the district's nation, so many a district.
TOWNS = 6
#: Bytes of ``lineitem`` to a bucket of cells. They are some 450 000 lines, which a task groups in some hundred megabytes.
LINE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as they are stored: made from ``lineitem`` once, then read by key."""
    n = buckets(spark, sf_dir)
    found = stored_once(spark, "cells", [f"{sf_dir}/lineitem.parquet"], lambda name, _: store_cells(cells_of_lines(spark, sf_dir, n), name, n))
    return found.select("district_id", "school_year", "period", "education", "credits", "step", "salary")


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Into how many buckets districts and their cells are dealt."""
    return bucket_number(mark_of(spark, f"{sf_dir}/lineitem.parquet")[1], LINE_BYTES)


def cells_of_lines(spark: SparkSession, sf_dir: str, dealt: int = 0) -> DataFrame:
    """One real cell per district, school year, period, lane and step; lines may be ``dealt`` into so many buckets by district first, where they are then grouped without another shuffle."""
    line = read(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate") - F.when(F.month("l_shipdate") >= 7, 0).otherwise(1)
    lines = line.select(
        F.col("l_suppkey").alias("district_id"),
        F.concat_ws("-", year.cast("string"), (year + 1).cast("string")).alias("school_year"),
        F.when(F.col("l_linestatus") == "F", "Full Year").otherwise("10-month").alias("period"),
        F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "N", "M").otherwise("D").alias("education"),
        (F.round(F.col("l_tax") * 100).cast("int") * 5).alias("credits"),
        F.col("l_linenumber").cast("int").alias("step"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("salary"),
    )
    lines = lines.repartition(dealt, "district_id") if dealt else lines
    return lines.groupBy("district_id", "school_year", "period", "education", "credits", "step").agg(F.max("salary").alias("salary"))


CELLS = """
cells AS (
  SELECT l_suppkey AS district_id,
    CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) >= 7 THEN 0 ELSE 1 END AS VARCHAR) || '-' || CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 7 THEN 1 ELSE 0 END AS VARCHAR) AS school_year,
    CASE l_linestatus WHEN 'F' THEN 'Full Year' ELSE '10-month' END AS period,
    CASE l_returnflag WHEN 'A' THEN 'B' WHEN 'N' THEN 'M' ELSE 'D' END AS education,
    CAST(round(l_tax * 100) AS INTEGER) * 5 AS credits, CAST(l_linenumber AS INTEGER) AS step,
    max(CAST(l_extendedprice AS DECIMAL(12,2))) AS salary
  FROM lineitem GROUP BY ALL
)"""


#: A fifth of the lanes, so that whole educations are missing: for tests of the fill's rarer rules.
SPARSE = "(district_id * 7 + credits div 5 * 3 + ascii(education) + CAST(substr(school_year, 1, 4) AS INTEGER)) % 5 < 1"


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The districts as they are stored, dealt as the cells are."""
    made = lambda name, _: store_districts(districts_of_suppliers(spark, sf_dir), name, buckets(spark, sf_dir))
    return stored_once(spark, "districts", [f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation", "customer")], made).select("district_id", "name", "district_type", "towns")


def districts_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District dimension: a supplier with the first customers, by name, of its nation as towns."""
    nation = read(spark, sf_dir, "nation")
    kinds = F.element_at(F.array(*map(F.lit, ("municipal", "regional_academic", "regional_vocational", "county_agricultural", "charter"))), F.col("n_regionkey") + 1)
    # the first names of each nation: the limit goes to the partial sort, so that no task holds all customers of one
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name"))
    first = read(spark, sf_dir, "customer").select("c_nationkey", "c_name").withColumn("n", place).filter(F.col("n") <= 4 * TOWNS)
    customers = first.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    return (
        read(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(customers, F.col("s_nationkey") == F.col("c_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("district_id"),
            F.col("s_name").alias("name"),
            kinds.alias("district_type"),
            F.coalesce(F.slice("names", (F.col("s_suppkey") % 4).cast("int") * TOWNS + 1, TOWNS), F.array().cast("array<string>")).alias("towns"),
        )
    )


DISTRICTS = f"""
districts AS (
  SELECT s_suppkey AS district_id, s_name AS name,
    CASE n_regionkey WHEN 0 THEN 'municipal' WHEN 1 THEN 'regional_academic' WHEN 2 THEN 'regional_vocational' WHEN 3 THEN 'county_agricultural' ELSE 'charter' END AS district_type,
    coalesce(list_slice(names, (s_suppkey % 4) * {TOWNS} + 1, (s_suppkey % 4) * {TOWNS} + {TOWNS}), []) AS towns
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT c_nationkey, list_slice(list_sort(list(c_name)), 1, {4 * TOWNS}) AS names FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: client, route class and time."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_type").alias("route_class"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of jobs, in order of ``seq``."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").otherwise("pending")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("succeeded"), (F.col("event_type") == "error").cast("int").alias("failed"))


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with when they were sent and, of some, when their work ended: so many minutes later as their value says."""
    minutes = F.floor(F.col("value") * 7 % 60)
    sent = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), sent.alias("sent"), F.when(F.col("event_type") != "error", F.timestamp_micros(F.unix_micros(sent) + minutes * 60_000_000)).alias("done"))


JOB_EVENTS = """
job_events AS (
  SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'pending' END AS status, ts,
    CAST(event_type = 'purchase' AS INTEGER) AS succeeded, CAST(event_type = 'error' AS INTEGER) AS failed
  FROM events
)"""
