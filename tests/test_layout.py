"""Stored tables: plans without a shuffle, results as over the tables they were made from, places in order."""

import random

import pytest
from pyspark.sql import functions as F

from gridspan.operators import cells as grid
from gridspan.operators import compare, districts, fill, ranking
from gridspan.plans import fixtures
from gridspan.sources import layout

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above_scan(plan: str, table: str) -> list[str]:
    """The nodes of a plan above the scan of a table, nearest first: those that stand less far in."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and table in x)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth:
            found.append(line.strip(" :+-"))
            depth = own
    return found


def stored(spark):
    return fixtures.cells(spark, SF), fixtures.districts(spark, SF)


def test_stored_tables_hold_what_they_were_made_from(spark):
    cells, dim = stored(spark)
    made = fixtures.cells_of_lines(spark, SF)
    assert cells.columns == made.columns and cells.exceptAll(made).isEmpty() and made.exceptAll(cells).isEmpty()
    assert sorted(map(repr, dim.collect())) == sorted(map(repr, fixtures.districts_of_suppliers(spark, SF).select(dim.columns).collect()))


@pytest.mark.parametrize("make", [grid.nested_schedules, grid.district_metadata, grid.availability, lambda c: fill.fill_down(c, 7, dealt=True), lambda c: fill.fill_grid(c, 7, {"B": [0, 15], "M": [30]}, dealt=True)])
def test_groups_by_district_need_no_exchange(spark, make):
    plan = plan_of(make(stored(spark)[0]))
    assert "Bucketed: true" in plan and "Exchange" not in plan, plan
    assert "Exchange" in plan_of(make(fixtures.cells_of_lines(spark, SF)))


def test_compare_needs_no_exchange_up_to_the_ranking(spark, monkeypatch):
    """What is ranked comes straight from the two scans, joined where they lie, and the filter reaches the scan."""
    seen = []
    monkeypatch.setattr(compare, "numbered", lambda rows, *order: seen.append(rows) or rows.withColumn("rank", F.lit(1)))
    cells, dim = stored(spark)
    compare.compare(cells, dim, "M", 30, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(seen[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
    assert "EqualTo(education,M)" in plan
    assert not any("Exchange" in x for x in above_scan(plan, "cells_"))


def test_a_year_is_a_folder_and_a_district_a_bucket(spark):
    cells = stored(spark)[0]
    assert "PartitionFilters: [isnotnull(school_year" in plan_of(cells.filter("school_year = '1997-1998'"))
    plan = plan_of(grid.schedule_of(cells, 7, "1998"))
    assert "StartsWith(school_year" in plan and "EqualTo(district_id,7)" in plan
    assert "SelectedBucketsCount: 1 out of 8" in plan_of(grid.nested_schedules(grid.schedule_of(cells, 7)))


def test_tables_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-2021", "Full Year", "B", 0, 1, 5)], "district_id long, school_year string, period string, education string, credits int, step int, salary int")
    rows.write.parquet(str(tmp_path / "in"))
    made = []

    def make(name, buckets):
        made.append(buckets)
        return layout.store_cells(spark.read.parquet(str(tmp_path / "in")), name, buckets)

    for _ in range(2):
        assert layout.stored_once(spark, "some", [str(tmp_path / "in")], make).count() == 1
    rows.withColumn("step", F.lit(2)).write.mode("append").parquet(str(tmp_path / "in"))
    assert layout.stored_once(spark, "some", [str(tmp_path / "in")], make).count() == 2 and made == [8, 8]
    found = layout.stored_once(spark, "some", [str(tmp_path / "in")], make)
    place = spark._jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0]).getParent().getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    assert layout.stored_once(spark, "some", [str(tmp_path / "in")], make).count() == 2 and made == [8, 8, 8]
    assert [layout.bucket_number(n) for n in (0, 1 << 30, 1 << 50)] == [8, 16, 8192]


def test_buckets_of_cells_stay_small_and_are_dealt_once(spark):
    """A bucket holds a bounded part of the lines, and they are grouped where they are dealt."""
    assert [layout.bucket_number(n, fixtures.LINE_BYTES) for n in (10 << 20, 640 << 20, 3840 << 20)] == [8, 80, 480]
    plan = plan_of(fixtures.cells_of_lines(spark, SF, 8).repartition(8, "district_id").sortWithinPartitions("education"))
    assert plan.count("Exchange") == 1 and "hashpartitioning(district_id" in plan, plan


@pytest.mark.parametrize("one_task", [0, 1 << 30])
def test_numbers_follow_the_order(spark, monkeypatch, one_task):
    monkeypatch.setattr(ranking, "ONE_TASK", one_task)
    rng = random.Random(0)
    rows = [(rng.randrange(10**6), f"n{i}", rng.choice([None, "a", "b"])) for i in range(5000)]
    got = ranking.numbered(spark.createDataFrame(rows, "v long, name string, k string").repartition(7), F.col("k").desc(), F.col("v"), "name", kind="long").collect()
    want = sorted(rows, key=lambda r: ({"b": 0, "a": 1, None: 2}[r[2]], r[0], r[1]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got) == list(range(1, 5001))
    assert ranking.numbered(spark.createDataFrame([], "v long"), "v").count() == 0


def test_no_task_ranks_all_districts(spark, monkeypatch):
    """With as many districts as rows, more than one task is to take, ranges of them stand in several files and are numbered there."""
    monkeypatch.setattr(ranking, "ONE_TASK", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        n = 20_000
        cells = spark.range(n).select(F.col("id").alias("district_id"), F.lit("2020-2021").alias("school_year"), F.lit("Full Year").alias("period"), F.lit("M").alias("education"), F.lit(30).alias("credits"), F.lit(5).alias("step"), (F.col("id") * 7919 % n + 30_000).cast("decimal(12,2)").alias("salary"))
        dim = cells.select("district_id", F.col("district_id").cast("string").alias("name"), F.lit("municipal").alias("district_type"), F.array().cast("array<string>").alias("towns"))
        ranked = compare.compare(cells, dim, "M", 30, 5)
        held = ranked.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(held) == 4 and max(r.n for r in held) < 0.6 * n and all(r.last - r.first + 1 == r.n for r in held)
    top = ranked.orderBy("rank").limit(3).collect()
    assert [int(r.salary) for r in top] == [n + 29_999, n + 29_998, n + 29_997]


def test_reranked_closes_up(spark):
    rows = spark.createDataFrame([(r, f"d{r}") for r in (2, 3, 7, 40)], "rank int, name string")
    assert sorted((r.rank, r.name) for r in districts.reranked(rows).collect()) == [(1, "d2"), (2, "d3"), (3, "d7"), (4, "d40")]


def test_written_tables_go_when_told_to(spark):
    from gridspan.session import drop_scratch

    cells, dim = stored(spark)
    before = compare.compare(cells, dim, "M", 30, 5).count()
    assert drop_scratch(spark) >= 3 and drop_scratch(spark) == 0
    assert compare.compare(*stored(spark), "M", 30, 5).count() == before > 0


def test_tables_of_blocks_are_brought_together_once(spark):
    """Blocks are joined by their ids; a table's size and rows come from one grouping of its cells."""
    from gridspan.operators import tables
    from gridspan.schemas import OCR_BLOCKS

    blocks = spark.createDataFrame([], ", ".join(x.replace(":", " ", 1) for x in OCR_BLOCKS.split(", ")))
    plan = tables.block_grids(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in x for x in plan.split("\n")) == 3, plan


def test_fill_of_missing_lanes_is_that_of_the_grid_without_lanes_there(spark):
    cells, lane = stored(spark)[0], ["district_id", "school_year", "period", "education", "credits"]
    every = fill.fill_grid(cells, *fill.combos_of(cells), dealt=True).join(cells.select(*lane).distinct(), lane, "left_anti")
    missing = fill.fill_missing(cells, *fill.combos_of(cells), dealt=True)
    assert sorted(map(repr, missing.collect())) == sorted(map(repr, every.select(missing.columns).collect()))
    assert "Join" not in plan_of(missing)


def test_many_small_files_are_written_by_their_tasks_and_listed_by_few(spark, tmp_path):
    from gridspan.sources import readers, writers

    rows = fixtures.cells(spark, SF).withColumn("district_name", F.concat(F.lit("d"), "district_id"))
    writers.write_backups(rows, str(tmp_path / "new"), "2024-01-01", mode="error")
    name, before = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert readers.listing(spark, str(tmp_path / "new"), ".json").count() == rows.select("district_id").distinct().count()
    assert spark.conf.get(name) == before and (tmp_path / "new/_SUCCESS").exists()
