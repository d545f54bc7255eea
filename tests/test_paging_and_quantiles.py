"""Pages by key against whole sorts, medians against sorted lists."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridspan.operators import paging, quantiles
from gridspan.operators.paging import Key
from tests.test_layout import plan_of

ROWS = "name string, price decimal(8,2), day date, id long"


def table(spark, n=157):
    rng = random.Random(n)
    return [(rng.choice([None, "a", "b", "é'\"", ""]), rng.choice([None, Decimal("1.50"), Decimal("-2.00"), Decimal("30000.25")]), None, i) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("falls", [(False, False), (True, False), (False, True), (True, True)])
def test_pages_together_are_the_whole(spark, falls):
    rows = spark.createDataFrame(table(spark), ROWS).withColumn("day", F.date_add(F.lit("2024-01-01"), (F.col("id") % 3).cast("int")))
    keys = [Key("name", falls[0]), Key("price", falls[1]), Key("day"), Key("id")]
    whole = rows.orderBy(*[k.order() for k in keys]).collect()
    got, token = [], None
    for _ in range(20):
        found, token = paging.page_and_token(rows, keys, 10, token)
        got += found
        if token is None:
            break
    assert got == whole and len(got) == 157


def test_a_page_is_a_range_and_not_an_offset(spark, tmp_path):
    spark.createDataFrame(table(spark), ROWS).write.parquet(str(tmp_path / "t"))
    rows, keys = spark.read.parquet(str(tmp_path / "t")), [Key("id"), Key("name")]
    _, token = paging.page_and_token(rows, keys, 10)
    plan = plan_of(paging.page(rows, keys, 10, token))
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(id," in plan and "offset" not in plan.lower()


def test_rows_that_come_and_go_before_a_page_move_none(spark):
    rows = [(f"n{i:03}", i) for i in range(40)]
    keys = [Key("name"), Key("id")]
    frame = lambda r: spark.createDataFrame(r, "name string, id long")
    _, token = paging.page_and_token(frame(rows), keys, 10)
    later, _ = paging.page_and_token(frame([("a", 99), *rows[5:]]), keys, 10, token)
    assert [r.id for r in later] == list(range(10, 20))


def test_bad_tokens(spark):
    rows, keys = spark.range(3).withColumn("name", F.lit("a")), [Key("name"), Key("id")]
    for bad in ("", "%%", "bm90IGpzb24=", paging.token_of(rows.first(), keys[:1]), "e30="):
        with pytest.raises(ValueError):
            paging.page(rows, keys, 2, bad)
    assert paging.page_and_token(rows.limit(0), keys, 2) == ([], None)


@pytest.mark.parametrize("bits", [2, 5, 10])
def test_selection_by_counting(spark, bits):
    rng = random.Random(bits)
    rows = [(g, rng.choice([rng.randint(-5, 5), rng.randint(-(10**9), 10**9), 7, None])) for g in (None, "a", "b", "c") for _ in range(rng.choice([1, 2, 60, 301]))] + [("one", 5), ("same", 9), ("same", 9), ("none", None)]
    got = quantiles.selected(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], "v", F.array(F.lit(0), F.floor(F.col("n") / 3), F.col("n") - 1), bits).collect()
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {(g, k): sorted(v)[k] for g, v in groups.items() for k in {0, len(v) // 3, len(v) - 1}}
    assert {(r.g, r.rank): r.value for r in got} == want and len(got) == len(want)


def test_medians(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(5), Decimal(rng.randrange(2_000_000, 20_000_000)) / 100) for _ in range(4000)] + [(9, Decimal("1.01")), (9, Decimal("1.02")), (10, None)]
    frame = spark.createDataFrame(rows, "g int, v decimal(12,2)")
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(float(v))
    got = {r.g: r.median for r in quantiles.exact_medians(frame, ["g"], "v").collect()}
    assert got == pytest.approx({g: statistics.median(v) for g, v in groups.items()})
    assert quantiles.exact_medians(frame.limit(0), ["g"], "v").count() == 0
    parts = quantiles.median_sketches(frame.withColumn("p", F.spark_partition_id()), ["g", "p"], "v")
    for r in quantiles.merged_medians(parts, ["g"]).filter("n > 100").collect():
        below = sum(v < r.median for v in groups[r.g]) / len(groups[r.g])
        assert r.n == len(groups[r.g]) and abs(below - 0.5) <= quantiles.RANK_ERROR + 1 / r.n


def test_a_round_keeps_counts_and_not_values(spark):
    """One group of many different values: no row that is shuffled stands for a value, only for a digit."""
    rows = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 1_000_003).alias("v"))
    found = quantiles.selected(rows, ["g"], "v", F.array(F.floor(F.col("n") / 2)))
    values = sorted(i * 7919 % 1_000_003 for i in range(200_000))
    assert found.first().value == values[100_000]
    assert "percentile" not in plan_of(found) and "collect_list" not in plan_of(found)
