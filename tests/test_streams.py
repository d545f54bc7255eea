"""Streams against their batch forms, readers and writers in files."""

import json

from pyspark.sql import functions as F

from gridspan.plans import fixtures
from gridspan.sources import readers, writers
from gridspan.streaming import jobs, windows

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, rows, make, mode, name):
    place = str(tmp_path / name)
    rows.repartition(3).write.parquet(place)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    ended = query.awaitTermination(60)
    query.stop()
    assert ended
    return spark.table(name)


def test_windows_equal_their_batch_form(spark, tmp_path):
    rows = fixtures.requests(spark, SF)
    got = streamed(spark, tmp_path, rows, lambda d: windows.tumbling(d, "1 day", ["route_class"]), "complete", "tumbling_stream")
    want = windows.tumbling(rows, "1 day", ["route_class"])
    key = lambda d: sorted((r.window_start, r.route_class, r.n) for r in d.collect())
    assert key(got) == key(want)


def test_rate_windows_in_append_mode_end(spark, tmp_path):
    rows = fixtures.requests(spark, SF)
    got = streamed(spark, tmp_path, rows, lambda d: windows.rate_windows(d, late="1 hour"), "append", "rate_stream")
    assert 0 < got.count() <= windows.rate_windows(rows).count()


def test_first_seen(spark, tmp_path):
    rows = fixtures.requests(spark, SF)
    got = streamed(spark, tmp_path, rows, lambda d: windows.first_seen(d, ["client", "route_class"], "400 days"), "append", "dedup_stream")
    assert got.count() == rows.select("client", "route_class").distinct().count()


def test_live_state_counts_all_events(spark, tmp_path):
    rows = fixtures.job_events(spark, SF)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        got = streamed(spark, tmp_path, rows, lambda d: jobs.live_state(d), "update", "state_stream")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    most = {r.job_id: r.m for r in got.groupBy("job_id").agg(F.max("processed").alias("m")).collect()}
    assert most == {r.job_id: r["count"] for r in rows.groupBy("job_id").count().collect()}
    last = {r.job_id: r.status for r in got.groupBy("job_id").agg(F.max_by("status", "processed").alias("status")).collect()}
    assert last == {r.job_id: r.status for r in jobs.latest(rows).collect()}


def test_queue_puts_bad_messages_aside(spark, tmp_path):
    bodies = spark.createDataFrame([('{"job_id": "1"}',), ("nonsense",)], "body string")
    bodies.write.parquet(str(tmp_path / "in"))
    stream = readers.messages(spark.readStream.schema("body string").parquet(str(tmp_path / "in")))
    jobs.run_queue(stream, lambda d: d, str(tmp_path / "done"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "done")).count() == 1
    assert spark.read.parquet(str(tmp_path / "dead")).first().body == "nonsense"


def test_queue_tries_three_times(spark, tmp_path):
    """A message that fails twice is done in the end, one that always fails is dead after three attempts, others are not held up."""
    spark.createDataFrame([(f'{{"job_id": "{i}"}}',) for i in range(4)], "body string").write.parquet(str(tmp_path / "in"))
    stream = readers.messages(spark.readStream.schema("body string").parquet(str(tmp_path / "in")))
    calls = []

    def work(rows):
        calls.append(rows.count())
        failing = (F.col("job_id") == "3") | (F.col("job_id") == "2") & F.lit(len(calls) < 3)
        return rows.withColumn("error", F.when(failing, "no text"))

    jobs.run_queue(stream, work, str(tmp_path / "done"), str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination(60)
    assert calls == [4, 2, 2]
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["0", "1", "2"]
    assert [(r.job_id, r.error, r.attempts) for r in spark.read.option("mergeSchema", True).parquet(str(tmp_path / "dead")).filter("ok").collect()] == [("3", "no text", 3)]


def test_cache(spark):
    now = [0.0]
    cache = jobs.TimedCache(spark, 60, lambda: now[0])
    a = cache.get("d1#2022", lambda: spark.range(3))
    assert cache.get("d1#2022", lambda: spark.range(4)) is a
    now[0] = 61
    assert cache.get("d1#2022", lambda: spark.range(4)).count() == 4
    assert cache.drop("d1#") == 1


def test_files(spark, tmp_path):
    (tmp_path / "districts.json").write_text(json.dumps({"municipal": [{"district": " A ", "members": ["X ", ""], "address": "1"}, {"district": " "}], "charter": [{"district": "B", "members": []}]}))
    rows = {r.name: (r.district_type, r.towns) for r in readers.district_file(spark, str(tmp_path / "districts.json")).collect()}
    assert rows == {"A": ("municipal", ["X"]), "B": ("charter", [])}
    cells = fixtures.cells(spark, SF).filter("district_id < 2").withColumns({"district_id": F.col("district_id").cast("string"), "district_name": F.concat(F.lit("n"), F.col("district_id").cast("string"))})
    writers.write_cells(cells, str(tmp_path / "cells"))
    writers.replace_partitions(cells.filter("school_year = '1998-1999' AND district_id = '1'").select(spark.read.parquet(str(tmp_path / "cells")).columns), str(tmp_path / "cells"))
    after = spark.read.parquet(str(tmp_path / "cells"))
    assert after.filter("school_year = '1998-1999'").select("district_id").distinct().count() <= 1
    assert after.filter("school_year <> '1998-1999'").count() == cells.filter("school_year <> '1998-1999'").count()
    writers.write_backups(cells, str(tmp_path / "backups"), "2024-01-01")
    assert readers.backups(spark, str(tmp_path / "backups")).count() == cells.count()
    listed = readers.listing(spark, str(tmp_path / "backups"), ".json").collect()
    on_disk = {str(p): p.stat().st_size for p in (tmp_path / "backups").rglob("*.json") if not p.name.startswith((".", "_"))}
    assert {r.path.removeprefix("file:"): r.length for r in listed} == on_disk and on_disk
    assert readers.listing(spark, str(tmp_path / "backups"), ".pdf").count() == 0
    assert readers.texts(spark, str(tmp_path / "districts.json")).count() == 1


def test_mixed_items_and_features(spark, tmp_path):
    lines = [{"PK": "DISTRICT#7", "SK": "METADATA", "name": "A", "district_type": "charter"}, {"PK": "DISTRICT#7", "SK": "TOWN#X", "town_name": "X"}, {"PK": "DISTRICT#7", "SK": "SCHEDULE#2020-2021#Full Year#EDU#B#CR#000#STEP#01", "school_year": "2020-2021", "period": "Full Year", "education": "B", "credits": 0, "step": 1, "salary": 50000.5}, {"PK": "METADATA#MAX", "SK": "GLOBAL"}]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, lines)))
    items = readers.mixed_items(spark, str(tmp_path / "items.json"))
    assert [tuple(r) for r in items["districts"].collect()] == [("7", "A", "charter")] and [tuple(r) for r in items["towns"].collect()] == [("7", "X")]
    assert float(items["cells"].first().salary) == 50000.5 and items["cells"].count() == 1
    (tmp_path / "towns.json").write_text(json.dumps({"features": [{"properties": {"TOWN": t}} for t in "XY"]}))
    assert [r.town for r in readers.town_features(spark, str(tmp_path / "towns.json")).collect()] == ["X", "Y"]
    (tmp_path / "records.json").write_text(json.dumps([{"district_id": "7", "step": 3, "salary": 40000.129}]))
    assert str(readers.records(spark, str(tmp_path / "records.json")).first().salary) == "40000.13"
