"""Documents as a data source and parsers as table functions."""

import os

from pyspark.sql import functions as F

from gridspan.operators import parsing
from gridspan.sources import documents

GRID = "Step BA MA\n1 $40,000 $45,000\n2 $41,000 $46,000\n"


def folder(tmp_path, names, text="x"):
    for name in names:
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else f"{text} {name}".encode())
    return str(tmp_path / "in")


def test_a_folder_is_a_table(spark, tmp_path):
    place = folder(tmp_path, ["a.txt", "b/c.txt", "d.md", "_hidden.txt", ".x/e.txt"])
    folder(tmp_path, ["bad.txt"], b"\xff\xfe\x00")
    documents.register(spark)
    rows = {os.path.relpath(r.path, place): r for r in spark.read.format("documents").option("path", place).load().collect()}
    assert sorted(rows) == ["a.txt", "b/c.txt", "bad.txt", "d.md"] and rows["b/c.txt"].text == "x b/c.txt" and rows["a.txt"].size == 7
    assert rows["bad.txt"].text is None and rows["bad.txt"].problem.startswith("UnicodeDecodeError")
    assert all(r.problem is None for n, r in rows.items() if n != "bad.txt")
    assert spark.read.format("documents").option("path", str(tmp_path / "none")).load().count() == 0


def test_files_are_dealt_by_size(spark, tmp_path):
    place = folder(tmp_path, [f"{i}.txt" for i in range(9)])
    df = spark.read.format("documents").option("path", place).option("partitionBytes", 16).load()
    assert df.rdd.getNumPartitions() == 5 and df.count() == 9
    assert [[f.size for f in p.files] for p in documents.dealt([documents.File(str(i), n, 0) for i, n in enumerate((5, 50, 5, 5, 0, 6))], 10)] == [[5], [50], [5, 5, 0], [6]]


def test_a_filter_on_the_path_opens_no_other_file(spark, tmp_path):
    place = folder(tmp_path, ["a.txt", "b.md", "c.txt"])
    rows = documents._Table(place, 100)
    left = list(rows.pushFilters([documents.StringEndsWith(("path",), ".txt"), documents.EqualTo(("size",), 7)]))
    assert [f.attribute for f in left] == [("size",)]
    assert sorted(os.path.basename(f.path) for p in rows.partitions() for f in p.files) == ["a.txt", "c.txt"]
    documents.register(spark)
    got = spark.read.format("documents").option("path", place).load().filter(F.col("path").endswith(".md") & (F.col("size") > 0))
    assert [os.path.basename(r.path) for r in got.collect()] == ["b.md"]


def test_a_stream_goes_on_behind_its_offset(spark, tmp_path):
    documents.register(spark)

    def run():
        stream = spark.readStream.format("documents").option("path", str(tmp_path / "in")).option("maxFilesPerTrigger", 2).load()
        query = stream.select("path", "text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    folder(tmp_path, ["a", "b", "c"])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    folder(tmp_path, ["d", "e/f"])
    assert run() == ["a", "b", "c", "d", "f"]


def test_parsers_in_sql(spark):
    """Lateral joins with the parsers give the rows that the operator gives; a failing document is one row."""
    docs = spark.createDataFrame([(1, GRID), (2, "nothing"), (3, "CORRUPT"), (4, None), (5, GRID.replace("BA", "Other"))], "doc_id long, text string")

    def careful(text):
        if text == "CORRUPT":
            raise ValueError("no text layer")
        return parsing.grid_of(text)

    parsing.register_functions(spark, careful=careful)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT doc_id, lane, step, salary, pos, error FROM some_docs, LATERAL careful(text)").collect()
    want = [r for r in parsing.parse_each(docs, careful).select("doc_id", "lane", "step", "salary", "pos", "error").collect() if r.lane is not None or r.error]
    assert sorted((r.doc_id, r.lane or "", r.step or 0, r.salary or 0, r.error or "") for r in got) == sorted((r.doc_id, r.lane or "", r.step or 0, r.salary or 0, r.error or "") for r in want)
    assert [r.error for r in got if r.doc_id == 3] == ["ValueError: no text layer"]
    total = spark.sql("SELECT doc_id, count(lane) AS n FROM some_docs LEFT JOIN LATERAL pasted_grid(text) ON true GROUP BY doc_id").collect()
    assert {r.doc_id: r.n for r in total} == {1: 4, 2: 0, 3: 0, 4: 0, 5: 2}
