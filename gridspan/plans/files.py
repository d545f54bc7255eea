"""Queries that write what they read in the formats of the sources, and read it back: files, items, blocks, bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..session import scratch
from ..sources import readers, writers
from . import fixtures
from .fixtures import CELLS, DISTRICTS, read
from .queries import money, query


def _texts(rows, name: str) -> str:
    """A folder with a file for each row of one text column; tasks put their own files there."""
    place = scratch(rows.sparkSession, name)
    rows.write.options(**writers.MANY_FILES).option("maxRecordsPerFile", 1).text(place)
    return place


@query(f"""WITH {CELLS}, {DISTRICTS} SELECT 'district' AS kind, CAST(district_id AS VARCHAR) AS district_id, name || '|' || district_type AS text FROM districts
UNION ALL SELECT 'town', CAST(district_id AS VARCHAR), unnest(towns) FROM districts
UNION ALL SELECT 'cell', CAST(district_id AS VARCHAR), school_year || '|' || period || '|' || education || '|' || credits || '|' || step || '|' || CAST(CAST(salary * 100 AS BIGINT) AS VARCHAR) FROM cells""")
def mixed_items_read(spark, sf_dir):
    """All three kinds of items in one table of JSON lines, told apart by their keys when read."""
    cells, dim = fixtures.cells(spark, sf_dir), fixtures.districts(spark, sf_dir)
    key = F.concat(F.lit("DISTRICT#"), F.col("district_id").cast("string")).alias("PK")
    number = lambda c, w: F.lpad(F.col(c).cast("string"), w, "0")
    at = F.concat_ws("#", F.lit("SCHEDULE"), "school_year", "period", F.lit("EDU"), "education", F.lit("CR"), number("credits", 3), F.lit("STEP"), number("step", 2))
    lines = [
        dim.select(F.to_json(F.struct(key, F.lit("METADATA").alias("SK"), "name", "district_type")).alias("value")),
        dim.select("district_id", F.explode("towns").alias("t")).select(F.to_json(F.struct(key, F.concat(F.lit("TOWN#"), F.upper("t")).alias("SK"), F.col("t").alias("town_name"))).alias("value")),
        cells.select(F.to_json(F.struct(key, at.alias("SK"), "school_year", "period", "education", "credits", "step", F.col("salary").cast("double").alias("salary"))).alias("value")),
        spark.range(1).select(F.lit('{"PK": "METADATA#MAXVALUES", "SK": "GLOBAL", "step": 7}').alias("value")),
    ]
    place = scratch(spark, "items")
    for part in lines:
        part.write.mode("append").text(place)
    items = readers.mixed_items(spark, place)
    of = lambda kind, rows, *columns: rows.select(F.lit(kind).alias("kind"), "district_id", F.concat_ws("|", *columns).alias("text"))
    whole = (F.col("salary") * 100).cast("long").cast("string")
    return of("district", items["districts"], "name", "district_type").unionByName(of("town", items["towns"], "town")).unionByName(of("cell", items["cells"], "school_year", "period", "education", F.col("credits").cast("string"), F.col("step").cast("string"), whole))


@query(f"WITH {CELLS} SELECT CAST(district_id AS VARCHAR) AS district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells")
def record_files(spark, sf_dir):
    """A JSON file of records for each district."""
    record = F.struct(F.col("district_id").cast("string").alias("district_id"), F.lit("x").alias("district_name"), "school_year", "period", "education", "credits", "step", F.col("salary").cast("double").alias("salary"))
    lines = fixtures.cells(spark, sf_dir).select("district_id", F.to_json(record).alias("r"))
    files = lines.groupBy("district_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).select("value")
    return readers.records(spark, _texts(files, "records")).drop("district_name").withColumn("salary", money())


@query(f"WITH {DISTRICTS} SELECT name, district_type, array_to_string(towns, ',') AS towns FROM districts")
def district_files(spark, sf_dir):
    """Files of some districts each, by category; members have blanks around them and blank ones among them."""
    dim = fixtures.districts(spark, sf_dir)
    entry = F.struct(F.concat(F.lit(" "), "name").alias("district"), F.concat(F.transform("towns", lambda t: F.concat(t, F.lit(" "))), F.array(F.lit(" "))).alias("members"), F.lit("1 Street").alias("address"))
    lists = {kind: F.collect_list(F.when(F.col("district_type") == kind, entry)).alias(kind) for kind in readers.CATEGORIES.values()}
    files = dim.groupBy(F.floor(F.col("district_id") / 20)).agg(F.to_json(F.struct(*lists.values())).alias("value")).select("value")
    return readers.district_file(spark, _texts(files, "districts")).select("name", "district_type", F.concat_ws(",", "towns").alias("towns"))


@query("SELECT c_name AS town FROM customer")
def town_feature_files(spark, sf_dir):
    """A file of map features for each nation."""
    features = F.collect_list(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_name").alias("TOWN")).alias("properties")))
    files = read(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500)).agg(F.to_json(F.struct(features.alias("features"))).alias("value")).select("value")
    return readers.town_features(spark, _texts(files, "features"))


@query(f"WITH {CELLS} SELECT 'd' || district_id AS folder, 1 AS files, true AS filled FROM cells GROUP BY district_id")
def listed_files(spark, sf_dir):
    """Backups, a folder for each district, by a listing that reads none of them."""
    place = scratch(spark, "backups")
    named = fixtures.cells(spark, sf_dir).withColumns({"district_name": F.concat(F.lit("d"), F.col("district_id").cast("string")), "district_id": F.col("district_id").cast("string")})
    writers.write_backups(named, place, "2024-01-01", mode="error")
    listed = readers.listing(spark, place, ".json").withColumn("folder", F.regexp_extract("path", "/folder=([^/]+)/", 1))
    return listed.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("files"), (F.min("length") > 0).alias("filled"))


_COLUMN = "CASE education WHEN 'B' THEN 0 WHEN 'M' THEN 9 ELSE 18 END + credits {div} 5 + 2"


@query(f"""WITH {CELLS}, t AS (SELECT *, count(*) OVER (PARTITION BY district_id, school_year, period) AS n FROM cells)
SELECT district_id || '#' || school_year || '#' || period AS table_id, CAST(step AS INTEGER) AS row_no, CAST({_COLUMN.format(div='//')} AS INTEGER) AS col_no, '$ ' || CAST(CAST(salary * 100 AS BIGINT) AS VARCHAR) AS text FROM t WHERE n >= 10""")
def block_tables(spark, sf_dir):
    """A table of recognised blocks for each schedule: a cell's words in reverse order of their blocks, put in order by the relationships; small tables are dropped."""
    cells = fixtures.cells(spark, sf_dir).select(F.concat_ws("#", F.col("district_id").cast("string"), "school_year", "period").alias("t"), F.col("step").alias("RowIndex"), F.expr(_COLUMN.format(div="div")).cast("int").alias("ColumnIndex"), (F.col("salary") * 100).cast("long").cast("string").alias("v"))
    cells = cells.withColumn("c", F.concat_ws("#", "t", F.col("RowIndex").cast("string"), F.col("ColumnIndex").cast("string")))
    word = lambda k: F.concat("c", F.lit(f"w{k}"))
    children = lambda ids: F.array(F.struct(F.lit("CHILD").alias("Type"), ids.alias("Ids")))
    none = F.lit(None).cast("array<struct<Type:string,Ids:array<string>>>")
    no = F.lit(None).cast("int")
    block = lambda id_, kind, row, column, text, related: F.struct(id_.alias("Id"), F.lit(kind).alias("BlockType"), row.alias("RowIndex"), column.alias("ColumnIndex"), text.alias("Text"), related.alias("Relationships"))
    nil = F.lit(None).cast("string")
    own = F.array(block(word(1), "WORD", no, no, F.col("v"), none), block(word(0), "WORD", no, no, F.lit("$"), none), block(F.col("c"), "CELL", F.col("RowIndex"), F.col("ColumnIndex"), nil, children(F.array(word(0), word(1)))))
    heads = cells.groupBy("t").agg(F.collect_list("c").alias("ids")).select(block(F.col("t"), "TABLE", no, no, nil, children(F.col("ids"))).alias("b"))
    rows = tables.block_grids(cells.select(F.explode(own).alias("b")).unionByName(heads).select("b.*"))
    # rows without a cell are not in the grid: a row's number is its place among the steps that its table has; whole tables are joined, not their cells
    steps = cells.groupBy("t").agg(F.array_sort(F.collect_set("RowIndex")).alias("steps"))
    lines = rows.join(steps, F.col("table_id") == F.col("t")).select("table_id", "steps", F.posexplode("rows").alias("r", "row"))
    at = lines.select("table_id", F.get("steps", F.col("r")).alias("row_no"), F.posexplode("row").alias("k", "text")).filter("text <> ''")
    return at.select("table_id", "row_no", (F.col("k") + 1).cast("int").alias("col_no"), "text")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN 'j' || o_custkey END AS job_id, CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_custkey % 50 AS VARCHAR) WHEN o_orderkey % 4 = 1 THEN 'x' END AS district_id, o_orderkey % 4 > 1 AS ok FROM orders""")
def queue_bodies(spark, sf_dir):
    """Bodies of messages: whole ones, ones without a job, and broken ones."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    body = F.when(k == 0, F.concat(F.lit('{"job_id": "'), c.cast("string"))).when(k == 1, F.lit('{"district_id": "x", "other": 1}')).otherwise(F.to_json(F.struct(F.concat(F.lit("j"), c.cast("string")).alias("job_id"), (c % 50).cast("string").alias("district_id"))))
    return readers.messages(read(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))).select("o_orderkey", "job_id", "district_id", "ok")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (year(o_orderdate) + 20) || '-' || (year(o_orderdate) + 21) ELSE '20' || lpad(CAST(o_custkey % 90 + 5 AS VARCHAR), 2, '0') || '-20' || lpad(CAST(o_custkey % 90 + 6 AS VARCHAR), 2, '0') END AS year FROM orders")
def table_years(spark, sf_dir):
    """The year in a table's first cell, where there is one, before its page's; a step is none."""
    k, y, p = F.col("o_orderkey") % 3, F.year("o_orderdate") + 20, F.col("o_custkey") % 90 + 5
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    cell = F.when(k == 0, F.concat(F.lit("Effective July 1, "), y.cast("string"))).when(k == 1, two(F.col("o_custkey") % 30)).otherwise("STEP")
    page = F.concat(F.lit("20"), two(p), F.lit("-20"), two(p + 1))
    return read(spark, sf_dir, "orders").select("o_orderkey", tables.table_year(cell, page).alias("year"))
