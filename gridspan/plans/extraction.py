"""Queries over made texts, labels, records and jobs, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, lanes, scalars
from ..operators import cells as grid
from ..operators import compare, coverage, districts, parsing, records, tables
from ..sources import pdf
from ..streaming import jobs
from . import fixtures
from .fixtures import CELLS, DISTRICTS, JOB_EVENTS, read
from .queries import _tables, joined, money, query

# A part's price as the salaries of a table: a row per document and step, and SQL for the same.
_PART = "p AS (SELECT p_partkey // 40 AS doc_id, p_size AS step, max(p_retailprice) AS v FROM part GROUP BY ALL)"


def _steps(spark, sf_dir):
    """``doc_id, rows``: steps in order, each with its four salaries as text, made of the price of parts."""
    part = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("doc_id"), F.col("p_size").alias("step")).agg(F.max("p_retailprice").alias("v"))
    values = F.array(*[F.concat(F.lit("$"), F.format_number(F.floor(F.col("v") * 30) + k * 500, 0)) for k in range(4)])
    return part.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", values.alias("v")))).alias("rows"))


def _salaries(lanes_: list[tuple[str, int]], where: str = "TRUE") -> str:
    """SQL: a row for each lane (its name, and which of the four salaries) of each step."""
    values = ", ".join(f"('{lane}', {k})" for lane, k in lanes_)
    return f"SELECT doc_id, lane, CAST(step AS INTEGER) AS step, CAST(floor(v * 30) + k * 500 AS DOUBLE) AS salary FROM p, (VALUES {values}) t(lane, k) WHERE {where}"


def _by_doc(*texts: str):
    """One of the texts, in turn, by document."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int"))


@query(f"WITH {_PART} " + _salaries([("B+0", 0), ("B+15", 1), ("M+0", 2)], "NOT (step % 7 = 0 AND k = 0)"))
def text_table_rows(spark, sf_dir):
    """Tables in rows under headers of several spellings; every seventh step lacks its first salary."""
    header = _by_doc("STEP  BA  BA+15  MA", "Step B.A. B.A. + (15) M.A.", "I II IV", "Steps Lane 1  Lane 2  Lane 4", "Years Bachelor's  B-L5  Master's Degree")
    row = lambda r: F.concat_ws(" ", r["step"].cast("string"), F.slice(r["v"], F.when(r["step"] % 7 == 0, 2).otherwise(1), F.when(r["step"] % 7 == 0, 2).otherwise(3)))
    text = F.concat(F.lit("SALARY SCHEDULE\n"), header, F.lit("\n"), F.array_join(F.transform("rows", row), "\n"))
    return parsing.parse_tables(_steps(spark, sf_dir).select("doc_id", text.alias("text"))).drop("pos")


@query(f"WITH {_PART} " + _salaries([("B+0", 0), ("M+30", 1), ("D+0", 3)]))
def text_table_columns(spark, sf_dir):
    """Tables in columns: all steps, then a label and its salaries for each lane."""
    run = lambda k: F.array_join(F.transform("rows", lambda r: r["v"][k]), "\n")
    text = F.concat_ws("\n", F.array_join(F.transform("rows", lambda r: r["step"].cast("string")), " "), _by_doc("BA", "Bachelors"), run(0), _by_doc("MA+30", "M30", "MA-30"), run(1), F.lit("DOC"), run(3))
    return parsing.parse_tables(_steps(spark, sf_dir).select("doc_id", text.alias("text")), parsing.columns_of).drop("pos")


@query(f"WITH {_PART} " + _salaries([("B+0", 0), ("M+30", 2), ("D+0", 3)], "NOT (step % 7 = 0 AND k < 2)"))
def clipboard_grid(spark, sf_dir):
    """Pasted grids: labels of several words, a column of unknown name, short rows at the right, rows over two lines."""
    header = _by_doc("Pay grid\nStep Bachelors Prov Masters + 30 Doctorate", "Step BA Other M30 DOC", "BACHELOR'S DEGREE\nHELPER\nMASTER'S DEGREE +30\nDoctorate")
    short, broken = lambda r: r["step"] % 7 == 0, lambda r: r["step"] % 5 == 0
    number = lambda r: F.concat(_by_doc("", "Step "), r["step"].cast("string"))
    row = lambda r: F.when(short(r), F.concat_ws(" ", number(r), F.slice(r["v"], 3, 2))).when(broken(r), F.concat(F.concat_ws(" ", number(r), F.slice(r["v"], 1, 2)), F.lit("\n"), F.concat_ws(" ", F.slice(r["v"], 3, 2)))).otherwise(F.concat_ws(" ", number(r), r["v"]))
    text = F.concat(header, F.lit("\n"), F.array_join(F.transform("rows", row), "\n"))
    return parsing.parse_tables(_steps(spark, sf_dir).select("doc_id", text.alias("text")), parsing.grid_of).drop("pos")


@query("""WITH p AS (SELECT p_partkey // 40 AS doc_id, p_size, max(p_retailprice) AS v FROM part WHERE p_size <= 35 GROUP BY ALL),
t(label, education, credits, k) AS (VALUES ('BA', 'B', 0, 0), ('BA+15', 'M', -1, 1), ('MA', 'M', 0, 2))
SELECT doc_id, CASE WHEN k = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'B' END ELSE education END AS education, CAST(CASE WHEN k = 1 THEN doc_id % 3 * 15 ELSE credits END AS INTEGER) AS credits, p_size AS step, floor(v * 30 + k * 500 + 0.5) AS salary
FROM p, t WHERE floor(v * 30 + k * 500 + 0.5) BETWEEN 20000 AND 200000""")
def aliased_records(spark, sf_dir):
    """Tables whose second lane has a name that only the document explains."""
    made = _tables(spark, sf_dir)
    renamed = made.withColumn("rows", F.transform("rows", lambda row: F.transform(row, lambda c: F.when(c == "BA+15", "Column  B").otherwise(c))))
    target = F.concat(F.when(F.col("doc_id") % 2 == 0, "Master + ").otherwise("b."), F.when(F.col("doc_id") % 2 == 0, "").otherwise("a. + "), (F.col("doc_id") % 3 * 15).cast("string"), F.lit(" credits"))
    text = F.concat(F.lit("Notes\nMA = BA\n column b "), _by_doc("=", ":", "-"), F.lit(" "), target, F.lit("\nCOLUMN B = DOC\n"))
    return tables.to_records(renamed, tables.alias_pairs(made.select("doc_id", text.alias("text")))).drop("pos").withColumn("salary", money())


# Labels of parts: the education by size, the credits by key, the spelling by key too.
_LABELLED = """l AS (SELECT p_partkey, p_size % 3 AS e, p_partkey % 5 * 15 AS c, p_partkey // 5 % 6 AS spelling, p_size % 12 + 1 AS n FROM part),
k AS (SELECT p_partkey, CASE WHEN spelling = 5 THEN NULL WHEN spelling = 4 THEN 'LANE' || n WHEN e = 2 THEN 'DOC' ELSE CASE e WHEN 0 THEN 'BA' ELSE 'MA' END || CASE WHEN c > 0 THEN '+' || c ELSE '' END END AS key,
  CASE WHEN spelling = 5 OR spelling = 4 AND n > 8 THEN NULL WHEN spelling = 4 THEN CASE WHEN n < 4 THEN 'B' ELSE 'M' END ELSE CASE e WHEN 0 THEN 'B' WHEN 1 THEN 'M' ELSE 'D' END END AS education,
  CASE WHEN spelling = 5 OR spelling = 4 AND n > 8 THEN NULL WHEN spelling = 4 THEN CASE WHEN n < 4 THEN n - 1 ELSE n - 4 END * 15 WHEN e = 2 THEN 0 ELSE c END AS credits FROM l)"""

# Single labels that those don't make, their one spelling and their lane: other signs, misread digits, CAGS, roman numbers; None for those that name none.
_LABELS = [
    ("B.A.", "BA", "B", 0), ("ba15", "BA+15", "B", 15), ("BA + (30)", "BA+30", "B", 30), ("Bachelor's +45", "BA+45", "B", 45), ("B+L5", "BA+15", "B", 15), ("M+I0", "MA+10", "M", 10), ("MASTERS – 60", "MA+60", "M", 60), ("Master's Degree + 30", "MA+30", "M", 30), ("M:36", "MA+36", "M", 36), ("CAGS", "CAGS", "M", 60), ("Doctorate", "DOC", "D", 0), ("PhD", "DOC", "D", 0),
    ("Lane 3", "LANE3", "B", 30), ("PAY SCALE 5", "LANE5", "M", 15), ("Level 8", "LANE8", "M", 60), ("IV", "LANE4", "M", 0), ("(VII)", "LANE7", "M", 45), ("BA (II)", "LANE2", "B", 15), ("MULTIPLIER", None, None, None), ("Notes", None, None, None), ("Lane 12", "LANE12", None, None),
]


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_LISTED = "l2(i, label, key, education, credits) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, x))})" for i, x in enumerate(_LABELS)) + f"), every AS (SELECT p_partkey, key, education, credits FROM k UNION ALL SELECT p_partkey, key, education, credits FROM part JOIN l2 ON p_partkey % {len(_LABELS)} = i)"


@query(f"WITH {_LABELLED}, {_LISTED} SELECT p_partkey, key, education, CAST(credits AS INTEGER) AS credits, CASE WHEN education IS NULL THEN 'none' ELSE CASE education WHEN 'B' THEN 'Bachelor''s' WHEN 'M' THEN 'Master''s' ELSE 'Doctorate' END || CASE WHEN credits > 0 THEN ' +' || credits ELSE '' END END AS text FROM every")
def lane_labels(spark, sf_dir):
    """Two labels of each part: one in six spellings of every education and number of credits, numbered lanes up to 12, and texts that name no lane; one of the list."""
    e, c, spelling, n = F.col("p_size") % 3, (F.col("p_partkey") % 5 * 15).cast("int"), F.floor(F.col("p_partkey") / 5) % 6, (F.col("p_size") % 12 + 1).cast("string")
    named = lambda b, m, d, plus: F.concat(F.when(e == 0, b).when(e == 1, m).otherwise(d), F.when((e < 2) & (c > 0), F.format_string(plus, c)).otherwise(""))
    label = F.when(spelling == 0, named("BA", "MA", "DOC", "+%d")).when(spelling == 1, named("ba", "ma", "phd", "%d")).when(spelling == 2, named("Bachelor's", "Master's Degree", "Doctorate", " + %d")).when(spelling == 3, named("B.A.", "M.A.", "Doctorate", " + (%d)")).when(spelling == 4, F.concat(F.lit("Pay Scale "), n)).otherwise("Notes")
    listed = F.element_at(F.array(*[F.lit(x[0]) for x in _LABELS]), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(label, listed)).alias("label")).withColumns({"key": lanes.lane_key(F.col("label")), "lane": lanes.lane_of(F.col("label"))})
    text = F.coalesce(lanes.lane_text(F.col("lane.education"), F.col("lane.credits")), F.lit("none"))
    return rows.select("p_partkey", "key", "lane.education", "lane.credits", text.alias("text"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 9 AS k, year(o_orderdate) + 20 AS y, o_custkey % 3 AS more FROM orders)
SELECT o_orderkey, CASE WHEN k IN (4, 5) THEN (y - 1) || '-' || y WHEN k = 6 THEN (y + more) || '-' || (y + more + 1) WHEN k = 8 THEN 'unknown' ELSE y || '-' || (y + 1) END AS year,
CASE WHEN k = 1 THEN (y + 1) || '-' || (y + 2) WHEN k IN (4, 7, 8) THEN NULL WHEN k = 6 THEN (y + more) || '-' || (y + more + 1) ELSE y || '-' || (y + 1) END AS older FROM t""")
def school_year_readings(spark, sf_dir):
    """Both readings of texts made of an order's date, month and day: ranges, dates, fiscal years, several years, two digits, none."""
    y, k = F.year("o_orderdate") + 20, F.col("o_orderkey") % 9
    s, after, two = y.cast("string"), (y + 1).cast("string"), F.lpad((y % 100).cast("string"), 2, "0")
    month, day = F.element_at(F.array(*[F.lit(m.title()) for m in scalars.MONTHS]), (F.col("o_custkey") % 12 + 1).cast("int")), (F.col("o_custkey") % 28 + 1).cast("string")
    date = F.concat(month, F.lit(" "), day, F.lit(", "), s)
    text = F.when(k == 0, F.concat(F.lit("Schedule "), s, F.lit(" – "), after)).when(k == 1, F.concat(date, F.lit(" - June 30, "), after)).when(k == 2, F.concat(F.lit("effective "), date)).when(k == 3, F.concat(F.lit("as of "), month, F.lit(" "), s, F.lit(", not 1999")))
    text = text.when(k == 4, F.concat(F.lit("FY"), two, F.lit(" budget"))).when(k == 5, F.concat(F.lit("FY "), s)).when(k == 6, F.concat(s, F.lit(" or "), (y + F.col("o_custkey") % 3).cast("string"))).when(k == 7, F.concat(F.lit("room "), two)).otherwise("no year")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", scalars.school_year(F.col("text")).alias("year"), scalars.school_year_or_null(F.col("text")).alias("older"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_extendedprice AS DECIMAL(14, 4)), 2) <> round(CAST(l_extendedprice + l_discount / 10 AS DECIMAL(14, 4)), 2) AS changed FROM lineitem")
def value_changes(spark, sf_dir):
    price = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.value_changed(price, price + F.col("l_discount") / 10).alias("changed"))


def _rows_or_error(text: str):
    if "CORRUPT" in text:
        raise ValueError("no text layer")
    return parsing.rows_of(text)


@query(f"WITH {_PART}, d AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1) SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 OR doc_id % 4 = 2 THEN 0 ELSE 2 * n END AS BIGINT) AS records, doc_id % 4 < 2 AS success, CASE WHEN doc_id % 4 = 3 THEN 'ValueError: no text layer' END AS error FROM d")
def folder_batch(spark, sf_dir):
    """A batch in which some documents fail and some have no table: each on its own."""
    row = F.transform("rows", lambda r: F.concat_ws(" ", r["step"].cast("string"), F.slice(r["v"], 1, 2)))
    text = F.when(F.col("doc_id") % 4 == 3, "CORRUPT").when(F.col("doc_id") % 4 == 2, "no table here").otherwise(F.concat(F.lit("STEP BA MA\n"), F.array_join(row, "\n")))
    return parsing.batch_results(parsing.parse_each(_steps(spark, sf_dir).select("doc_id", text.alias("text")), _rows_or_error))


# -- records and checks -----------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k, o_totalprice FROM orders) SELECT doc_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'key' WHEN 2 THEN 'education,salary' ELSE 'salary' END AS errors FROM r""")
def record_rejects(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(k == 1, F.lit(None)).otherwise("2020-2021").alias("school_year"), F.lit("Full Year").alias("period"), F.when(k == 2, "X").otherwise("M").alias("education"),
        F.lit(15).alias("credits"), F.lit(3).alias("step"), F.when(k == 2, F.lit(0.0)).when(k == 3, F.lit(None)).otherwise(F.col("o_totalprice")).alias("salary"),
    )
    return rows.select("doc_id", F.concat_ws(",", checks.record_errors()).alias("errors"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Name, (old)' WHEN 1 THEN NULL WHEN 2 THEN '<b>' ELSE repeat('x', 101) END AS value, o_orderkey % 4 < 2 AS ok FROM orders""")
def text_checks(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "  Name, (old) ").when(k == 1, "   ").when(k == 2, "<b>").otherwise(F.repeat(F.lit("x"), 101))
    return read(spark, sf_dir, "orders").select("o_orderkey", checks.clean_text(text).alias("c")).select("o_orderkey", "c.*")


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, step % 2 = 0 AS is_calculated FROM cells")
def cells_with_defaults(spark, sf_dir):
    """An absent flag is false, a missing type is set."""
    cells = fixtures.cells(spark, sf_dir)
    raw = cells.withColumns({"credits": F.col("credits").cast("string"), "is_calculated": F.when(F.col("step") % 2 == 0, F.lit(True))})
    return grid.with_defaults(raw).select("district_id", "school_year", "period", "education", "credits", "step", "is_calculated")


@query(f"WITH {CELLS}, y AS (SELECT district_id, school_year, period, credits, step, max(school_year) OVER (PARTITION BY district_id) AS last FROM cells), p AS (SELECT *, max(period) OVER (PARTITION BY district_id, school_year) AS last_period FROM y WHERE school_year = last) SELECT district_id, school_year, period, count(*) AS n FROM p WHERE period = last_period GROUP BY ALL")
def last_periods(spark, sf_dir):
    out = records.relevant_years(fixtures.cells(spark, sf_dir), 2024, ["district_id"], last_period=True)
    return out.groupBy("district_id", "school_year", "period").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT school_year, period, array_to_string(list_sort(list(DISTINCT education || '+' || credits)), ',') AS combos FROM cells GROUP BY ALL")
def period_combos(spark, sf_dir):
    return coverage.combos(fixtures.cells(spark, sf_dir)).withColumn("combos", joined("combos"))


@query("SELECT count(*) AS total, count_if(s_suppkey % 3 = 0) AS exact, count_if(s_suppkey % 3 = 1) AS partial, count_if(s_suppkey % 3 = 2) AS unmatched FROM supplier")
def name_match_totals(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.col("s_name").alias("name"))
    k = F.col("district_id") % 3
    names = s.select(F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit("the "), F.upper("name"), F.lit(" district"))).otherwise(F.concat(F.lit("nobody "), F.col("district_id").cast("string"))).alias("name"))
    return records.match_totals(records.match_names(names, s))


# -- districts --------------------------------------------------------------------------------


@query(f"WITH {DISTRICTS} SELECT district_id, name FROM districts WHERE lower(name) = (SELECT lower(max(s_name)) FROM supplier)")
def by_name(spark, sf_dir):
    name = read(spark, sf_dir, "supplier").agg(F.max("s_name")).first()[0]
    return districts.by_name(fixtures.districts(spark, sf_dir), f" {name.upper()} ").select("district_id", "name")


@query(f"WITH {DISTRICTS}, f AS (SELECT * FROM districts ORDER BY lower(name), district_id LIMIT 7) SELECT district_id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY lower(name), district_id LIMIT 5 OFFSET 4")
def capped_page(spark, sf_dir):
    """The last page of a listing that is fetched up to a cap, which is the feature."""
    return districts.page(districts.listed(fixtures.districts(spark, sf_dir)), 4, 5, most=7).select("district_id", "name", "total")


@query(f"""WITH {DISTRICTS} SELECT district_id, array_to_string(CASE WHEN district_id % 3 = 0 THEN ['X', 'Y'] WHEN district_id % 3 = 1 THEN list_append(towns, 'New Town') ELSE list_filter(towns, lambda t: t <> towns[1]) END, ',') AS towns FROM districts""")
def town_edits(spark, sf_dir):
    """Town lists replaced, with one more, or with one less."""
    rows = fixtures.districts(spark, sf_dir)
    k = F.col("district_id") % 3
    new = rows.filter(k == 0).select("district_id", F.array(F.lit(" X"), F.lit(""), F.lit("Y"), F.lit("X ")).alias("towns"))
    edited = districts.replace_towns(rows, new)
    towns = F.when(k == 1, districts.with_town(F.col("towns"), F.lit(" New Town "))).when(k == 2, districts.without_town(F.col("towns"), F.get("towns", F.lit(0)))).otherwise(F.col("towns"))
    return edited.withColumn("towns", towns).select("district_id", joined("towns"))


@query(f"""WITH {CELLS}, {DISTRICTS}, targets AS (SELECT e AS education, CAST(c AS INTEGER) AS credits FROM (VALUES ('B'), ('M'), ('D')) t(e), range(0, 60, 5) r(c)), combos AS (SELECT DISTINCT education, credits FROM cells),
ok AS (SELECT t.*, count_if(k.education = t.education AND k.credits = t.credits) > 0 AS exact FROM targets t JOIN combos k ON CASE k.education WHEN 'B' THEN 1 WHEN 'M' THEN 2 ELSE 3 END <= CASE t.education WHEN 'B' THEN 1 WHEN 'M' THEN 2 ELSE 3 END AND (k.education <> t.education OR k.credits <= t.credits) GROUP BY t.education, t.credits)
SELECT CAST(count_if(exact) AS BIGINT) AS exact, CAST(count_if(NOT exact) AS BIGINT) AS fallback FROM ok""")
def match_counts(spark, sf_dir):
    """How many of the lanes that may be asked for are met exactly, and how many by another."""
    targets = spark.createDataFrame([(e, c) for e in "BMD" for c in range(0, 60, 5)], "education string, credits int")
    found = compare.resolve_lanes(targets, fixtures.cells(spark, sf_dir).select("education", "credits").distinct())
    return found.agg(F.count_if("is_exact").alias("exact"), F.count_if(~F.col("is_exact")).alias("fallback"))


# -- jobs -------------------------------------------------------------------------------------


@query(f"WITH {JOB_EVENTS}, l AS (SELECT job_id, arg_max(status, seq) AS status FROM job_events GROUP BY 1) SELECT job_id, status, status IN ('completed', 'failed') AS archived FROM l")
def job_archive(spark, sf_dir):
    """Every job is either running or archived, never both."""
    events = fixtures.job_events(spark, sf_dir)
    parts = [rows.select("job_id", "status", F.lit(flag).alias("archived")) for rows, flag in ((jobs.running(events), False), (jobs.archived(events), True))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {JOB_EVENTS}, l AS (SELECT job_id, arg_max(status, seq) AS status FROM job_events GROUP BY 1) SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN job_id % 3 = 0 THEN 'jobs/' || job_id || '.pdf' END AS removed FROM l")
def job_delete(spark, sf_dir):
    """Jobs deleted with their files; unknown ones change nothing."""
    events = fixtures.job_events(spark, sf_dir)
    ids = events.select("job_id").distinct()
    gone = ids.filter("job_id % 3 = 0").unionByName(spark.createDataFrame([(-1,)], "job_id long").select(F.col("job_id").cast(dict(ids.dtypes)["job_id"])))
    after, files = jobs.delete_jobs(events, gone, ids.select("job_id", F.concat(F.lit("jobs/"), F.col("job_id").cast("string"), F.lit(".pdf")).alias("path")))
    return jobs.latest(after).join(files, "job_id", "left").select("job_id", "status", F.col("path").alias("removed"))


# -- loads and results ------------------------------------------------------------------------

_FAULTS = "CASE WHEN l_quantity = 50 AND l_returnflag = 'A' THEN 'education' END, CASE WHEN l_discount = 0.1 AND l_quantity > 45 THEN 'salary' END"


@query(f"""WITH r AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 25 AS batch, list_filter([{_FAULTS}], lambda x: x IS NOT NULL) AS e FROM lineitem),
b AS (SELECT batch, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(e)))), ',') AS codes FROM r GROUP BY 1)
SELECT batch, n, CASE WHEN codes = '' THEN n ELSE 0 END AS written, CASE WHEN codes <> '' THEN n ELSE 0 END AS failed, codes FROM b""")
def load_in_batches(spark, sf_dir):
    """Records of all lines, written 25 at a time; some have an education or a salary that they can't have."""
    line = read(spark, sf_dir, "lineitem")
    faulty = F.when((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "A"), "X").otherwise("M")
    salary = F.when((F.col("l_discount") == 0.1) & (F.col("l_quantity") > 45), F.lit(0.0)).otherwise(F.col("l_extendedprice").cast("double"))
    rows = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.lit("2020-2021").alias("school_year"), F.lit("Full Year").alias("period"), faulty.alias("education"), F.lit(0).alias("credits"), F.lit(1).alias("step"), salary.alias("salary"))
    return records.load_batches(rows, checks.record_errors(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").withColumn("codes", F.concat_ws(",", "codes"))


@query(f"WITH {CELLS}, {DISTRICTS}, r AS (SELECT district_id + 1 AS district_id, max(salary) AS salary FROM cells GROUP BY 1) SELECT r.district_id, CAST(salary AS DOUBLE) AS salary, coalesce(district_type, 'unknown') AS district_type, CASE WHEN r.district_id % 3 = 0 AND name IS NOT NULL THEN 'contracts/' || name || '.pdf' END AS contract_pdf, coalesce(array_to_string(towns, ','), '') AS towns FROM r LEFT JOIN districts USING (district_id)")
def described_results(spark, sf_dir):
    """Results with type, contract and towns; the last is of no known district."""
    rows = fixtures.cells(spark, sf_dir).groupBy((F.col("district_id") + 1).alias("district_id")).agg(F.max("salary").cast("double").alias("salary"))
    dim = fixtures.districts(spark, sf_dir).withColumn("contract_pdf", F.when(F.col("district_id") % 3 == 0, F.concat(F.lit("contracts/"), "name", F.lit(".pdf"))))
    return districts.described(rows, dim).withColumn("towns", F.concat_ws(",", "towns"))


@query(f"WITH {CELLS}, o AS (SELECT education, list_sort(list(DISTINCT credits)) AS c FROM cells WHERE credits % 10 = 5 GROUP BY 1), w AS (SELECT c_custkey, c_custkey % 50 AS wanted, CASE c_nationkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'X' END AS education FROM customer) SELECT c_custkey, education, CAST(CASE WHEN c IS NULL OR list_contains(c, wanted) THEN wanted ELSE c[1] END AS INTEGER) AS credits FROM w LEFT JOIN o USING (education)")
def picked_credits(spark, sf_dir):
    """What a comparison falls back to when its education doesn't have the credits that were chosen."""
    options = grid.lane_options(fixtures.cells(spark, sf_dir).filter("credits % 10 = 5")).withColumnRenamed("credits", "options")
    k = F.col("c_nationkey") % 4
    wanted = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).cast("int").alias("wanted"), F.when(k == 0, "B").when(k == 1, "M").when(k == 2, "D").otherwise("X").alias("education"))
    return wanted.join(options, "education", "left").select("c_custkey", "education", scalars.pick_credits(F.col("wanted"), F.coalesce("options", F.array().cast("array<int>"))).cast("int").alias("credits"))


@query(f"WITH {JOB_EVENTS}, s AS (SELECT job_id, arg_max(status, seq) AS status FROM job_events GROUP BY 1) SELECT job_id, status, status NOT IN ('completed', 'failed') AS running FROM s")
def job_status(spark, sf_dir):
    """The state of every job, found as a single one is: running ones first, then archived ones."""
    events = fixtures.job_events(spark, sf_dir)
    return jobs.running(events).withColumn("running", F.lit(True)).unionByName(jobs.archived(events).withColumn("running", F.lit(False))).select("job_id", "status", "running")


def _as_pdf(cells):
    """``path, content``: a file for each district, a page for each schedule, a title, and a table of steps by lanes, written as the format's plain text."""
    lane = F.concat(F.when(F.col("education") == "B", "BA").otherwise("MA"), F.when(F.col("credits") > 0, F.concat(F.lit("+"), F.col("credits").cast("string"))).otherwise(""))
    column = F.when(F.col("education") == "B", 0).otherwise(9) + F.floor(F.col("credits") / 5)
    shown = lambda x, y, text: F.concat(F.lit("1 0 0 1 "), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(" Tm ("), text, F.lit(") Tj\n"))
    x = 120 + 80 * column
    heads = F.array_join(F.array_sort(F.collect_set(shown(x, F.lit(740), lane))), "")
    steps = F.array_join(F.array_sort(F.collect_set(shown(F.lit(40), 740 - 15 * F.col("step"), F.col("step").cast("string")))), "")
    values = F.array_join(F.array_sort(F.collect_list(shown(x, 740 - 15 * F.col("step"), F.concat(F.lit("$"), F.format_number("salary", 2))))), "")
    pages = cells.groupBy("district_id", "school_year", "period").agg(heads.alias("h"), steps.alias("s"), values.alias("v"))
    title = shown(F.lit(40), F.lit(770), F.concat_ws(" ", "school_year", "period"))
    body = F.concat(F.lit("BT /F1 10 Tf\n"), title, F.lit("1 0 0 1 40 740 Tm (STEP) Tj\n"), "h", "s", "v", F.lit("ET"))
    files = pages.groupBy("district_id").agg(F.array_sort(F.collect_list(F.struct("school_year", "period", body.alias("body")))).alias("p"))
    number = lambda k, first: (F.lit(first) + 2 * k).cast("string")
    own = F.transform("p", lambda q, k: F.concat(number(k, 10), F.lit(" 0 obj <</Type/Page/Contents "), number(k, 11), F.lit(" 0 R>> endobj\n"), number(k, 11), F.lit(" 0 obj <</Length "), F.octet_length(q["body"]).cast("string"), F.lit(">>\nstream\n"), q["body"], F.lit("\nendstream endobj\n")))
    kids = F.array_join(F.transform("p", lambda q, k: F.concat(number(k, 10), F.lit(" 0 R"))), " ")
    text = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/MediaBox[0 0 1600 800]/Kids["), kids, F.lit("]>> endobj\n"), F.array_join(own, ""), F.lit("trailer <</Root 1 0 R>>"))
    return files.select(F.col("district_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells WHERE education <> 'D' AND salary BETWEEN 20000 AND 200000")
def pdf_tables(spark, sf_dir):
    """Cells written as PDF files, a page for each schedule, and read back from their bytes."""
    pages = pdf.pages(_as_pdf(fixtures.cells(spark, sf_dir).filter("education <> 'D'")))
    found = pdf.tables(pages).select(F.concat_ws("|", "path", F.split("text", "\n")[0]).alias("doc_id"), "rows")
    read_back = tables.to_records(tables.split_on_steps(found))
    where = F.split("doc_id", "\\|")
    return read_back.select(where[0].cast("long").alias("district_id"), F.substring(where[1], 1, 9).alias("school_year"), F.substr(where[1], F.lit(11)).alias("period"), "education", "credits", "step", money())


@query("""WITH p AS (SELECT p_partkey // 40 AS doc_id, p_size, max(p_retailprice) AS v FROM part GROUP BY ALL),
c(label, other, k) AS (VALUES ('BA', 'BA', 0), ('BA+15', 'MA', 1), ('MA', NULL, 2)),
r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN label ELSE other END AS label, p_size AS step, floor(v * 30 + k * 500 + 0.5) AS salary FROM p, c WHERE p_size <= 20)
SELECT * FROM r WHERE label IS NOT NULL AND salary BETWEEN 20000 AND 200000""")
def older_columns(spark, sf_dir):
    """The older reading of tables by place: in every second document a label is unknown, so that the next lane gets its values."""
    made = _tables(spark, sf_dir)
    label = F.when(F.col("doc_id") % 2 == 1, F.lit("Other")).otherwise(F.lit("BA + 15"))
    named = made.withColumn("rows", F.transform("rows", lambda row: F.transform(row, lambda c: F.when(c == "BA+15", label).otherwise(c))))
    return tables.older_cells(named).withColumn("salary", money())
