"""Expectations on tiny inputs."""

import random

import pytest
from pyspark.sql import functions as F

from gridspan.functions import checks, lanes, scalars
from gridspan.operators import compare, coverage, districts, fill, parsing, records, tables
from gridspan.plans import apply

KEYS = "district_id string, school_year string, period string, education string, credits int, step int, salary decimal(12,2)"


def grid(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame([("d1", "2022-2023", "Full Year", e, c, s, Decimal(v)) for e, c, s, v in rows], KEYS)


def filled(rows):
    return {(r.education, r.credits, r.step): (float(r.salary), r.is_calculated_from.education, r.is_calculated_from.credits, r.is_calculated_from.step) for r in rows.collect()}


def test_fill_down_takes_the_step_below(spark):
    out = filled(fill.fill_down(grid(spark, ("B", 0, 1, 50000), ("B", 0, 3, 52000)), 5))
    assert len(out) == 3
    assert out["B", 0, 2] == (50000.0, "B", 0, 1)
    assert out["B", 0, 5] == (52000.0, "B", 0, 3)


def test_fill_right_fills_missing_lanes(spark):
    out = filled(fill.fill_grid(grid(spark, ("B", 0, 1, 50000)), 2, {"B": [0, 15], "M": [0]}))
    assert len(out) == 5
    assert out["M", 0, 2] == (50000.0, "B", 0, 1)


def test_a_complete_grid_stays(spark):
    cells = grid(spark, ("B", 0, 1, 50000), ("B", 0, 2, 51000))
    assert fill.fill_grid(cells, 2, {"B": [0]}).count() == 0


def test_lower_education_is_not_filled_from_higher(spark):
    out = filled(fill.fill_grid(grid(spark, ("M", 0, 1, 60000)), 1, {"B": [0], "M": [0], "D": [0]}))
    assert set(out) == {("D", 0, 1)}


def fold(real, top, combos):
    """The procedure, lane by lane in key order."""
    order = {"B": 1, "M": 2, "D": 3}
    full = {}
    for lane in sorted({(e, c) for e, c, _ in real}):
        steps = sorted(s for e, c, s in real if (e, c) == lane)
        full[lane] = {t: (max([s for s in steps if s <= t], default=steps[0]), lane) for t in range(1, top + 1)}
    out = {(*lane, t): (*lane, s) for lane, m in full.items() for t, (s, _) in m.items() if s != t}
    for e, c in sorted(((e, c) for e, cs in combos.items() for c in cs if (e, c) not in full), key=lambda x: (order[x[0]], x[1])):
        best = None
        for lane in full:
            if order[lane[0]] > order[e]:
                continue
            if best is None:
                best = lane
            elif lane[0] == e and best[0] != e:
                best = lane
            elif lane[0] == e and best[0] == e:
                if lane[1] < c and (lane[1] > best[1] or best[1] > c):
                    best = lane
            elif lane[0] != e and best[0] != e and lane[1] > best[1]:
                best = lane
        if best is not None:
            full[e, c] = dict(full[best])
            out |= {(e, c, t): (*root, s) for t, (s, root) in full[e, c].items()}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fill_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    combos = {"B": [0, 15, 30], "M": [0, 15, 30, 60], "D": [0]}
    lanes_ = rng.sample([(e, c) for e, cs in combos.items() for c in cs], rng.randint(1, 5))
    real = {(e, c, s) for e, c in lanes_ for s in rng.sample(range(1, 7), rng.randint(1, 4))}
    got = filled(fill.fill_grid(grid(spark, *[(e, c, s, 40000 + s * 100 + c) for e, c, s in sorted(real)]), 6, combos))
    assert {k: v[1:] for k, v in got.items()} == fold(real, 6, combos)


def test_compare_ranks_and_shows_the_oldest(spark):
    from decimal import Decimal

    cells = spark.createDataFrame([("a", "2021-2022", "FY", "M", 30, 5, Decimal(70000)), ("a", "2022-2023", "FY", "M", 30, 5, Decimal(90000)), ("b", "2022-2023", "FY", "M", 30, 5, Decimal(80000)), ("c", None, None, "M", 30, 5, Decimal(60000)), ("x", "2022-2023", "FY", "M", 30, 5, Decimal(99000))], KEYS)
    names = spark.createDataFrame([("a", "A", "municipal", ["t"]), ("b", "B", "regional_academic", []), ("c", "C", "municipal", []), ("x", "X", "charter", [])], "district_id string, name string, district_type string, towns array<string>")
    rows = compare.compare(cells, names, "M", 30, 5).orderBy("rank").collect()
    assert [(r.rank, r.district_id, float(r.salary)) for r in rows] == [(1, "a", 70000.0), (2, "b", 80000.0), (3, "c", 60000.0)]
    assert [r.district_id for r in compare.compare(cells, names, "M", 30, 5, keep="latest", rank_by="salary").orderBy("rank").collect()] == ["a", "b", "c"]


def test_resolve_lane():
    combos = ["B+0", "B+60", "M+0", "M+30", "D+0"]
    assert compare.resolve_lane(combos, "M", 30) == ("M", 30, True)
    assert compare.resolve_lane(combos, "M", 15) == ("M", 0, False)
    assert compare.resolve_lane(["B+0", "B+60"], "D", 0) == ("B", 60, False)
    with pytest.raises(ValueError):
        compare.resolve_lane(["M+0"], "B", 0)
    with pytest.raises(ValueError):
        compare.resolve_lane(combos, "M", 15, include_fallback=False)


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_periods(spark):
    assert values(spark, scalars.normalize_period, None, "", " ", "FY", "fy", "full-year", "Full_Year", "FULLYEAR", "10-month") == ["Full Year"] * 8 + ["10-month"]
    assert values(spark, scalars.should_normalize_period, None, " ", "FY", "Full Year", "spring") == [False, False, True, False, False]


def test_school_years(spark):
    texts = ("2024-2025", "July 1, 2024 - June 30, 2025", "Effective July 1, 2027", "July 2024", "FY26", "FY 2022", "in 2019 and 2023", "27", "none", "2020 - 2024")
    assert values(spark, scalars.school_year, *texts) == ["2024-2025", "2024-2025", "2027-2028", "2024-2025", "2025-2026", "2021-2022", "2023-2024", "2027-2028", "unknown", "2024-2025"]


def test_salaries_and_steps(spark):
    assert [v and float(v) for v in values(spark, scalars.parse_salary, "$49,189", "49189.50", "10000", "x", None)] == [49189.0, 49189.5, None, None, None]
    assert values(spark, lambda t: scalars.parse_salary(t, drop_point=True), "$49,189.50") == [None]
    assert values(spark, scalars.extract_step, "Step 1", "10", "45", "Step") == [1, 10, None, None]
    assert values(spark, scalars.is_step_marker, "1", "5-6", "5–6", "BA", "123") == [True, True, True, False, False]
    assert values(spark, scalars.is_salary, "$49,189", "12", "Step 1") == [True, False, False]
    assert values(spark, scalars.repair_points, "41.124.59") == ["41124.59"]
    assert values(spark, scalars.currency, "-50.25", "10.999", None) == ["$-50.25", "$11.00", "N/A"]
    assert values(spark, scalars.roman, "VIII", "IX", "Q") == [8, 9, None]
    assert values(spark, lambda t: scalars.pad_number(t, 3), "5", "1234") == ["005", "1234"]
    assert values(spark, scalars.is_step_header, "Step 1", "Years", "BA") == [True, True, False]
    assert values(spark, scalars.split_tokens, "1  40,000   50,000", "1 2") == [["1", "40,000", "50,000"], ["1", "2"]]


def test_lanes(spark):
    assert values(spark, lanes.lane_tokens, "B.A.  BA + (15)  MA-30 CAGS", "nothing") == [["BA", "BA+15", "MA+30", "CAGS"], []]
    found = {(r.label): (r.education, r.credits) for r in lanes.lane_table(spark).collect()}
    assert found["BA+30"] == ("B", 30) and found["CAGS"] == ("M", 60) and found["M15"] == ("M", 15)


def test_search(spark):
    rows = spark.createDataFrame([("1", "Alpha", ["Boston"]), ("2", "Boston South", ["X"]), ("3", "Gamma", ["Y"])], "district_id string, name string, towns array<string>")
    assert [(r.district_id, r.source) for r in districts.search(rows, "boston").collect()] == [("2", 1), ("1", 2)]
    assert districts.search(rows, "bo").count() == 0
    assert [r.total for r in districts.page(districts.listed(rows), 1, 2).collect()] == [3, 3]


def test_records(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "k string, pos int, v int")
    assert sorted(r.v for r in records.first_of_key(rows, ["k"]).collect()) == [10, 30]
    assert sorted(r.v for r in records.last_of_key(rows, ["k"]).collect()) == [20, 30]
    valid, bad = records.split_valid(spark.createDataFrame([("2022-2023", "FY", "B", 0, 1, 5.0), (None, "FY", "X", 0, 1, -1.0)], "school_year string, period string, education string, credits int, step int, salary double"), checks.record_errors())
    assert valid.count() == 1 and bad.first().errors == ["key", "education", "salary"]


def test_apply_replaces_and_fills(spark):
    old = grid(spark, ("B", 0, 1, 50000), ("B", 0, 2, 51000))
    new = grid(spark, ("B", 0, 1, 55000)).withColumn("pos", F.lit(1)).withColumn("period", F.lit("FY"))
    cells, maxima = apply.apply_records(old, new)
    assert {(r.step, float(r.salary), r.is_calculated) for r in cells.collect()} == {(1, 55000.0, False)}
    assert maxima.first().max_step == 1
    assert coverage.completeness(old, 5).first().missing == 3


def test_text_tables(spark):
    text = "SALARY SCHEDULE\nStep BA BA+15 MA\n1 40,000 41,000 42,000\n2 43,000\n44,000 45,000\n3 50,000 51,000\n"
    assert list(parsing.rows_of(text)) == [("B+0", 1, 40000), ("B+15", 1, 41000), ("M+0", 1, 42000), ("B+0", 2, 43000), ("B+15", 2, 44000), ("M+0", 2, 45000), ("B+15", 3, 50000), ("M+0", 3, 51000)]
    assert list(parsing.columns_of("1 2 BA 40,000 41,000 MA 42,000 43,000")) == [("B+0", 1, 40000), ("B+0", 2, 41000), ("M+0", 1, 42000), ("M+0", 2, 43000)]
    wide = spark.createDataFrame([(1, [["STEP", "BA", "STEP", "MA"], ["1", "40,000", "1", "50,000"]])], "doc_id int, rows array<array<string>>")
    assert [r["rows"] for r in tables.split_on_steps(wide).orderBy("part").collect()] == [[["STEP", "BA"], ["1", "40,000"]], [["STEP", "MA"], ["1", "50,000"]]]


def test_ocr_blocks(spark):
    from gridspan.schemas import OCR_BLOCKS

    blocks = [("t", "TABLE", None, None, None, [("CHILD", [f"c{i}" for i in range(10)])])]
    for i in range(10):
        blocks += [(f"c{i}", "CELL", i // 2 + 1, i % 2 + 1, None, [("CHILD", [f"w{i}a", f"w{i}b"])]), (f"w{i}a", "WORD", None, None, f"a{i}", None), (f"w{i}b", "WORD", None, None, "z", None)]
    rows = tables.block_grids(spark.createDataFrame(blocks, OCR_BLOCKS)).first()["rows"]
    assert rows[0] == ["a0 z", "a1 z"] and len(rows) == 5


def test_tables_and_years(spark):
    rows = spark.createDataFrame([([["STEP", "MULTIPLIER", "BA", "Multiplier", "MA"], ["1", "1.0", "40,000", "1.1", "44,000"]],)], "rows array<array<string>>")
    assert rows.select(tables.without_multipliers(F.col("rows"))).first()[0] == [["STEP", "BA", "MA"], ["1", "40,000", "44,000"]]
    cells = spark.createDataFrame([("2024-2025", "x"), ("15", "2020-2021")], "cell string, year string")
    assert [r[0] for r in cells.select(tables.table_year(F.col("cell"), F.col("year"))).collect()] == ["2024-2025", "2020-2021"]


def test_parameters():
    from gridspan.operators.cells import check_lane

    check_lane("M", 30, 5, 15, [0, 30])
    for bad in (("X", 30, 5), ("M", 31, 5), ("M", 30, 16)):
        with pytest.raises(ValueError):
            check_lane(*bad, 15, [0, 30])


def test_pasted_grids():
    text = "Teachers\nStep Bachelors Other Masters + 30\n1 40,000 1 41,000\n2 42,000\n3 43,000 2\n44,000\n"
    assert list(parsing.grid_of(text)) == [("B+0", 1, 40000), ("M+30", 1, 41000), ("M+30", 2, 42000), ("B+0", 3, 43000), ("M+30", 3, 44000)]
    assert list(parsing.grid_of("")) == list(parsing.grid_of(None)) == list(parsing.grid_of("1 40,000")) == []
    assert parsing.lanes_in("I  II  IV  BA-L5 MASTER'S DEGREE (30) Lane 8") == ["B+0", "B+15", "M+0", "B+15", "M+0", "M+60"]


def test_catalogue_and_cells_by_key(spark):
    from gridspan.operators import cells as own

    cells = grid(spark, ("B", 0, 1, 50000), ("B", 0, 2, 51000))
    row = cells.first()
    assert own.cell_at(cells, row.district_id, row.school_year, row.period, "B", 0, 2).first().salary == 51000
    assert own.cell_at(cells, row.district_id, row.school_year, row.period, "B", 0, 9).isEmpty()
    assert own.catalogue_of(cells, row.school_year).count() == 1
    with pytest.raises(ValueError):
        own.catalogue_of(cells, "1900-1901")


def test_names_of_any_length(spark):
    have = spark.createDataFrame([(1, "Ab"), (2, "Abcd Hills"), (3, "Xy"), (4, "")], "district_id long, name string")
    names = spark.createDataFrame([("hills",), ("the xy town",), ("a",), ("q",), ("",), (None,), ("AB",)], "name string")
    got = {r.name: (r.district_id, r.match) for r in records.match_names(names, have).collect()}
    assert got["hills"] == (2, "partial") and got["the xy town"] == (3, "partial") and got["a"] == (1, "partial") and got["AB"] == (1, "exact") and got["q"] == (None, "none")


def test_years_by_what_stands_around_them(spark):
    """Texts with every rule, and with what looks like one but isn't."""
    cases = {
        "2024-2025": ("2024-2025", "2024-2025"),
        "July 1, 2024 - June 30, 2025": ("2024-2025", "2025-2026"),
        "2024 , — about 2025": ("2024-2025", "2025-2026"),
        "2024 - a long way off from here 2025": ("2025-2026", "2025-2026"),
        "2023-2025 and 2024-2025": ("2025-2026", "2023-2025"),
        "Effective\n July 1 2027 or FY30": ("2027-2028", "2027-2028"),
        "EFFECTIVE march 31, 1999; 2020": ("1999-2000", "1999-2000"),
        "effective 2019, July 2018": ("2018-2019", "2018-2019"),
        "(July 2024)": ("2024-2025", "2024-2025"),
        "July, 2024 then 2021": ("2024-2025", "2024-2025"),
        "FY 2026": ("2025-2026", "2026-2027"),
        "fy26": ("2025-2026", None),
        "FY 9": ("unknown", None),
        "x2021y 2022": ("2022-2023", "2022-2023"),
        "12 of 345": ("2012-2013", None),
        "1066 - 1492": ("unknown", "1066-1492"),
        "": ("unknown", None),
        None: ("unknown", None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", scalars.school_year(F.col("text")).alias("year"), scalars.school_year_or_null(F.col("text")).alias("older"))
    assert {r.text: (r.year, r.older) for r in rows.collect()} == cases
    effect = spark.createDataFrame([(t,) for t in ("Effective July 1, 2020", "effective september 30 2021", "Effective August 1, 2020", "July 1, 2020")], "text string").select(scalars.effective_year(F.col("text")).alias("y"))
    assert [r.y for r in effect.collect()] == ["2020-2021", "2021-2022", None, None]


def test_custom_filter_without_towns_is_inactive(spark):
    rows = spark.createDataFrame([(1, "charter", ["A "]), (2, "charter", ["b"]), (3, "municipal", ["A"])], "district_id long, district_type string, towns array<string>")
    towns = lambda *names: spark.createDataFrame([(n,) for n in names], "town string")
    ids = lambda d: sorted(r.district_id for r in d.collect())
    assert ids(districts.custom_filter(rows, ["charter"], None, towns())) == ids(districts.custom_filter(rows, ["charter"], None, [])) == [1, 2]
    assert ids(districts.custom_filter(rows, ["charter"], [2], towns())) == [2]
    assert ids(districts.custom_filter(rows, None, None, towns("a"))) == [1, 3] and ids(districts.custom_filter(rows, None, [2], towns("a"))) == [1, 2, 3]


def test_import_beside_two_districts_of_one_name(spark):
    old = spark.createDataFrame([(9, "Ashby "), (4, "ASHBY"), (5, "Berlin")], "district_id long, name string")
    new = spark.createDataFrame([("ashby", 1), ("Ashby", 2), ("Canton", 3), (" ", 4)], "name string, pos long")
    got = sorted((r.pos, r.existing_id, r.status) for r in records.import_districts(old, new).collect())
    assert got == [(1, 4, "updated"), (2, 4, "duplicate"), (3, None, "created")]


def test_load_fails_by_batches(spark):
    rows = spark.createDataFrame([(i, "2020-2021", "Full Year", "X" if i in (7, 8, 30) else "M", 0, 1, 0.0 if i == 30 else 5.0) for i in range(1, 61)], "pos int, school_year string, period string, education string, credits int, step int, salary double")
    batches = records.load_batches(rows.repartition(5), checks.record_errors(), "pos", size=25)
    assert sorted((r.batch, r.n, r.written, r.failed, r.codes) for r in batches.collect()) == [(0, 25, 0, 25, ["education"]), (1, 25, 0, 25, ["education", "salary"]), (2, 10, 10, 0, [])]
    assert tuple(records.load_totals(batches).first()) == (10, 50, 2)
    assert records.load_batches(rows.limit(0), checks.record_errors(), "pos").count() == 0


def test_an_unknown_education_fails_the_load(spark):
    loaded = lambda *names: [r.e for r in spark.createDataFrame([(n,) for n in names], "education string").select(checks.known_education(F.col("education")).alias("e")).collect()]
    assert loaded("B", "D") == ["B", "D"]
    for bad in ("b", None):
        with pytest.raises(Exception, match=f"no such education: {bad or 'none'}"):
            loaded("B", bad)


def test_described_results_have_defaults(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "district_id long, towns string")
    dim = spark.createDataFrame([(1, "charter", "c.pdf", ["A"]), (2, None, None, None)], "district_id long, district_type string, contract_pdf string, towns array<string>")
    got = sorted((r.district_id, r.district_type, r.contract_pdf, r.towns) for r in districts.described(rows, dim).collect())
    assert got == [(1, "charter", "c.pdf", ["A"]), (2, "unknown", None, []), (3, "unknown", None, [])]


def test_rows_as_json_and_status_of_a_job(spark):
    import json
    from decimal import Decimal

    from gridspan.operators import cells
    from gridspan.streaming import jobs

    rows = spark.createDataFrame([("d1", Decimal("50000.50"), None, ["a"])], "id string, salary decimal(12,2), note string, towns array<string>")
    assert [json.loads(r.json) for r in cells.as_json(rows).collect()] == [{"id": "d1", "salary": 50000.50, "towns": ["a"]}]
    events = spark.createDataFrame([(1, 1, "pending"), (1, 2, "processing"), (2, 1, "completed"), (3, 1, "completed"), (3, 2, "deleted")], "job_id long, seq long, status string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [[r.status for r in jobs.status_of(events, j).collect()] for j in (1, 2, 3, 4)] == [["processing"], ["completed"], [], []]


def test_picked_credits(spark):
    rows = spark.createDataFrame([(15, [0, 15, 30]), (20, [30, 15]), (20, []), (20, None)], "wanted int, options array<int>")
    assert [r.c for r in rows.select(scalars.pick_credits(F.col("wanted"), F.col("options")).alias("c")).collect()] == [15, 15, 20, 20]


def test_ids_from_outside(spark):
    cases = {"0f60fef3-cee7": [], "DISTRICT#abc-1": [], " DISTRICT%23a ": [], "district#a": ["id"], "a b": ["id"], "DISTRICT#": ["id"], "": ["id_missing"], None: ["id_missing"], "a" * 101: ["id_long"]}
    rows = spark.createDataFrame([(k,) for k in cases], "id string").select("id", checks.id_errors(F.col("id")).alias("e"))
    assert {r.id: r.e for r in rows.collect()} == cases
