"""Every query of the library beside its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from gridspan.plans import fixtures
from gridspan.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(float(value)) else round(float(value), 6)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sql, name):
    want = sql.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_queries_without_sql_have_rows(spark):
    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, SF).count() > 0, name


def test_fill_of_the_whole_grid(spark):
    """Every missing lane is filled from the whole grid, and what is filled within lanes is what ``fill_down`` fills."""
    lane = ["district_id", "school_year", "period", "education", "credits"]
    real = {tuple(r) for r in QUERIES["cells_base"](spark, SF).select(*lane).distinct().collect()}
    missing = {(*s, *c) for s in {x[:3] for x in real} for c in {x[3:] for x in real}} - real
    right, full, down = ({tuple(r) for r in QUERIES[q](spark, SF).select(*lane, "step", "root_education", "root_credits", "root_step").collect()} for q in ("fill_right", "fill_full", "fill_down"))
    assert {r[:5] for r in right} == missing and len(missing) == 1313
    assert full == right | down
    counts = {(r.education, r.root_education): r.n for r in QUERIES["fill_counts_by_source"](spark, SF).collect()}
    assert sum(counts.values()) == len(full)
    assert QUERIES["highlight_lookup"](spark, SF).count() == len({x[:3] for x in real})


@pytest.mark.parametrize("name", ["fill_right", "fill_full", "fill_counts_by_source", "highlight_lookup"])
def test_fill_of_a_sparse_grid(spark, sql, monkeypatch, name):
    """The same over a grid in which whole educations are missing."""
    monkeypatch.setattr(fixtures, "cells", lambda spark, sf_dir, whole=fixtures.cells: whole(spark, sf_dir).filter(fixtures.SPARSE))
    text = SQL[name].replace(fixtures.CELLS, fixtures.CELLS.replace("cells AS (", "every_cell AS (") + f", cells AS (SELECT * FROM every_cell WHERE {fixtures.SPARSE.replace(' div ', ' // ')})")
    want = sql.sql(text)
    rows = [tuple(plain(r[c]) for c in want.columns) for r in QUERIES[name](spark, SF).collect()]
    assert rows and sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_lane_labels_read_listed_labels_beside_made_ones(spark):
    """Each part has a label of either kind: none of the spellings, signs and numbers of the list is left out."""
    rows = QUERIES["lane_labels"](spark, SF).collect()
    assert len(rows) == 2 * spark.read.parquet(f"{SF}/part.parquet").count()
    found = {(r.key, r.education, r.credits) for r in rows}
    assert {("CAGS", "M", 60), ("MA+36", "M", 36), ("MA+10", "M", 10), ("MA+60", "M", 60), ("LANE12", None, None), (None, None, None)} <= found
