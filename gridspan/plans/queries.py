"""Every operator as a query over the test tables, beside its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks, lanes, scalars
from ..operators import cells as grid
from ..operators import compare, coverage, districts, fill, paging, parsing, quantiles, ranking, records, tables
from ..streaming import jobs, metadata, state, windows
from ..session import scratch
from ..sources.layout import mark_of
from . import apply, fixtures
from .fixtures import CELLS, DISTRICTS, JOB_EVENTS, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def money(c="salary"):
    return F.col(c).cast("double").alias(c)


def joined(c: str, sep: str = ","):
    return F.concat_ws(sep, F.transform(c, lambda x: x.cast("string"))).alias(c)


# -- the model --------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells")
def cells_base(spark, sf_dir):
    """The grid made from ``lineitem``; all other queries read it where it is stored."""
    return fixtures.cells_of_lines(spark, sf_dir).withColumn("salary", money())


@query(f"WITH {DISTRICTS} SELECT district_id, name, district_type, array_to_string(towns, ',') AS towns FROM districts")
def district_dim(spark, sf_dir):
    return fixtures.districts_of_suppliers(spark, sf_dir).withColumn("towns", joined("towns"))


@query(f"WITH {DISTRICTS} SELECT district_id, name AS district_name, unnest(towns) AS town FROM districts")
def town_bridge(spark, sf_dir):
    return districts.town_bridge(fixtures.districts(spark, sf_dir)).drop("pos")


# -- comparison -------------------------------------------------------------------------------

_COMPARE = """WITH {cells}, {districts},
a AS (SELECT * FROM cells WHERE education = '{e}' AND credits = {c} AND step = {s} {more}),
o AS (SELECT *, row_number() OVER (ORDER BY salary DESC, school_year, district_id, period) AS pos FROM a),
p AS (SELECT *, min(pos) OVER (PARTITION BY district_id) AS first_pos, row_number() OVER (PARTITION BY district_id ORDER BY {keep}) AS n FROM o),
r AS (SELECT p.*, name, district_type FROM p JOIN districts USING (district_id) WHERE n = 1 AND district_type IN ('municipal', 'regional_academic') {kind})
SELECT CAST(row_number() OVER (ORDER BY {rank}) AS INTEGER) AS rank, district_id, name AS district_name, district_type, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM r"""


def _compare_sql(e="M", c=30, s=5, more="", keep="school_year, period", rank="first_pos", kind="") -> str:
    return _COMPARE.format(cells=CELLS, districts=DISTRICTS, e=e, c=c, s=s, more=more, keep=keep, rank=rank, kind=kind)


def _compared(spark, sf_dir, e="M", c=30, s=5, **options):
    return compare.compare(fixtures.cells(spark, sf_dir), fixtures.districts(spark, sf_dir), e, c, s, **options)


def _flat(ranked):
    return ranked.drop("towns").withColumn("salary", money())


@query(_compare_sql())
def compare_exact(spark, sf_dir):
    return _flat(_compared(spark, sf_dir))


@query(_compare_sql(keep="school_year DESC, period DESC"))
def compare_latest(spark, sf_dir):
    return _flat(_compared(spark, sf_dir, keep="latest"))


@query(_compare_sql(rank="salary DESC, school_year, district_id, period"))
def compare_by_salary(spark, sf_dir):
    return _flat(_compared(spark, sf_dir, rank_by="salary"))


@query(_compare_sql(more="AND school_year = '1997-1998'"))
def compare_strict_year(spark, sf_dir):
    return _flat(_compared(spark, sf_dir, year="1997-1998"))


@query(_compare_sql(kind="AND district_type = 'municipal'"))
def compare_type(spark, sf_dir):
    return _flat(_compared(spark, sf_dir, district_type="municipal"))


@query(f"WITH r AS ({_compare_sql()}) SELECT arg_min(salary, rank) AS highest, arg_max(salary, rank) AS lowest, count(*) AS n, round(arg_min(salary, rank) - arg_max(salary, rank), 2) AS difference FROM r")
def compare_spread(spark, sf_dir):
    out = compare.spread_of(_compared(spark, sf_dir))
    return out.select(*[money(c) for c in ("highest", "lowest", "difference")], "n")


@query(_compare_sql(e="D", c=40, s=3))
def compare_fallback(spark, sf_dir):
    """A lane that nobody has, D+43, resolved to the best one below."""
    cells = fixtures.cells(spark, sf_dir)
    combos = cells.select(grid.lane_key().alias("k")).distinct()
    e, c, _ = compare.resolve_lane([r[0] for r in combos.collect()], "D", 43)
    return _flat(compare.compare(cells, fixtures.districts(spark, sf_dir), e, c, 3))


@query(f"""WITH {CELLS}, combos AS (SELECT DISTINCT education, credits FROM cells WHERE NOT (education = 'D' AND credits > 20) AND NOT (education = 'M' AND credits < 10)),
targets AS (SELECT e AS education, CAST(c AS INTEGER) AS credits FROM (VALUES ('B'), ('M'), ('D')) t(e), range(0, 60, 7) r(c)),
ranked AS (SELECT t.education, t.credits, k.education AS qe, k.credits AS qc, k.education = t.education AND k.credits = t.credits AS exact,
  row_number() OVER (PARTITION BY t.education, t.credits ORDER BY k.education = t.education AND k.credits = t.credits DESC, CASE k.education WHEN 'B' THEN 1 WHEN 'M' THEN 2 ELSE 3 END DESC, k.credits DESC) AS n
  FROM targets t LEFT JOIN combos k ON CASE k.education WHEN 'B' THEN 1 WHEN 'M' THEN 2 ELSE 3 END <= CASE t.education WHEN 'B' THEN 1 WHEN 'M' THEN 2 ELSE 3 END AND (k.education <> t.education OR k.credits <= t.credits))
SELECT education, credits, qe AS query_education, qc AS query_credits, exact AS is_exact FROM ranked WHERE n = 1""")
def lane_resolution_all(spark, sf_dir):
    combos = fixtures.cells(spark, sf_dir).select("education", "credits").distinct().filter("NOT (education = 'D' AND credits > 20) AND NOT (education = 'M' AND credits < 10)")
    targets = spark.createDataFrame([(e, c) for e in "BMD" for c in range(0, 60, 7)], "education string, credits int")
    return compare.resolve_lanes(targets, combos)


# -- fill -------------------------------------------------------------------------------------

_DOWN = """
top AS (SELECT max(step) AS top FROM cells),
lanes AS MATERIALIZED (SELECT DISTINCT district_id, school_year, period, education, credits FROM {source}),
slots AS (SELECT l.*, CAST(s AS INTEGER) AS step FROM lanes l, top, unnest(range(1, top + 1)) u(s)),
placed AS (SELECT s.*, c.salary, CASE WHEN c.salary IS NOT NULL THEN s.step END AS own FROM slots s LEFT JOIN {source} c USING (district_id, school_year, period, education, credits, step)),
down AS MATERIALIZED (SELECT *,
  coalesce(last_value(salary IGNORE NULLS) OVER w, first_value(salary IGNORE NULLS) OVER v) AS value,
  coalesce(last_value(own IGNORE NULLS) OVER w, first_value(own IGNORE NULLS) OVER v) AS root_step
  FROM placed WINDOW w AS (PARTITION BY district_id, school_year, period, education, credits ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY district_id, school_year, period, education, credits ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_ROOTS = """
levels AS (SELECT * FROM (VALUES ('B', 1), ('M', 2), ('D', 3)) t(education, place)),
combos AS (SELECT DISTINCT education, credits FROM cells),
keys AS (SELECT DISTINCT district_id, school_year, period FROM cells),
reals AS MATERIALIZED (SELECT l.*, place FROM lanes l JOIN levels USING (education)),
gaps AS MATERIALIZED (SELECT k.*, c.education, c.credits, v.place FROM keys k, combos c JOIN levels v USING (education) ANTI JOIN lanes l ON l.district_id = k.district_id AND l.school_year = k.school_year AND l.period = k.period AND l.education = c.education AND l.credits = c.credits),
same AS (SELECT g.*, r.education AS root_e, r.credits AS root_c, row_number() OVER (PARTITION BY g.district_id, g.school_year, g.period, g.education, g.credits ORDER BY r.credits < g.credits DESC, CASE WHEN r.credits < g.credits THEN -r.credits ELSE r.credits END) AS n
  FROM gaps g JOIN reals r ON g.district_id = r.district_id AND g.school_year = r.school_year AND g.period = r.period AND g.education = r.education),
b AS MATERIALIZED (SELECT district_id, school_year, period, education, credits, place, root_e, root_c, 1 AS filled FROM same WHERE n = 1
  UNION ALL SELECT district_id, school_year, period, education, credits, place, education, credits, 0 FROM reals),
m_root AS (SELECT district_id, school_year, period, root_e, root_c FROM (SELECT *, row_number() OVER (PARTITION BY district_id, school_year, period ORDER BY credits DESC, filled, place) AS n FROM b WHERE place < 2) WHERE n = 1),
m AS (SELECT g.district_id, g.school_year, g.period, g.education, g.credits, g.place, r.root_e, r.root_c, 1 AS filled FROM gaps g JOIN m_root r USING (district_id, school_year, period)
  ANTI JOIN (SELECT DISTINCT district_id, school_year, period FROM reals WHERE education = 'M') x ON x.district_id = g.district_id AND x.school_year = g.school_year AND x.period = g.period WHERE g.education = 'M'),
bm AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT * FROM m),
d_root AS (SELECT district_id, school_year, period, root_e, root_c FROM (SELECT *, row_number() OVER (PARTITION BY district_id, school_year, period ORDER BY credits DESC, filled, place) AS n FROM bm WHERE place < 3) WHERE n = 1),
d AS (SELECT g.district_id, g.school_year, g.period, g.education, g.credits, g.place, r.root_e, r.root_c, 1 AS filled FROM gaps g JOIN d_root r USING (district_id, school_year, period)
  ANTI JOIN (SELECT DISTINCT district_id, school_year, period FROM reals WHERE education = 'D') x ON x.district_id = g.district_id AND x.school_year = g.school_year AND x.period = g.period WHERE g.education = 'D'),
filled AS (SELECT f.district_id, f.school_year, f.period, f.education, f.credits, down.step, down.value, f.root_e, f.root_c, down.root_step FROM (SELECT * FROM bm UNION ALL SELECT * FROM d) f
  JOIN down ON down.district_id = f.district_id AND down.school_year = f.school_year AND down.period = f.period AND down.education = f.root_e AND down.credits = f.root_c WHERE f.filled = 1)"""
_SHOW = "SELECT district_id, school_year, period, education, credits, step, CAST(value AS DOUBLE) AS salary, {e} AS root_education, {c} AS root_credits, CAST(root_step AS INTEGER) AS root_step FROM {source}"


def _filled(rows):
    return rows.select("district_id", "school_year", "period", "education", "credits", "step", money(), F.col("is_calculated_from.education").alias("root_education"), F.col("is_calculated_from.credits").alias("root_credits"), F.col("is_calculated_from.step").alias("root_step"))


@query(f"WITH {CELLS}, {_DOWN.format(source='cells')} {_SHOW.format(e='education', c='credits', source='down WHERE salary IS NULL')}")
def fill_down(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    top, _ = fill.combos_of(cells)
    return _filled(fill.fill_down(cells, top, dealt=True))


def _grid_fill(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    return cells, fill.fill_grid(cells, *fill.combos_of(cells), dealt=True)


@query(f"WITH {CELLS}, {_DOWN.format(source='cells')}, {_ROOTS} {_SHOW.format(e='root_e', c='root_c', source='filled')}")
def fill_right(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    return _filled(fill.fill_missing(cells, *fill.combos_of(cells), dealt=True))


@query(f"WITH {CELLS}, {_DOWN.format(source='cells')}, {_ROOTS}, every AS ({_SHOW.format(e='root_e', c='root_c', source='filled')} UNION ALL {_SHOW.format(e='education', c='credits', source='down WHERE salary IS NULL')}) SELECT * FROM every")
def fill_full(spark, sf_dir):
    return _filled(_grid_fill(spark, sf_dir)[1])


@query(f"WITH {CELLS}, {_DOWN.format(source='cells')}, {_ROOTS}, every AS ({_SHOW.format(e='root_e', c='root_c', source='filled')} UNION ALL {_SHOW.format(e='education', c='credits', source='down WHERE salary IS NULL')}) SELECT education, root_education, count(*) AS n, count(DISTINCT (district_id, school_year, period)) AS schedules FROM every GROUP BY ALL")
def fill_counts_by_source(spark, sf_dir):
    return _filled(_grid_fill(spark, sf_dir)[1]).groupBy("education", "root_education").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("district_id", "school_year", "period").alias("schedules"))


@query(f"WITH {CELLS}, {_DOWN.format(source='cells')}, {_ROOTS}, every AS ({_SHOW.format(e='root_e', c='root_c', source='filled')} UNION ALL {_SHOW.format(e='education', c='credits', source='down WHERE salary IS NULL')} UNION ALL SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE), education, credits, step FROM cells) SELECT district_id, school_year, period, root_education AS education, root_credits AS credits, CAST(root_step AS INTEGER) AS step, salary FROM every WHERE education = 'M' AND credits = 30 AND step = 4")
def highlight_lookup(spark, sf_dir):
    cells, rows = _grid_fill(spark, sf_dir)
    whole = cells.select("*", F.lit(False).alias("is_calculated")).unionByName(rows, allowMissingColumns=True)
    return grid.highlight(whole, "M", 30, 4).withColumn("salary", money())


# -- schedules and metadata -------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT district_id, school_year, period, string_agg(education || '+' || credits || ':' || step, ',' ORDER BY education, credits, step) AS cells, count(*) AS n_cells FROM cells GROUP BY ALL")
def schedule_nested(spark, sf_dir):
    nested = grid.nested_schedules(fixtures.cells(spark, sf_dir))
    text = F.transform("cells", lambda c: F.concat(c["education"], F.lit("+"), c["credits"].cast("string"), F.lit(":"), c["step"].cast("string")))
    return nested.withColumn("cells", F.concat_ws(",", text))


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells WHERE district_id = 7 AND school_year LIKE '1998%'")
def schedule_of_district(spark, sf_dir):
    return grid.schedule_of(fixtures.cells(spark, sf_dir), 7, "1998").withColumn("salary", money())


@query(f"WITH {CELLS}, s AS (SELECT DISTINCT school_year, period FROM cells) SELECT school_year, period, CAST(row_number() OVER (ORDER BY CAST(substr(school_year, 1, 4) AS INTEGER), period DESC) AS INTEGER) AS place FROM s")
def schedule_catalogue(spark, sf_dir):
    found = fixtures.cells(spark, sf_dir).select("school_year", "period").distinct()
    return ranking.numbered(found, *grid.schedule_order(), name="place")


@query(f"WITH {CELLS} SELECT district_id, CAST(min(salary) AS DOUBLE) AS min_salary, CAST(max(salary) AS DOUBLE) AS max_salary, max(school_year) AS latest_year, array_to_string(list_sort(list(DISTINCT school_year)), ',') AS years, count(DISTINCT (school_year, period)) AS n_schedules FROM cells GROUP BY 1")
def district_metadata(spark, sf_dir):
    out = grid.district_metadata(fixtures.cells(spark, sf_dir))
    return out.select("district_id", money("min_salary"), money("max_salary"), "latest_year", joined("years"), F.size("schedules").cast("long").alias("n_schedules"))


@query(f"WITH {CELLS} SELECT max(step) AS max_step, array_to_string(list_sort(list(DISTINCT education || '+' || credits)), ',') AS combos FROM cells")
def global_maxima(spark, sf_dir):
    return grid.global_maxima(fixtures.cells(spark, sf_dir)).withColumn("combos", joined("combos"))


@query(f"WITH {CELLS} SELECT max(step) AS max_step, array_to_string(list_sort(list(DISTINCT education || '+' || credits)), ',') AS combos FROM cells")
def maxima_merge(spark, sf_dir):
    """Maxima of the earlier years and of the later ones, together."""
    cells = fixtures.cells(spark, sf_dir)
    merged = grid.merged_maxima(grid.global_maxima(cells.filter("school_year < '1996'")), grid.global_maxima(cells.filter("school_year >= '1996'")))
    return merged.withColumn("combos", joined("combos"))


@query(f"""WITH {CELLS}, g AS (SELECT list(DISTINCT education || '+' || credits) AS combos, max(step) AS top FROM cells WHERE school_year < '1996' AND step < 6),
d AS (SELECT district_id, list(DISTINCT education || '+' || credits) AS combos, max(step) AS top FROM cells GROUP BY 1)
SELECT district_id, d.top > g.top OR len(list_filter(d.combos, lambda x: NOT list_contains(g.combos, x))) > 0 AS changed FROM d, g""")
def metadata_change(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    old = grid.global_maxima(cells.filter("school_year < '1996' AND step < 6")).first()
    new = cells.groupBy("district_id").agg(F.max("step").alias("top"), F.collect_set(grid.lane_key()).alias("combos"))
    change = grid.metadata_change(F.lit(old["max_step"]), F.array(*map(F.lit, old["combos"])), F.col("top"), F.col("combos"))
    return new.select("district_id", change["changed"].alias("changed"))


@query(f"WITH {CELLS} SELECT school_year, period, district_id, education || '+' || credits AS combo, max(step) AS max_step FROM cells GROUP BY ALL")
def availability(spark, sf_dir):
    """Through the map form and back."""
    return grid.availability(fixtures.cells(spark, sf_dir)).select("school_year", "period", "district_id", F.explode("lanes").alias("combo", "max_step"))


_KEPT = f"WITH {CELLS}, kept AS (SELECT * FROM cells WHERE district_id % 5 <> 3 AND (district_id % 2 = 0 OR education <> 'D')), facts AS (SELECT school_year, period, district_id, education || '+' || credits AS combo, max(step) AS max_step FROM kept GROUP BY ALL)"


_kept_roots: dict[tuple, str] = {}


def _kept_up(spark, sf_dir):
    """Where metadata was kept up, once an application: a first load and three changes: other cells for every second district, back to the first for some, every fifth removed; the second comes twice."""
    cells, key = fixtures.cells(spark, sf_dir), (spark.sparkContext.applicationId, mark_of(spark, f"{sf_dir}/lineitem.parquet"))
    root = _kept_roots.get(key)
    if root is not None and metadata.versions(spark, root) == [0, 1, 2, 3]:
        return root
    root = _kept_roots[key] = scratch(spark, "metadata")
    odd = cells.filter("district_id % 2 = 1")
    changes = [metadata.changes_of(cells, 0), metadata.changes_of(odd.filter("education = 'B'"), 1), metadata.changes_of(odd.filter("education <> 'D'"), 2), metadata.removals_of(cells.filter("district_id % 5 = 3").select("district_id").distinct(), 3)]
    for version in (0, 1, 1, 2, 3):
        metadata.apply_changes(changes[version], version, root)
    return root


@query(f"{_KEPT} SELECT * FROM facts")
def availability_kept_up(spark, sf_dir):
    return metadata.availability_now(spark, _kept_up(spark, sf_dir))


@query(f"{_KEPT} SELECT school_year, period, count(DISTINCT district_id) AS n_districts FROM facts GROUP BY ALL")
def catalogue_kept_up(spark, sf_dir):
    return metadata.catalogue_now(spark, _kept_up(spark, sf_dir))


@query(f"{_KEPT} SELECT max(max_step) AS max_step, array_to_string(list_sort(list(DISTINCT combo)), ',') AS combos FROM facts")
def maxima_kept_up(spark, sf_dir):
    return metadata.maxima_now(spark, _kept_up(spark, sf_dir)).withColumn("combos", joined("combos"))


@query(f"WITH {CELLS} SELECT education, array_to_string(list_sort(list(DISTINCT credits)), ',') AS credits FROM cells GROUP BY 1")
def lane_options(spark, sf_dir):
    return grid.lane_options(fixtures.cells(spark, sf_dir)).withColumn("credits", joined("credits"))


_LANES = [f"{e}+{c}" for e in "BMD" for c in range(0, 45, 5)]


@query(f"WITH {CELLS} SELECT district_id, school_year, period, step, " + ", ".join(f"CAST(max(salary) FILTER (education || '+' || credits = '{x}') AS DOUBLE) AS \"{x}\"" for x in _LANES) + " FROM cells GROUP BY ALL")
def grid_pivot(spark, sf_dir):
    out = grid.pivot_grid(fixtures.cells(spark, sf_dir), _LANES)
    return out.select("district_id", "school_year", "period", "step", *[F.col(f"`{x}`").cast("double").alias(x) for x in _LANES])


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells")
def grid_unpivot(spark, sf_dir):
    return grid.unpivot_grid(grid.pivot_grid(fixtures.cells(spark, sf_dir), _LANES), _LANES).withColumn("salary", money())


_CALC = "(district_id + credits + step) % 3 > 0"


@query(f"""WITH {CELLS}, f AS (SELECT *, {_CALC} AS calc FROM cells), l AS (SELECT *, min(calc) OVER (PARTITION BY district_id, school_year, period, education, credits) AS lane_calc FROM f),
s AS (SELECT *, min(calc) OVER (PARTITION BY district_id, school_year, period, step) AS step_calc FROM l WHERE NOT lane_calc) SELECT district_id, school_year, period, education, credits, step FROM s WHERE NOT step_calc""")
def suppress_calculated(spark, sf_dir):
    flagged = fixtures.cells(spark, sf_dir).withColumn("is_calculated", F.expr(_CALC))
    return grid.suppress_calculated(flagged, dealt=True).select("district_id", "school_year", "period", "education", "credits", "step")


# -- districts --------------------------------------------------------------------------------


@query(f"WITH {DISTRICTS} SELECT district_id, name, CAST(CASE WHEN contains(lower(name), '00000001') THEN 1 ELSE 2 END AS INTEGER) AS source FROM districts WHERE contains(lower(name), '00000001')")
def search_name(spark, sf_dir):
    return districts.search(fixtures.districts(spark, sf_dir), "00000001").select("district_id", "name", "source")


@query(f"""WITH {DISTRICTS}, t AS (SELECT min(u) AS town FROM (SELECT unnest(towns) AS u FROM districts)), n AS (SELECT district_id, CASE WHEN district_id % 3 = 0 THEN 'School of ' || upper(town) ELSE name END AS name, towns, town FROM districts, t),
f AS (SELECT district_id, name, CAST(CASE WHEN contains(lower(name), lower(town)) THEN 1 ELSE 2 END AS INTEGER) AS source FROM n WHERE contains(lower(name), lower(town)) OR list_contains(towns, town)) SELECT *, row_number() OVER (ORDER BY source, lower(name), district_id) AS place FROM f""")
def search_union(spark, sf_dir):
    """Districts that are named after a town, then those that have it."""
    rows = fixtures.districts(spark, sf_dir)
    town = rows.select(F.explode("towns").alias("town")).agg(F.min("town")).first()[0]
    named = rows.withColumn("name", F.when(F.col("district_id") % 3 == 0, F.concat(F.lit("School of "), F.lit(town.upper()))).otherwise(F.col("name")))
    found = districts.search(named, town.upper())
    return found.select("district_id", "name", "source", F.row_number().over(Window.orderBy("source", F.lower("name"), "district_id")).cast("long").alias("place"))


@query(f"WITH {DISTRICTS} SELECT district_id, name FROM districts WHERE list_contains(towns, (SELECT min(c_name) FROM customer WHERE c_nationkey = 3))")
def by_town(spark, sf_dir):
    town = read(spark, sf_dir, "customer").filter("c_nationkey = 3").agg(F.min("c_name")).first()[0]
    return districts.by_town(fixtures.districts(spark, sf_dir), town or "").select("district_id", "name")


@query(f"WITH {DISTRICTS} SELECT district_id, name, (SELECT count(*) FROM districts) AS total FROM districts ORDER BY lower(name), district_id LIMIT 10 OFFSET 5")
def list_page(spark, sf_dir):
    return districts.page(districts.listed(fixtures.districts(spark, sf_dir)), 5, 10).select("district_id", "name", "total")


@query(f"WITH {DISTRICTS} SELECT district_id, name, district_type FROM districts ORDER BY district_type DESC, lower(name), district_id LIMIT 3 OFFSET 6")
def page_by_key(spark, sf_dir):
    """The third page, reached by the tokens of the first two."""
    rows, token = fixtures.districts(spark, sf_dir).withColumn("folded", F.lower("name")), None
    keys = [paging.Key("district_type", falls=True), paging.Key("folded"), paging.Key("district_id")]
    for _ in range(2):
        _, token = paging.page_and_token(rows, keys, 3, token)
    return paging.page(rows, keys, 3, token).select("district_id", "name", "district_type")


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells WHERE district_id = 7 ORDER BY school_year, period, education, credits, step LIMIT 50 OFFSET 100")
def schedule_page(spark, sf_dir):
    """A district's cells, a page of 50 at a time: the third."""
    rows, token = grid.schedule_of(fixtures.cells(spark, sf_dir), 7), None
    keys = [paging.Key(c) for c in ("school_year", "period", "education", "credits", "step")]
    for _ in range(2):
        _, token = paging.page_and_token(rows, keys, 50, token)
    return paging.page(rows, keys, 50, token).withColumn("salary", money())


@query(f"WITH {DISTRICTS} SELECT district_id, name, district_type, CAST(CASE district_type WHEN 'municipal' THEN 1 WHEN 'regional_academic' THEN 2 WHEN 'regional_vocational' THEN 3 WHEN 'county_agricultural' THEN 4 WHEN 'charter' THEN 5 ELSE 99 END AS INTEGER) AS place FROM districts")
def sort_type_name(spark, sf_dir):
    return districts.by_type_and_name(fixtures.districts(spark, sf_dir)).select("district_id", "name", "district_type", "place")


@query(f"WITH {DISTRICTS} SELECT lower(trim(t)) AS key, string_agg(CAST(district_id AS VARCHAR), ',' ORDER BY district_id) AS district_ids FROM (SELECT district_id, unnest(towns) AS t FROM districts) GROUP BY 1")
def town_index(spark, sf_dir):
    return districts.towns_index(fixtures.districts(spark, sf_dir)).select("key", joined("district_ids"))


@query(f"WITH {DISTRICTS}, r AS ({_compare_sql()}), k AS (SELECT r.rank, r.district_id FROM r JOIN districts d USING (district_id) WHERE d.district_type = 'municipal' AND (district_id IN (1, 2, 3) OR len(list_filter(d.towns, lambda t: lower(t) LIKE '%1')) > 0)) SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, district_id FROM k")
def custom_filter(spark, sf_dir):
    names = read(spark, sf_dir, "customer").filter("c_name LIKE '%1'").select(F.col("c_name").alias("town"))
    return districts.reranked(districts.custom_filter(_compared(spark, sf_dir), ["municipal"], [1, 2, 3], names)).select("rank", "district_id")


@query(f"""WITH {DISTRICTS}, b AS (SELECT DISTINCT lower(trim(unnest(towns))) AS key, name FROM districts), i AS (SELECT key, list_sort(list(name)) AS names FROM b GROUP BY 1)
SELECT c_name AS town, array_to_string(coalesce(list_slice(names, 1, 5), []), ',') AS names, CAST(greatest(coalesce(len(names), 0) - 5, 0) AS INTEGER) AS more FROM customer LEFT JOIN i ON lower(trim(c_name)) = key""")
def town_tooltip(spark, sf_dir):
    return districts.tooltip(read(spark, sf_dir, "customer").select(F.col("c_name").alias("town")), fixtures.districts(spark, sf_dir)).withColumn("names", joined("names"))


# -- coverage ---------------------------------------------------------------------------------


@query(f"WITH {CELLS}, {DISTRICTS} SELECT district_id, name, district_type FROM districts WHERE district_type IN ('municipal', 'regional_academic') AND district_id NOT IN (SELECT district_id FROM cells WHERE school_year = '1995-1996' AND period = '10-month')")
def missing_contracts(spark, sf_dir):
    return coverage.missing_contracts(fixtures.districts(spark, sf_dir), fixtures.cells(spark, sf_dir), "1995-1996", "10-month").select("district_id", "name", "district_type")


@query(f"WITH {CELLS}, {DISTRICTS}, l AS (SELECT DISTINCT district_id, school_year, education || '+' || credits AS period FROM cells), s AS (SELECT DISTINCT school_year, period FROM l) SELECT d.district_id, name, s.school_year, s.period FROM districts d, s ANTI JOIN l c ON c.district_id = d.district_id AND c.school_year = s.school_year AND c.period = s.period WHERE district_type IN ('municipal', 'regional_academic')")
def missing_by_schedule(spark, sf_dir):
    """What eligible districts lack of all schedules that there are, a lane standing for a period."""
    lanes_ = fixtures.cells(spark, sf_dir).withColumn("period", grid.lane_key())
    return coverage.missing_by_schedule(fixtures.districts(spark, sf_dir), lanes_).select("district_id", "name", "school_year", "period")


@query(f"WITH {CELLS}, {DISTRICTS} SELECT district_id, name FROM districts WHERE district_id IN (SELECT district_id FROM cells WHERE school_year = '1996-1997' AND period = 'Full Year')")
def available_semi(spark, sf_dir):
    return coverage.present(fixtures.districts(spark, sf_dir), fixtures.cells(spark, sf_dir), "1996-1997", "Full Year").select("district_id", "name")


@query(f"WITH {CELLS}, {DISTRICTS}, h AS (SELECT DISTINCT district_id FROM cells WHERE school_year = '1995-1996') SELECT district_type, count(*) AS n, count(h.district_id) AS with_data, count(*) - count(h.district_id) AS missing FROM districts LEFT JOIN h USING (district_id) GROUP BY 1")
def type_breakdown(spark, sf_dir):
    return coverage.by_type(fixtures.districts(spark, sf_dir), fixtures.cells(spark, sf_dir), "1995-1996")


@query(f"WITH {CELLS} SELECT school_year, period, count(DISTINCT district_id) AS districts, count(DISTINCT (education, credits)) AS lanes, count(*) AS cells FROM cells GROUP BY ALL")
def coverage_report(spark, sf_dir):
    return coverage.report(fixtures.cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT district_id, count(*) AS records, array_to_string(list_sort(list(DISTINCT school_year)), ',') AS years FROM cells GROUP BY 1")
def record_counts(spark, sf_dir):
    return coverage.record_counts(fixtures.cells(spark, sf_dir)).withColumn("years", joined("years"))


@query("SELECT count(*) AS found, 156 - count(*) AS missing FROM supplier")
def backup_completeness(spark, sf_dir):
    return coverage.completeness(read(spark, sf_dir, "supplier"), 156)


@query("SELECT event_type AS method, count(*) AS total, CAST(count_if(value > 20) AS BIGINT) AS successful, CAST(count_if(NOT value > 20) AS BIGINT) AS failed FROM events GROUP BY 1")
def batch_summary(spark, sf_dir):
    return coverage.batch_summary(read(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("value") > 20).alias("success")))


@query(f"WITH {DISTRICTS} SELECT name AS \"District Name\", district_type AS \"Type\", CASE WHEN len(towns) = 0 THEN 'N/A' ELSE array_to_string(towns, '; ') END AS \"Towns\" FROM districts")
def csv_export(spark, sf_dir):
    return coverage.missing_as_csv(fixtures.districts(spark, sf_dir))


# -- scalars ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN p IS NULL OR trim(p) = '' OR trim(translate(lower(trim(p)), '-_', '  ')) IN ('full year', 'fy', 'fullyear') THEN 'Full Year' ELSE p END AS period
FROM (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'FY' WHEN 1 THEN 'full_year' WHEN 2 THEN ' ' WHEN 3 THEN NULL WHEN 4 THEN 'Full-Year' WHEN 5 THEN '10-month' WHEN 6 THEN 'FULLYEAR' WHEN 7 THEN 'fy' ELSE o_orderpriority END AS p FROM orders)""")
def period_norm(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    texts = {0: "FY", 1: "full_year", 2: " ", 4: "Full-Year", 5: "10-month", 6: "FULLYEAR", 7: "fy"}
    p = F.when(k == 8, F.col("o_orderpriority"))
    for i, t in texts.items():
        p = F.when(k == i, t).otherwise(p)
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.normalize_period(p).alias("period"))


@query("""WITH t AS (SELECT o_orderkey, year(o_orderdate) + 10 AS y, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN y || '-' || (y + 1) WHEN 1 THEN y || '-' || (y + 1) WHEN 2 THEN y || '-' || (y + 1) WHEN 3 THEN (y - 1) || '-' || y WHEN 4 THEN y || '-' || (y + 1) ELSE 'unknown' END AS school_year FROM t""")
def school_year_from_text(spark, sf_dir):
    y = F.year("o_orderdate") + 10
    s, k = y.cast("string"), F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("Schedule "), s, F.lit(" – June "), (y + 1).cast("string"))).when(k == 1, F.concat(F.lit("Effective July 1, "), s)).when(k == 2, F.concat(F.lit("september "), s, F.lit(" 1999"))).when(k == 3, F.concat(F.lit("FY"), F.substring(s, 3, 2))).when(k == 4, F.concat(F.lit("in 1999 and "), s)).otherwise(F.lit("no year"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.school_year(text).alias("school_year"))


@query("SELECT p_partkey, CASE WHEN p_retailprice * 37 BETWEEN 20000 AND 200000 THEN round(p_retailprice * 37, 2) END AS salary, CAST(9999999999 - CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS sort_key FROM part")
def salary_parse(spark, sf_dir):
    text = F.concat(F.lit(" $"), F.format_number(F.round(F.col("p_retailprice") * 37, 2), 2))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.parse_salary(text).cast("double").alias("salary"), scalars.salary_key(F.col("p_retailprice")).alias("sort_key"))


@query("SELECT p_partkey, CASE WHEN p_size <= 35 THEN p_size END AS step, p_size <= 50 AS marker, 'Step ' || p_size AS label FROM part")
def step_parse(spark, sf_dir):
    label = F.concat(F.lit("Step "), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.extract_step(label).alias("step"), scalars.is_step_marker(F.col("p_size").cast("string")).alias("marker"), label.alias("label"))


@query("SELECT p_partkey, '$' || format('{:,.2f}', round(p_retailprice, 2)) AS price, lpad(CAST(p_size AS VARCHAR), 3, '0') AS padded FROM part")
def currency(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.currency(F.col("p_retailprice")).alias("price"), scalars.pad_number(F.col("p_size"), 3).alias("padded"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'M' END AS education, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 0 ELSE 60 END AS INTEGER) AS credits FROM part")
def lane_tokens(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Bachelor's + ("), size, F.lit(")"))).when(k == 1, F.concat(F.lit("M.A. - "), size)).when(k == 2, "Doctorate").otherwise("CAGS")
    text = F.regexp_replace(text, "'s", "s")
    return read(spark, sf_dir, "part").select("p_partkey", lanes.lane_of(text).alias("lane")).select("p_partkey", "lane.*")


# -- records and changes ----------------------------------------------------------------------


@query("""WITH r AS (SELECT l_suppkey AS district_id, l_linenumber AS step, l_extendedprice AS salary, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) SELECT district_id, step, salary FROM r WHERE n = 1""")
def dedupe_first(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("district_id"), F.col("l_linenumber").alias("step"), F.col("l_extendedprice").alias("salary"), F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"))
    return records.first_of_key(rows, ["district_id", "step"]).drop("pos")


@query(f"""WITH {CELLS}, p AS (SELECT * EXCLUDE (school_year), CAST(substr(school_year, 1, 4) AS INTEGER) - CASE WHEN district_id % 3 = 2 THEN 10 ELSE 0 END AS y FROM cells), f AS (SELECT *, max(y >= 1997) OVER (PARTITION BY district_id) AS now, max(y) OVER (PARTITION BY district_id) AS latest FROM p)
SELECT district_id, y || '-' || (y + 1) AS school_year, count(*) AS n FROM f WHERE CASE WHEN now THEN y >= 1997 ELSE y = latest END GROUP BY ALL""")
def relevant_years(spark, sf_dir):
    """Every third district's years lie ten years back, so that none of its is current."""
    cells = fixtures.cells(spark, sf_dir)
    y = F.substring("school_year", 1, 4).cast("int") - F.when(F.col("district_id") % 3 == 2, 10).otherwise(0)
    rows = cells.withColumn("school_year", F.concat_ws("-", y.cast("string"), (y + 1).cast("string")))
    return records.relevant_years(rows, 1997, ["district_id"]).groupBy("district_id", "school_year").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT l_suppkey AS doc_id, l_linenumber AS tier, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT doc_id, coalesce(min(CASE WHEN n >= 70 THEN tier END), max(tier)) AS tier FROM t GROUP BY 1)
SELECT doc_id, CAST(tier AS INTEGER) AS tier, n FROM t JOIN c USING (doc_id, tier)""")
def tier_choice(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("tier"))
    return records.choose_tier(rows, 70).groupBy("doc_id", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step FROM cells WHERE step NOT IN (1, 2) AND NOT (education = 'B' AND credits = 0) AND NOT (education = 'M' AND credits = 15)")
def exclusions(spark, sf_dir):
    return records.without(fixtures.cells(spark, sf_dir), [1, 2], ["B", "M+15"]).drop("salary")


@query(f"WITH {CELLS}, n AS (SELECT district_id, school_year, period, education, credits, step, salary + 1 AS salary FROM cells WHERE district_id % 10 = 0 AND step < 3) SELECT district_id, education, step, CAST(sum(salary) AS DOUBLE) AS total, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM cells ANTI JOIN n USING (district_id, school_year, period, education, credits, step)) GROUP BY ALL")
def upsert_keys(spark, sf_dir):
    from ..schemas import CELL_KEY

    cells = fixtures.cells(spark, sf_dir)
    new = cells.filter("district_id % 10 = 0 AND step < 3").withColumn("salary", (F.col("salary") + 1).cast("decimal(12,2)"))
    return apply.upsert(cells, new, CELL_KEY).groupBy("district_id", "education", "step").agg(F.sum("salary").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CELLS}, n AS (SELECT * FROM cells WHERE district_id < 5 AND education = 'B') SELECT district_id, count(*) AS n, CAST(sum(salary) AS DOUBLE) AS total FROM (SELECT * FROM cells WHERE district_id NOT IN (SELECT district_id FROM n) UNION ALL SELECT * FROM n) GROUP BY 1")
def replace_partition(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir)
    out = apply.replace_districts(cells, cells.filter("district_id < 5 AND education = 'B'"))
    return out.groupBy("district_id").agg(F.count(F.lit(1)).alias("n"), F.sum("salary").cast("double").alias("total"))


@query("SELECT s_suppkey AS district_id, CASE WHEN s_suppkey % 4 = 0 THEN 'new ' || s_name ELSE s_name END AS name, s_acctbal AS balance FROM supplier")
def partial_update(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    changes = rows.filter("district_id % 4 = 0").select("district_id", F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("double").alias("balance"))
    return apply.patch(rows, changes, "district_id", ["name", "balance"])


@query(f"WITH {CELLS} SELECT district_id, count(*) AS n FROM cells WHERE district_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY 1")
def cascade_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "supplier").filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("district_id"))
    return apply.delete_districts({"cells": fixtures.cells(spark, sf_dir)}, gone)["cells"].groupBy("district_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT l_suppkey AS d, l_linenumber AS k, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_suppkey AS d, l_linenumber AS k, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber > 3 GROUP BY ALL),
both_ AS (SELECT d FROM a INTERSECT SELECT d FROM b)
SELECT d AS district_id, CAST(k AS INTEGER) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (d, k) WHERE d IN (SELECT d FROM both_)""")
def map_merge(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")

    def maps(rows, name):
        per = rows.groupBy(F.col("l_suppkey").alias("district_id"), F.col("l_linenumber").cast("int").alias("k")).agg(F.max("l_quantity").alias("v"))
        return per.groupBy("district_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))

    both = maps(line.filter("l_linestatus = 'F'"), "a").join(maps(line.filter("l_linestatus = 'O' AND l_linenumber > 3"), "b"), "district_id")
    return both.select("district_id", F.explode(apply.merge_lane_maps(F.col("a"), F.col("b"))).alias("k", "v"))


@query(f"""WITH {CELLS}, a AS (SELECT school_year, CASE WHEN district_id % 2 = 0 THEN 'FY' ELSE period END AS period, district_id, education || '+' || credits AS combo, max(step) AS s FROM cells GROUP BY ALL),
r AS (SELECT school_year, CASE WHEN period = 'FY' THEN 'Full Year' ELSE period END AS period, district_id, combo, arg_max(s, period) AS max_step FROM a GROUP BY ALL) SELECT * FROM r""")
def period_rename(spark, sf_dir):
    cells = fixtures.cells(spark, sf_dir).withColumn("period", F.when(F.col("district_id") % 2 == 0, "FY").otherwise(F.col("period")))
    return apply.rename_periods(grid.availability(cells)).select("school_year", "period", "district_id", F.explode("lanes").alias("combo", "max_step"))


@query("SELECT s_suppkey AS district_id, CASE WHEN s_suppkey % 3 = 0 THEN 'contracts/' || s_name || '.pdf' END AS contract_pdf, CASE WHEN s_suppkey % 3 = 0 THEN 'updated' ELSE 'not_found' END AS status FROM supplier")
def contract_sync(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("contract_pdf"))
    return apply.set_contracts(rows, rows.filter("district_id % 3 = 0").select("name")).select("district_id", "contract_pdf", "status")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'name_missing' END, CASE WHEN o_orderkey % 5 = 1 THEN 'name_long' END, CASE WHEN o_orderkey % 3 = 0 THEN 'address_long' END, CASE WHEN o_orderkey % 4 = 0 THEN 'url' END, CASE WHEN o_orderkey % 6 = 0 THEN 'many_towns' END, CASE WHEN o_orderkey % 6 = 1 THEN 'town_long' END, CASE WHEN o_orderkey % 7 = 0 THEN 'type' END) AS errors FROM orders")
def validate_rejects(spark, sf_dir):
    """Rows that break every rule, alone and together."""
    k, x = F.col("o_orderkey"), lambda n: F.repeat(F.lit("x"), n)
    towns = F.when(k % 6 == 0, F.transform(F.sequence(F.lit(1), F.lit(51)), lambda i: i.cast("string"))).when(k % 6 == 1, F.array(x(101))).otherwise(F.array(F.lit("Town"), F.lit(" ")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, " ").when(k % 5 == 1, x(256)).otherwise("Name").alias("name"), F.when(k % 3 == 0, x(501)).otherwise("").alias("main_address"), F.when(k % 4 == 0, "ftp://a b").otherwise("https://example.com").alias("district_url"), towns.alias("towns"), F.when(k % 7 == 0, "castle").otherwise("Charter").alias("district_type"))
    return rows.select("o_orderkey", F.concat_ws(",", checks.district_errors()).alias("errors"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN upper(s_name) || ' district' ELSE 'nobody ' || s_suppkey END AS name FROM supplier),
e AS (SELECT n.name, min(s_suppkey) AS id FROM n LEFT JOIN supplier ON lower(trim(n.name)) = lower(trim(s_name)) GROUP BY 1), p AS (SELECT e.name, min(s_suppkey) AS id FROM e JOIN supplier ON contains(lower(trim(s_name)), lower(trim(e.name))) OR contains(lower(trim(e.name)), lower(trim(s_name))) WHERE e.id IS NULL GROUP BY 1)
SELECT e.name, coalesce(e.id, p.id) AS district_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'partial' ELSE 'none' END AS match FROM e LEFT JOIN p USING (name)""")
def name_match_exact_then_fuzzy(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.col("s_name").alias("name"))
    k = F.col("district_id") % 3
    names = s.select(F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.upper("name"), F.lit(" district"))).otherwise(F.concat(F.lit("nobody "), F.col("district_id").cast("string"))).alias("name"))
    return records.match_names(names, s)


@query("""WITH i AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 4 = 0 THEN s_name ELSE c_mktsegment || c_nationkey END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY pos) AS n FROM i) SELECT n.name, pos, s_suppkey AS existing_id, CASE WHEN n > 1 THEN 'duplicate' WHEN s_suppkey IS NOT NULL THEN 'updated' ELSE 'created' END AS status FROM n LEFT JOIN supplier ON lower(trim(n.name)) = lower(trim(s_name))""")
def import_dedupe(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.col("s_name").alias("name"))
    n = s.count()
    c = read(spark, sf_dir, "customer").join(s.withColumnRenamed("name", "s_name"), F.col("c_custkey") % n == F.col("district_id"), "left")
    incoming = c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 4 == 0, F.col("s_name")).otherwise(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("name"))
    return records.import_districts(s, incoming)


# -- maps and statistics ----------------------------------------------------------------------


@query(f"WITH {DISTRICTS}, r AS ({_compare_sql()}), t AS (SELECT rank, r.district_id, salary, lower(trim(unnest(d.towns))) AS town FROM r JOIN districts d USING (district_id)) SELECT town, min(rank) AS rank, arg_min(district_id, rank) AS district_id, arg_min(salary, rank) AS salary, CAST(count(DISTINCT district_id) AS INTEGER) AS n_districts FROM t GROUP BY 1")
def town_rank(spark, sf_dir):
    return compare.town_ranks(_compared(spark, sf_dir)).withColumn("salary", money())


@query(f"""WITH r AS ({_compare_sql()}), p AS (SELECT rank, district_id, 1 - percent_rank() OVER (ORDER BY rank) AS position FROM r)
SELECT rank, district_id, round(position, 6) AS position, """ + ", ".join(f"CAST(floor(CASE WHEN position < 0.5 THEN {a} + ({b} - {a}) * (position * 2) ELSE {b} + ({c} - {b}) * ((position - 0.5) * 2) END + 0.5) AS INTEGER) AS {n}" for n, a, b, c in zip(("red", "green", "blue"), compare.LOW, compare.MIDDLE, compare.HIGH, strict=True)) + " FROM p")
def rank_ramp(spark, sf_dir):
    return compare.colours(_compared(spark, sf_dir)).select("rank", "district_id", F.round("position", 6).alias("position"), "red", "green", "blue")


@query(f"WITH {CELLS} SELECT education, credits, step, CAST(min(salary) AS DOUBLE) AS min_salary, CAST(max(salary) AS DOUBLE) AS max_salary, CAST(sum(salary * 100) AS BIGINT) AS total_cents, CAST(round(median(CAST(salary AS DOUBLE)) * 200) AS BIGINT) AS median_half_cents, count(*) AS n FROM cells GROUP BY ALL")
def heat_stats_median(spark, sf_dir):
    out = compare.statistics(fixtures.cells(spark, sf_dir), "education", "credits", "step")
    return out.select("education", "credits", "step", money("min_salary"), money("max_salary"), F.round(F.col("avg_salary") * F.col("n") * 100).cast("long").alias("total_cents"), F.round(F.col("median_salary") * 200).cast("long").alias("median_half_cents"), "n")


@query(f"WITH {CELLS} SELECT education, count(*) AS n, true AS near FROM cells GROUP BY 1")
def heat_stats_sketch(spark, sf_dir):
    """Medians by education, merged from sketches by year: whether the rank of what they give is within the stated error."""
    cells = fixtures.cells(spark, sf_dir)
    medians = quantiles.merged_medians(quantiles.median_sketches(cells, ["education", "school_year"], "salary"), ["education"])
    below = cells.join(F.broadcast(medians), "education").groupBy("education").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("salary").cast("double") < F.col("median")).alias("less"), F.count_if(F.col("salary").cast("double") <= F.col("median")).alias("upto"))
    return below.select("education", "n", ((F.col("less") <= (0.5 + quantiles.RANK_ERROR) * F.col("n")) & (F.col("upto") >= (0.5 - quantiles.RANK_ERROR) * F.col("n"))).alias("near"))


@query(f"WITH {CELLS} SELECT district_id, school_year, period, education, credits, step, CAST(salary AS DOUBLE) AS salary FROM cells ORDER BY cells.salary DESC, school_year, district_id, period, education, credits, step LIMIT 25")
def top_k(spark, sf_dir):
    return compare.top(fixtures.cells(spark, sf_dir), 25).withColumn("salary", money())


# -- text tables ------------------------------------------------------------------------------


def _tables(spark, sf_dir):
    """A table for every 40 parts: a header of lanes, then a row per part size with three salaries; steps over 35 are for the parser to drop."""
    part = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("doc_id"), "p_size").agg(F.max("p_retailprice").alias("v"))
    cell = lambda k: F.concat(F.lit("$"), F.format_number(F.col("v") * 30 + k * 500, 0))
    row = F.struct("p_size", F.array(F.concat(F.lit("Step "), F.col("p_size").cast("string")), cell(0), cell(1), cell(2)).alias("r"))
    body = part.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("body"))
    return body.select("doc_id", F.concat(F.array(F.array(*map(F.lit, ("STEP", "BA", "BA+15", "MA")))), "body").alias("rows"))


@query("""WITH p AS (SELECT p_partkey // 40 AS doc_id, p_size, max(p_retailprice) AS v FROM part WHERE p_size <= 35 GROUP BY ALL), r AS (SELECT doc_id, p_size AS step, e AS education, c AS credits, floor(v * 30 + k * 500 + 0.5) AS salary FROM p, (VALUES ('B', 0, 0), ('B', 15, 1), ('M', 0, 2)) t(e, c, k))
SELECT doc_id, education, credits, step, salary FROM r WHERE salary BETWEEN 20000 AND 200000""")
def table_unpivot(spark, sf_dir):
    return tables.to_records(tables.split_on_steps(_tables(spark, sf_dir))).drop("pos").withColumn("salary", money())


@query("SELECT page_id AS doc_id, regexp_matches(html, '" + scalars.SIGNALS + "') AS signal FROM pages")
def page_signal(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), scalars.has_salary_signal(F.col("html")).alias("signal"))


@query(f"""WITH {CELLS}, c AS (SELECT district_id, school_year, period, 'M' AS education, CAST(15 AS INTEGER) AS credits, step, salary FROM cells WHERE education = 'B' AND credits = 15),
a AS (SELECT * FROM cells UNION ALL SELECT c.* FROM c ANTI JOIN (SELECT * FROM cells WHERE education = 'M' AND credits = 15) h USING (district_id, school_year, period, step)),
r AS (SELECT * REPLACE (CASE WHEN education = 'D' AND credits = 40 THEN 45 ELSE credits END AS credits) FROM a) SELECT education, CAST(credits AS INTEGER) AS credits, count(*) AS n, CAST(sum(salary) AS DOUBLE) AS total FROM r WHERE NOT (education = 'B' AND credits = 0) GROUP BY ALL""")
def lane_edits(spark, sf_dir):
    edited = grid.copy_lane(fixtures.cells(spark, sf_dir), ("B", 15), ("M", 15))
    edited = grid.delete_lane(grid.relabel_lane(edited, ("D", 40), ("D", 45)), ("B", 0))
    return edited.groupBy("education", "credits").agg(F.count(F.lit(1)).alias("n"), F.sum("salary").cast("double").alias("total"))


@query(f"WITH {DISTRICTS} SELECT count(DISTINCT district_id) AS n FROM districts WHERE district_type IN ('municipal', 'charter') AND (district_id IN (1, 2, 3, 4, 5) OR list_contains(towns, (SELECT max(c_name) FROM customer WHERE c_nationkey = 1)))")
def filter_match_count(spark, sf_dir):
    town = read(spark, sf_dir, "customer").filter("c_nationkey = 1").agg(F.max("c_name")).first()[0]
    return districts.match_count(fixtures.districts(spark, sf_dir), ["municipal", "charter"], [1, 2, 3, 4, 5], [town] if town else None)


@query(f"WITH {CELLS} SELECT district_id, school_year, period, CAST(count_if(step % 3 = 0) AS BIGINT) AS edited, CAST(count_if(step % 2 = 0 AND step % 3 <> 0) AS BIGINT) AS calculated, count(*) AS n FROM cells GROUP BY ALL")
def edit_counts(spark, sf_dir):
    return grid.edit_counts(fixtures.cells(spark, sf_dir).withColumns({"is_edited": F.col("step") % 3 == 0, "is_calculated": F.col("step") % 2 == 0}))


@query(f"WITH {CELLS}, y AS (SELECT s_suppkey AS district_id, CAST(2001 + k AS VARCHAR) || '-' || CAST(2002 + k AS VARCHAR) AS school_year, 'Full Year' AS period FROM supplier, range(0, 3) t(k)) SELECT y.* FROM y ANTI JOIN cells USING (district_id, school_year, period)")
def schedules_to_add(spark, sf_dir):
    wanted = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("district_id"), F.explode(grid.year_options(F.lit(2001))).alias("school_year"), F.lit("Full Year").alias("period"))
    return grid.new_schedules(wanted, fixtures.cells(spark, sf_dir))


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.5' WHEN 1 THEN p_partkey || '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 2 THEN (p_size * 1000) || '.25' WHEN 3 THEN CAST(p_size * 20000 AS VARCHAR) WHEN 4 THEN '$' || p_size ELSE '' END AS x FROM part),
e AS (SELECT p_partkey, NOT regexp_full_match(x, '\d+(\.\d{1,2})?') AS bad, TRY_CAST(x AS DECIMAL(14, 2)) AS v FROM t)
SELECT p_partkey, concat_ws(',', CASE WHEN bad THEN 'number' END, CASE WHEN v < 1000 THEN 'low' END, CASE WHEN v > 500000 THEN 'high' END) AS errors FROM e""")
def edit_checks(spark, sf_dir):
    """Edited texts made of two columns: too low, with three decimals, in range, too high, no number, empty."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(size, F.lit(".5"))).when(k == 1, F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.lpad(size, 3, "0"))).when(k == 2, F.concat((F.col("p_size") * 1000).cast("string"), F.lit(".25"))).when(k == 3, (F.col("p_size") * 20000).cast("string")).when(k == 4, F.concat(F.lit("$"), size)).otherwise("")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", checks.edit_errors(text)).alias("errors"))


@query(r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name WHEN 2 THEN ' DISTRICT%23' || c_nationkey || '-' || c_custkey WHEN 3 THEN c_mktsegment || ' ' || c_nationkey WHEN 4 THEN repeat(c_mktsegment, c_nationkey) ELSE ' ' END AS x FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN trim(x) = '' THEN 'id_missing' END, CASE WHEN length(trim(x)) > 100 THEN 'id_long' END, CASE WHEN trim(x) <> '' AND NOT regexp_full_match(trim(x), '([A-Z]+(#|%23))?[A-Za-z0-9\-]+') THEN 'id' END) AS errors FROM t""")
def id_checks(spark, sf_dir):
    k, c = F.col("c_custkey") % 6, F.col
    text = F.when(k == 0, F.upper("c_name")).when(k == 1, c("c_name")).when(k == 2, F.concat(F.lit(" DISTRICT%23"), c("c_nationkey").cast("string"), F.lit("-"), c("c_custkey").cast("string"))).when(k == 3, F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))).when(k == 4, F.repeat("c_mktsegment", c("c_nationkey").cast("int"))).otherwise(" ")
    return read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(",", checks.id_errors(text)).alias("errors"))


@query("WITH r AS (SELECT l_suppkey AS doc_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) SELECT doc_id, l_orderkey, l_linenumber, l_partkey FROM r WHERE n <= 3")
def preview_records(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"))
    return records.preview(rows, 3, "doc_id").drop("pos")


@query("WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_no FROM conversations) SELECT conv_id AS doc_id, coalesce(sum(CASE WHEN page_no <= 3 THEN length(trim(text)) END), 0) > 100 AS is_text FROM p GROUP BY 1")
def text_or_image(spark, sf_dir):
    from pyspark.sql import Window

    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("page_no"), "text")
    return tables.is_text(pages)


@query("""WITH h AS (SELECT p_partkey // 10 AS table_id, p_partkey % 10 AS pos, p_type AS label FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY table_id, label ORDER BY pos) - 1 AS n FROM h)
SELECT table_id, pos, CASE WHEN n > 0 THEN label || '_' || n ELSE label END AS label FROM n""")
def header_dedupe(spark, sf_dir):
    return tables.deduped_headers(read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("table_id"), (F.col("p_partkey") % 10).alias("pos"), F.col("p_type").alias("label")))


@query("SELECT s_suppkey AS doc_id, 'LANE ' || (s_suppkey % 7) AS alias, 'BA+' || (s_suppkey % 60) AS lane FROM supplier")
def alias_map(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.concat(F.lit("notes\n lane "), (k % 7).cast("string"), F.lit(" = ba + "), (k % 60).cast("string"), F.lit("\nLANE "), (k % 7).cast("string"), F.lit(" = MA\n"))
    return tables.alias_pairs(read(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text")))


@query(f"""WITH {DISTRICTS}, p AS (SELECT a.district_id, a.towns AS old, coalesce(b.towns, []) AS new FROM districts a LEFT JOIN districts b ON b.district_id = a.district_id + 4)
SELECT district_id, array_to_string(list_filter(new, lambda t: NOT list_contains(old, t)), ',') AS added, array_to_string(list_filter(old, lambda t: NOT list_contains(new, t)), ',') AS removed FROM p""")
def towns_diff(spark, sf_dir):
    """Each district's towns against those of the fourth next."""
    old = fixtures.districts(spark, sf_dir).select("district_id", F.col("towns").alias("old"))
    new = old.select((F.col("district_id") - 4).alias("district_id"), F.col("old").alias("new"))
    change = districts.towns_changed(F.col("old"), F.coalesce("new", F.array().cast("array<string>")))
    return old.join(new, "district_id", "left").select("district_id", change.alias("c")).select("district_id", F.array_join("c.added", ",").alias("added"), F.array_join("c.removed", ",").alias("removed"))


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, user_id AS client, event_type AS route_class, count(*) AS n, greatest(count(*) - 100, 0) AS rejected FROM events GROUP BY ALL")
def rate_limit_windows(spark, sf_dir):
    return windows.rate_windows(fixtures.requests(spark, sf_dir)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH v AS (SELECT event_id, user_id AS client, event_type AS route_class, ts, time_bucket(INTERVAL '1 day', ts) AS window_start, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts, event_id) AS place FROM events),
l AS (SELECT *, CASE route_class WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS most FROM v)
SELECT event_id, client, route_class, window_start, place, place <= most AS admitted, greatest(most - place, 0) AS "left" FROM l""")
def rate_verdicts(spark, sf_dir):
    """Every request admitted or not, by limits a day that the test data reach."""
    out = state.rate_verdicts(fixtures.requests(spark, sf_dir), {"view": 3, "click": 2}, 1, 86_400)
    return out.drop("ts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT event_id, ts AS sent, CASE WHEN event_type <> 'error' THEN ts + to_minutes(CAST(floor(value * 7 % 60) AS INTEGER)) END AS done, (SELECT max(ts) FROM events) AS upto FROM events),
w AS (SELECT *, (epoch_us(least(coalesce(done, upto), upto)) - epoch_us(sent)) // 900000000 AS waits FROM m)
SELECT event_id AS message_id, CAST(least(waits + 1, 3) AS INTEGER) AS attempts, CASE WHEN done IS NOT NULL AND done <= upto AND waits < 3 THEN 'done' WHEN waits >= 3 THEN 'dead' ELSE 'under way' END AS state FROM w""")
def queue_receipts(spark, sf_dir):
    """Every message's receipts and end as of the last time in the table."""
    messages = fixtures.queue_messages(spark, sf_dir)
    return state.receipts_of(messages, messages.agg(F.max("sent")).scalar())


@query(f"""WITH RECURSIVE {JOB_EVENTS}, e AS (SELECT *, CASE job_id % 3 WHEN 0 THEN 7 ELSE 30 END AS days FROM job_events),
lives AS (SELECT job_id, 1 AS life, min(ts) AS began, min(ts) + to_days(any_value(days)) AS ends FROM e GROUP BY job_id
  UNION ALL SELECT l.job_id, l.life + 1, min(e.ts), min(e.ts) + to_days(any_value(e.days)) FROM lives l JOIN e ON e.job_id = l.job_id AND e.ts >= l.ends GROUP BY l.job_id, l.life)
SELECT l.job_id, CAST(life AS INTEGER) AS life, arg_max(status, seq) AS status, count(*) AS processed, CAST(sum(succeeded) AS BIGINT) AS succeeded, CAST(sum(failed) AS BIGINT) AS failed, date_trunc('millisecond', any_value(began)) AS began
FROM lives l JOIN e ON e.job_id = l.job_id AND e.ts >= l.began AND e.ts < l.ends GROUP BY l.job_id, l.life""")
def job_lives(spark, sf_dir):
    """Jobs that start anew once their days are over."""
    events = fixtures.job_events(spark, sf_dir).withColumn("kind", F.when(F.col("job_id") % 3 == 0, "reapply").otherwise("extract"))
    return state.lives_of(events).drop("ends").withColumn("began", F.col("began").cast("timestamp_ntz"))


def _ntz(rows):
    """Window bounds as the tables have times, without a zone."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")} | {"total": F.round("total", 2)})


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type AS route_class, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return _ntz(windows.tumbling(fixtures.requests(spark, sf_dir), "1 day", ["route_class"]))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS b FROM events), w AS (SELECT b - k * INTERVAL '6 hours' AS s, event_type, value FROM e, range(0, 4) t(k))
SELECT s AS window_start, s + INTERVAL '1 day' AS window_end, event_type AS route_class, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL""")
def sliding(spark, sf_dir):
    return _ntz(windows.sliding(fixtures.requests(spark, sf_dir), "1 day", "6 hours", ["route_class"]))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, user_id AS client, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    return _ntz(windows.sessions(fixtures.requests(spark, sf_dir), "30 minutes", ["client"]))


@query("SELECT DISTINCT user_id AS client, event_type AS route_class FROM events")
def dedup(spark, sf_dir):
    return windows.first_seen(fixtures.requests(spark, sf_dir), ["client", "route_class"]).select("client", "route_class")


@query(f"WITH {JOB_EVENTS} SELECT job_id, arg_max(status, seq) AS status, max(seq) AS seq, count(*) AS n_events FROM job_events GROUP BY 1")
def job_latest_state(spark, sf_dir):
    return jobs.latest(fixtures.job_events(spark, sf_dir)).drop("ts")


@query(f"WITH {JOB_EVENTS} SELECT job_id, seq, count(*) OVER w AS processed, CAST(sum(succeeded) OVER w AS BIGINT) AS succeeded, CAST(sum(failed) OVER w AS BIGINT) AS failed FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY seq)")
def progress_running(spark, sf_dir):
    return jobs.progress(fixtures.job_events(spark, sf_dir))


@query(f"WITH {JOB_EVENTS} SELECT DISTINCT job_id FROM job_events ANTI JOIN (SELECT job_id FROM job_events GROUP BY 1 HAVING arg_max(status, seq) NOT IN ('completed', 'failed', 'deleted')) r USING (job_id)")
def single_flight(spark, sf_dir):
    events = fixtures.job_events(spark, sf_dir)
    return jobs.may_start(events.select("job_id").distinct(), events)


# -- text and small functions -----------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN length(CAST(l_partkey AS VARCHAR)) >= 3 THEN CAST(l_partkey AS VARCHAR) ELSE lpad(CAST(l_partkey AS VARCHAR), 3, '0') END AS padded,
lpad(CAST(9999999999 - CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS VARCHAR), 10, '0') AS sort_key FROM lineitem""")
def salary_keys(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.pad_number(F.col("l_partkey"), 3).alias("padded"), scalars.salary_key(F.col("l_extendedprice")).alias("sort_key"))


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (7, 9) THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) END AS effective,
CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INTEGER) AS current_start FROM orders""")
def effective_years(spark, sf_dir):
    text = F.concat(F.lit("Effective "), F.date_format("o_orderdate", "MMMM"), F.lit(" 1, "), F.year("o_orderdate").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.effective_year(text).alias("effective"), scalars.current_start(F.col("o_orderdate")).cast("int").alias("current_start"))


_CELL_TEXTS = ("STEP 1", "years", "12-13", "$45,000", "BA+15", "n/a", "", "Steps:", "7")


@query(f"""WITH t AS (SELECT p_partkey, {list(_CELL_TEXTS)!r}[p_partkey % {len(_CELL_TEXTS)} + 1] AS x FROM part)
SELECT p_partkey, x = '$45,000' AS salary, x IN ('12-13', '7') AS marker, x IN ('STEP 1', 'years', 'Steps:') AS header, x IN ('years', 'BA+15', 'n/a') AS lane_token FROM t""")
def cell_tests(spark, sf_dir):
    x = F.element_at(F.array(*map(F.lit, _CELL_TEXTS)), (F.col("p_partkey") % len(_CELL_TEXTS) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.is_salary(x).alias("salary"), scalars.is_step_marker(x).alias("marker"), scalars.is_step_header(x).alias("header"), scalars.is_lane_token(x).alias("lane_token"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type || '|' || p_size ELSE replace(p_type, ' ', '|') END AS tokens FROM part""")
def row_tokens(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_brand", F.lit("   "), "p_type", F.lit("\t"), F.col("p_size").cast("string"))).otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", scalars.split_tokens(line)).alias("tokens"))


@query("SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM customer")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("contracts/2020/"), F.lower("c_mktsegment"), F.lit("_schedule_"), F.col("c_custkey").cast("string"), F.lit(".pdf"))
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.district_of_file(path).alias("name"))


@query("SELECT p_partkey, CAST(nullif(p_size % 40, 0) AS INTEGER) AS value FROM part")
def roman_numbers(spark, sf_dir):
    tens, ones = F.array(*map(F.lit, ("", "x", "xx", "xxx"))), F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    n = (F.col("p_size") % 40).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", scalars.roman(F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, n % 10))).alias("value"))


@query("""WITH c AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CAST(n // 100000 AS VARCHAR) || lpad(CAST(n // 100 % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS repaired, CAST(greatest(1, least(20, o_orderkey % 40 - 5)) AS INTEGER) AS step FROM c""")
def point_repair(spark, sf_dir):
    n = (F.col("o_totalprice").cast("decimal(14,2)") * 100).cast("long")
    digits = lambda c, w: F.lpad(c.cast("long").cast("string"), w, "0")
    text = F.concat_ws(".", F.floor(n / 100_000).cast("string"), digits(F.floor(n / 100) % 1000, 3), digits(n % 100, 2))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.repair_points(text).alias("repaired"), scalars.clamp_step(F.col("o_orderkey") % 40 - 5, F.lit(20)).cast("int").alias("step"))


@query("SELECT o_orderkey, o_orderkey % 9 IN (0, 1, 4, 6, 7) AS should FROM orders")
def period_should(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    p = F.when(k == 0, "FY").when(k == 1, "full_year").when(k == 2, " ").when(k == 3, F.lit(None)).when(k == 4, "Full-Year").when(k == 5, "10-month").when(k == 6, "FULLYEAR").when(k == 7, "fy").otherwise("Full Year")
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.should_normalize_period(p).alias("should"))


@query("SELECT s_suppkey AS doc_id, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS structure FROM supplier")
def table_structure(spark, sf_dir):
    k = F.col("s_suppkey")
    row = F.array(F.when(k % 3 == 0, "Step").otherwise("x"), F.when(k % 2 == 0, "ba").otherwise("1"))
    rows = F.array(F.array(F.lit("title"), F.lit("BA")), row)
    return read(spark, sf_dir, "supplier").select(k.alias("doc_id"), tables.has_structure(rows).alias("structure"))


@query("SELECT s_suppkey AS doc_id, 'STEP,BA,MA;' || s_suppkey || ',a,c' AS rows FROM supplier")
def multiplier_columns(spark, sf_dir):
    header = F.array(*map(F.lit, (" step", "BA", "Multiplier", "MA ")))
    rows = F.array(header, F.array(F.col("s_suppkey").cast("string"), F.lit("a"), F.lit("1.05"), F.lit("c")))
    kept = tables.without_multipliers(tables.trimmed(rows))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.array_join(F.transform(kept, lambda r: F.array_join(r, ",")), ";").alias("rows")).withColumn("rows", F.replace("rows", F.lit("step"), F.lit("STEP")))


@query("SELECT s_suppkey AS doc_id, CAST(part AS INTEGER) AS part, CASE part WHEN 0 THEN 'STEP,BA;' || s_suppkey || ',b' ELSE 'Step,MA,DOC;2,m,' END AS rows FROM supplier, range(0, 2) t(part)")
def side_tables(spark, sf_dir):
    rows = F.array(F.array(*map(F.lit, ("STEP", "BA", "Step", "MA", "DOC"))), F.array(F.col("s_suppkey").cast("string"), F.lit("b"), F.lit("2"), F.lit("m")))
    cut = tables.split_on_steps(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), rows.alias("rows")))
    return cut.select("doc_id", F.col("part").cast("int").alias("part"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


@query("SELECT p_partkey AS doc_id, CAST(2 AS INTEGER) AS pos, upper(p_type) AS label FROM part")
def unmapped_headers(spark, sf_dir):
    rows = F.array(F.array(F.lit("STEP"), F.lit(" ma+30"), F.col("p_type"), F.lit("")))
    return tables.unmapped_labels(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), rows.alias("rows")))


@query(f"WITH {CELLS} SELECT district_id, CAST(count(*) AS INTEGER) AS records_count, CAST(max(salary) AS DOUBLE) AS highest, min(school_year) AS first_year FROM cells GROUP BY 1")
def backup_documents(spark, sf_dir):
    from ..sources import writers

    made = writers.as_backups(fixtures.cells(spark, sf_dir).withColumn("district_name", F.col("district_id").cast("string")), "2024-01-01")
    return made.select("district_id", "records_count", F.array_max("records.salary").alias("highest"), F.array_min("records.school_year").alias("first_year"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey * 10 > (SELECT 5 * max(o_orderkey) FROM orders)")
def expiry(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") * 10).alias("ttl"))
    return jobs.unexpired(rows, 5 * (rows.agg(F.max("o_orderkey")).first()[0] or 0)).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'old,done' ELSE 'done' END WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END AS results FROM orders")
def result_append(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("old"))).alias("results"))
    return jobs.append_result(rows, "1-URGENT", F.lit("done")).select("o_orderkey", F.concat_ws(",", "results").alias("results"))


from . import extraction, files  # noqa: E402, F401  their queries are added to QUERIES and SQL
