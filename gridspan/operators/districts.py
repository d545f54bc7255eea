"""Districts: listing, search, towns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TYPE_ORDER
from .ranking import numbered

LEAST_TOKEN = 3


def fold(c: Column | str) -> Column:
    """Lower case without outer blanks; null is empty."""
    return F.coalesce(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def town_bridge(districts: DataFrame) -> DataFrame:
    """District and town pairs; towns that differ only in case are one."""
    rows = districts.select("district_id", F.col("name").alias("district_name"), F.posexplode("towns").alias("pos", "town"))
    first = Window.partitionBy("district_id", F.upper("town")).orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("district_id", "district_name", "town", "pos")


def towns_index(districts: DataFrame) -> DataFrame:
    """Town to districts, under the first spelling by district."""
    rows = districts.select("district_id", F.posexplode("towns").alias("pos", "town")).withColumn("key", fold("town"))
    return rows.groupBy("key").agg(F.min_by("town", F.struct("district_id", "pos")).alias("town"), F.array_sort(F.collect_set("district_id")).alias("district_ids"))


def by_name(districts: DataFrame, name: str) -> DataFrame:
    return districts.filter(F.lower("name") == name.strip().lower())


def by_town(districts: DataFrame, town: str) -> DataFrame:
    """Districts of a town in order of name."""
    return districts.filter(F.exists("towns", lambda t: F.upper(t) == town.strip().upper())).orderBy(F.upper("name"), "district_id")


def listed(districts: DataFrame, name: str | None = None, town: str | None = None) -> DataFrame:
    """All districts, or those of a town, or else of a name, ordered by name."""
    found = by_town(districts, town) if town else by_name(districts, name) if name else districts
    return found.orderBy(F.lower("name"), "district_id")


def long_enough(query: str) -> bool:
    return bool(query.split()) and all(len(t) >= LEAST_TOKEN for t in query.lower().split())


def search(districts: DataFrame, query: str) -> DataFrame:
    """Names that contain the query, then districts with that very town; each once.

    Every word of the query needs LEAST_TOKEN characters, else nothing is found. ``source``
    is 1 for names and 2 for towns. The text is taken literally.
    """
    text = query.strip().lower()
    if not long_enough(query):
        return districts.withColumn("source", F.lit(1)).filter(F.lit(False))
    in_name = F.lower("name").contains(text)
    has_town = F.exists("towns", lambda t: F.upper(t) == text.upper())
    # one scan: a row found both ways counts as found by name
    return districts.filter(in_name | has_town).withColumn("source", F.when(in_name, 1).otherwise(2)).orderBy("source", F.lower("name"), "district_id")


def page(rows: DataFrame, offset: int, limit: int, most: int | None = None) -> DataFrame:
    """A slice of ordered rows, ``total`` being the number of all rows (or of the first ``most``)."""
    counted = rows.limit(most) if most is not None else rows
    return counted.offset(offset).limit(limit).withColumn("total", counted.agg(F.count(F.lit(1)).alias("n")).scalar())


def type_place(kind: Column | str = "district_type") -> Column:
    column = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(99)
    for name, place in TYPE_ORDER.items():
        out = F.when(F.lower(column) == name, place).otherwise(out)
    return out


def by_type_and_name(districts: DataFrame) -> DataFrame:
    return districts.withColumn("place", type_place()).orderBy("place", "name", "district_id")


def custom_filter(rows: DataFrame, types: list[str] | None = None, ids: list | None = None, towns: list[str] | DataFrame | None = None) -> DataFrame:
    """Rows of a type that are picked by id or by a town; without picks all of the type.

    Many towns come as a table with a column ``town``, to be joined; an empty one picks nothing, as an empty list does.
    """
    out = rows.filter(F.col("district_type").isin(*types)) if types else rows
    if isinstance(towns, DataFrame):
        wanted = towns.select(fold("town").alias("__key")).distinct()
        hit = out.select("district_id", F.explode("towns").alias("__town")).withColumn("__key", fold("__town")).join(wanted, "__key", "left_semi").select("district_id").distinct().withColumn("__hit", F.lit(True))
        found = out.join(hit, "district_id", "left")
        picked = F.col("district_id").isin(*ids) if ids else wanted.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
        return found.filter(F.col("__hit").isNotNull() | picked).select(*rows.columns)
    if not ids and not towns:
        return out
    picked = F.col("district_id").isin(*ids) if ids else F.lit(False)
    if towns:
        wanted = F.array(*[F.lit(t.strip().lower()) for t in towns])
        picked = picked | F.arrays_overlap(F.transform("towns", lambda t: F.lower(F.trim(t))), wanted)
    return out.filter(picked)


def reranked(rows: DataFrame) -> DataFrame:
    """Ranks closed up after a filter."""
    return numbered(rows.withColumnRenamed("rank", "__old"), "__old").select(*rows.columns)


def towns_changed(old: Column, new: Column) -> Column:
    """struct(added, removed) of two town arrays."""
    return F.struct(F.array_except(new, old).alias("added"), F.array_except(old, new).alias("removed"))


def replace_towns(districts: DataFrame, new: DataFrame) -> DataFrame:
    """The town lists of ``new`` (district_id, towns) in place of the old ones; blank towns go, of equal ones the first stays."""
    folded = F.transform(F.filter("new.towns", lambda t: F.trim(t) != ""), lambda t: F.trim(t))
    own = new.alias("new").select("new.district_id", F.array_distinct(folded).alias("__towns"))
    joined = districts.join(own, "district_id", "left")
    return joined.withColumn("towns", F.coalesce("__towns", "towns")).select(*districts.columns)


def without_town(towns: Column, town: Column) -> Column:
    return F.filter(towns, lambda t: t != F.trim(town))


def with_town(towns: Column, town: Column) -> Column:
    """A town put at the end, trimmed, unless it is there or blank."""
    return F.when(F.trim(town) == "", towns).otherwise(F.array_union(towns, F.array(F.trim(town))))


def tooltip(towns: DataFrame, districts: DataFrame, shown: int = 5) -> DataFrame:
    """The first districts of each town, and how many more there are."""
    index = districts.select("name", F.explode("towns").alias("t")).groupBy(fold("t").alias("key")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return towns.withColumn("key", fold("town")).join(index, "key", "left").select("town", F.coalesce(F.slice("names", 1, shown), F.array().cast("array<string>")).alias("names"), F.greatest(F.coalesce(F.size("names"), F.lit(0)) - shown, F.lit(0)).alias("more"))


def match_count(rows: DataFrame, types: list[str] | None = None, ids: list | None = None, towns: list[str] | None = None) -> DataFrame:
    """How many districts a custom filter leaves."""
    return custom_filter(rows, types, ids, towns).agg(F.count_distinct("district_id").alias("n"))


def described(rows: DataFrame, districts: DataFrame) -> DataFrame:
    """``rows`` with their district's type, contract and towns: ``unknown``, null and none where there is no such district, or it lacks them."""
    held = set(rows.columns)
    plain = rows.drop(*[c for c in ("district_type", "contract_pdf", "towns") if c in held])
    return plain.join(districts.select("district_id", "district_type", "contract_pdf", "towns"), "district_id", "left").withColumns({"district_type": F.coalesce("district_type", F.lit("unknown")), "towns": F.coalesce("towns", F.array().cast("array<string>"))})
