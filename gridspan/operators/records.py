"""Extracted records: choice of years, duplicates, tiers, exclusions, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CELL_KEY
from .cells import lane_key
from .ranking import numbered


def first_of_key(records: DataFrame, keys: list[str] | None = None, position: str = "pos") -> DataFrame:
    """The first record of each key in input order."""
    own = Window.partitionBy(*(keys or CELL_KEY)).orderBy(position)
    return records.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def last_of_key(records: DataFrame, keys: list[str] | None = None, position: str = "pos") -> DataFrame:
    own = Window.partitionBy(*(keys or CELL_KEY)).orderBy(F.col(position).desc())
    return records.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def relevant_years(records: DataFrame, current: int, by: list[str] | None = None, last_period: bool = False) -> DataFrame:
    """Per document: current and future years; else its latest past year; else everything.

    ``current`` is the starting year that counts as now. Years that can't be read are dropped
    where any can.
    """
    keys = by or ["doc_id"]
    start = F.regexp_extract("school_year", r"^(\d{4})-\d{4}$", 1).try_cast("int")
    per = records.withColumn("__start", start)
    facts = per.groupBy(*keys).agg(F.max(F.col("__start") >= current).alias("__now"), F.max("__start").alias("__latest"))
    keep = F.when(F.col("__latest").isNull(), F.lit(True)).when(F.col("__now"), F.col("__start") >= current).otherwise(F.col("__start") == F.col("__latest"))
    out = per.join(facts, keys).filter(keep)
    if last_period:
        out = out.withColumn("__last", F.max("period").over(Window.partitionBy(*keys, "school_year"))).filter("period = __last").drop("__last")
    return out.drop("__start", "__now", "__latest")


def choose_tier(records: DataFrame, enough: int = 200, by: str = "doc_id") -> DataFrame:
    """Per document the first extraction tier with enough records, else the last one that has any."""
    counts = records.groupBy(by, "tier").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("n") >= enough, F.col("tier"))), F.max("tier")).alias("tier"))
    return records.join(chosen, [by, "tier"], "left_semi")


def without(records: DataFrame, steps: list[int] | None = None, lanes: list[str] | None = None) -> DataFrame:
    """Drops steps and lanes that a reviewer left out; a lane is ``B`` or ``B+15``."""
    short = F.when(F.col("credits") == 0, F.col("education")).otherwise(lane_key())
    out = records.filter(~F.col("step").isin(*steps)) if steps else records
    return out.filter(~short.isin(*lanes) & ~lane_key().isin(*lanes)) if lanes else out


def load_batches(records: DataFrame, errors: Column, *order: Column | str, size: int = 25) -> DataFrame:
    """``batch, n, written, failed, codes`` of a load in batches of ``size``: a batch with a faulty record fails as a whole.

    ``errors`` are a record's error codes. Batches follow ``order``, which should leave no
    ties; records are numbered by ranges of it, and a batch is a number of records at most ``size``.
    """
    placed = numbered(records.withColumn("__errors", errors), *order, name="__place", kind="long")
    batches = placed.groupBy(F.floor((F.col("__place") - 1) / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__errors")))).alias("codes"))
    bad = F.size("codes") > 0
    return batches.select("batch", "n", F.when(bad, 0).otherwise(F.col("n")).cast("long").alias("written"), F.when(bad, F.col("n")).otherwise(0).cast("long").alias("failed"), "codes")


def load_totals(batches: DataFrame) -> DataFrame:
    return batches.agg(F.sum("written").alias("written"), F.sum("failed").alias("failed"), F.count_if(F.col("failed") > 0).alias("failed_batches"))


def preview(records: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The first n records, or the first n of each group."""
    if by is None:
        return records.orderBy("pos").limit(n)
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).filter(F.col("__n") <= n).drop("__n")


def split_valid(records: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): the rejected keep their error codes."""
    checked = records.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def match_names(names: DataFrame, districts: DataFrame, name: str = "name") -> DataFrame:
    """``district_id`` and ``match`` (exact, partial, none) for each distinct name.

    Equal after folding; for the others the first district, by id, whose name contains the
    name or is contained in it. Equal names meet in a hash join. One text can only contain
    another if it has the other's rarest run of GRAM letters, so the others meet by these and
    are compared then.
    """
    key = F.lower(F.trim(F.col(name)))
    want = names.select(F.col(name).alias("given"), key.alias("key")).distinct()
    have = districts.select("district_id", F.lower(F.trim("name")).alias("own"))
    first = have.groupBy("own").agg(F.min("district_id").alias("district_id"))
    exact = want.join(first, F.col("key") == F.col("own"), "left").select("given", "key", "district_id")
    rest = exact.filter("district_id IS NULL AND key <> ''").select("given", "key")
    named = have.filter("own <> ''")
    often = named.select(F.explode(F.array_distinct(_grams("own"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    inside = _rarest(rest, "key", often).join(named.select("district_id", "own", F.explode(F.array_distinct(_grams("own"))).alias("gram")), "gram").filter(F.col("own").contains(F.col("key")))
    around = rest.select("given", "key", F.explode(F.array_distinct(_grams("key"))).alias("gram")).join(_rarest(named, "own", often), "gram").filter(F.col("key").contains(F.col("own")))
    contains = inside.select("given", "district_id").unionByName(around.select("given", "district_id"))
    partial = contains.groupBy("given").agg(F.min("district_id").alias("partial_id"))
    return exact.join(partial, "given", "left").select(F.col("given").alias("name"), F.coalesce("district_id", "partial_id").alias("district_id"), F.when(F.col("district_id").isNotNull(), "exact").when(F.col("partial_id").isNotNull(), "partial").otherwise("none").alias("match"))


GRAM = 4


def _grams(text: str) -> Column:
    """All runs of GRAM characters; of a shorter text, all of its runs, so that it is found whole in any other."""
    run = lambda size: F.transform(F.sequence(F.lit(1), F.length(text) - F.lit(size - 1)), lambda i: F.substring(F.col(text), i, F.lit(size)))
    shorter = [F.when(F.length(text) >= k, run(k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)]
    return F.concat(*shorter)


def _rarest(rows: DataFrame, text: str, often: DataFrame) -> DataFrame:
    """``rows`` with ``gram``: the run of GRAM characters, or all of a shorter text, that the fewest texts have."""
    size = F.least(F.length(text), F.lit(GRAM))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, size)))
    each = rows.withColumn("gram", F.explode(own)).join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return each.groupBy(*rows.columns).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def match_totals(matches: DataFrame) -> DataFrame:
    """How many names were matched, by kind of match, and how many were not."""
    return matches.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("match") == "exact").alias("exact"), F.count_if(F.col("match") == "partial").alias("partial"), F.count_if(F.col("match") == "none").alias("unmatched"))


def import_districts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by folded name; of incoming rows with one name the first counts, of existing districts with one the smallest id. ``status`` says what happens to each."""
    key = lambda d: d.withColumn("key", F.lower(F.trim("name")))
    named = key(incoming).filter("key <> ''")
    numbered = named.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    old = key(existing).groupBy("key").agg(F.min("district_id").alias("existing_id"))
    return numbered.join(old, "key", "left").select("name", "pos", "existing_id", F.when(F.col("n") > 1, "duplicate").when(F.col("existing_id").isNotNull(), "updated").otherwise("created").alias("status"))
