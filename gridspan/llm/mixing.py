"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import WORD_PATTERN, by_place, ready, scratch, table

SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2.0
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def draw(key: Column, text_md5: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed, a row's id and text, and its number among equal rows: the same in every run."""
    place = F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), text_md5, place))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``number``: 0, 1, 2, ... among rows that are equal in ``keys``.

    Few rows are: which keys several rows have is a written table, and rows without one stay
    where they are. The others are written with the partition that they were read in, numbered
    within it, and partitions follow one another, so that no task meets all rows of a key; as
    what is written stays so, it doesn't matter whether ``rows`` are dealt alike when they are read again.
    """
    spark = ready(rows.sparkSession)
    place, held = scratch(spark, "repeats"), scratch(spark, "repeated")
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(k).alias(f"{k}_") for k in keys])
    several.write.parquet(place)
    known = spark.read.schema(several.schema).parquet(place)
    if known.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    rows.withColumn("part", F.spark_partition_id()).join(known, same, "left_semi").write.parquet(held)
    again = spark.read.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).parquet(held)
    by_part = again.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n"))
    offsets = by_part.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("part").alias("part_"), "before")
    within = again.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "part").orderBy("part")) - 1)
    counted = within.join(offsets, same & (F.col("part") == F.col("part_"))).withColumn("number", (F.col("number") + F.col("before")).cast("long"))
    names = [*rows.columns, "number"]
    return rows.join(known, same, "left_anti").withColumn("number", F.lit(0).cast("long")).select(*names).unionByName(counted.select(*names))


def source_targets(sized: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    The sources, in code point order with null last, take the weights in turn. Together they
    are to get ``share`` times all sizes in proportion to their weights; none gets more than
    ``most`` times its own size and the excess goes to the others by weight. That sharing has
    a closed form: in the order of cap / weight, all before some source are at their cap and
    the rest get the same amount per weight.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    everything, by_cap = Window.partitionBy(), Window.orderBy("ratio", "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weigh)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def written_targets(sized: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """source_targets as a written table: ``mixed_source, source_size, target, mix_rate``.

    A row per source, read back with its size known: the planner broadcasts it while that is
    below ``spark.sql.autoBroadcastJoinThreshold``, so that documents aren't shuffled by a hot
    source, and joins by shuffle beyond.
    """
    spark = ready(sized.sparkSession)
    place = scratch(spark, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    source_targets(sized, share, weights, most).select(F.col("source").alias("mixed_source"), "source_size", "target", rate.alias("mix_rate")).coalesce(1).write.parquet(place)
    return spark.read.schema("mixed_source string, source_size long, target double, mix_rate double").parquet(place)


def copies(rate: Column, drawn: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(drawn < rate - whole, 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken: ``doc_id, source, size, source_size, target, copies, taken``.

    A document is emitted floor(rate) times, rate = target / size of its source, and once more
    with the fraction as probability, drawn from a hash of its id and text. Sizes are words; a
    null text has none, a null source is a source of its own and comes last, a source without
    words has target 0 and no copies. Rows of one id, or of none, are drawn each by its text;
    rows with one id, text and source are numbered in any order and drawn by their number, so
    that a source of repeated rows comes near its target too. An empty table gives no rows.
    Other columns are not read.

    Only sums by source meet in one place: they are aggregated before the shuffle, and one
    task puts the sources in order, some millions at most.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_md5"))
    targets = written_targets(sized, share, weights, most)
    return (
        numbered(sized, ["doc_id", "source", "text_md5"])
        .join(targets, F.col("source").eqNullSafe(F.col("mixed_source")))
        .withColumn("copies", copies(F.col("mix_rate"), draw(F.col("doc_id"), F.col("text_md5"), F.col("number"), seed)))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    The rows stay where they are read, all but repeated ones; only the sums by source are joined to them.
    """
    plain, (key, text, source) = by_place(docs, id_col, text_col, source_col)
    sized = plain.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    targets = written_targets(sized, share, weights, most).select("mixed_source", "mix_rate")
    marked = plain.withColumn("text_md5", F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    return (
        numbered(marked, [key, source, "text_md5"])
        .join(targets, F.col(source).cast("string").eqNullSafe(F.col("mixed_source")))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies(F.col("mix_rate"), draw(F.col(key), F.col("text_md5"), F.col("number"), seed)))))
        .drop("text_md5", "number", "mixed_source", "mix_rate", "copy")
        .toDF(*docs.columns)
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = {
    "op8_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS text_md5,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS number FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM by_source
), levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, cap)) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_md5 || CASE WHEN number > 0 THEN ':' || number ELSE '' END), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM rated
"""
}
