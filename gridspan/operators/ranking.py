"""Places in an order that no single task has to see."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: A row's number within its partition is in the low bits of monotonically_increasing_id, its partition above.
_BITS = 33
#: Bytes of written rows that one task puts in order by itself.
ONE_TASK = 16 << 20


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank", kind: str = "int") -> DataFrame:
    """``rows`` with their places from 1 on in ``order``, which should leave no ties.

    ``rows`` are written first, so that what makes them runs once and their size is known. Up to
    ONE_TASK bytes are put in order by one task. More are dealt out by ranges of the order and sorted there;
    each partition numbers its own, and the sizes of the partitions before are added, of which there is
    one number each: they go through the driver, and back as a table of as many rows as a
    shuffle has partitions. The numbered rows are written too, for ranges that are found twice may differ.
    """
    spark = rows.sparkSession
    place = scratch(spark, "numbered")
    rows.write.parquet(f"{place}/rows")
    made = spark.read.schema(rows.schema).parquet(f"{place}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/rows")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() <= ONE_TASK:
        return made.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast(kind))
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt.write.parquet(f"{place}/numbered")
    held = spark.read.schema(dealt.schema).parquet(f"{place}/numbered").withColumn("__part", F.shiftright("__at", _BITS))
    sizes = sorted(tuple(r) for r in held.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((n for _, n in sizes), initial=0)
    starts = spark.createDataFrame([(part, b) for (part, _), b in zip(sizes, before, strict=False)], "__part long, __before long")
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return held.join(F.broadcast(starts), "__part").withColumn(name, at.cast(kind)).drop("__part", "__at", "__before")
