"""Tables stored with a layout, so that reading them by key needs no shuffle.

Cells are dealt into buckets by district, divided by school year and sorted by lane in each file.
What groups or joins by district, or by anything that begins with it, then needs no exchange;
a year is a folder, and a lane and step are ranges of row groups. Buckets of the district
table have the same number, so that the two are joined in place.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LANE
from ..session import scratch

#: Bytes of input to a bucket, and the least and greatest number of buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, (8, 8192)

#: Where the tables of this application lie.
_places: dict[str, str] = {}
_making = threading.Lock()


def bucket_number(size: int, each: int = BUCKET_BYTES) -> int:
    """How many buckets an input of so many bytes is dealt into, ``each`` bytes to one."""
    return max(BUCKETS[0], min(BUCKETS[1], -(-size // each)))


def store(rows: DataFrame, name: str, key: str, buckets: int, sort: list[str], parts: list[str] | None = None) -> DataFrame:
    """``rows`` written as table ``name`` in the shared folder: buckets by ``key``, sorted within, a folder for each value of ``parts``.

    A bucket is written by one task, a file for each part. Rows of a key should be bounded,
    as the cells of one district are; what isn't yet, is to be aggregated first.
    """
    spark = rows.sparkSession
    writer = rows.repartition(buckets, key).sortWithinPartitions(*(parts or []), *sort).write.bucketBy(buckets, key).sortBy(*sort)
    if parts:
        writer = writer.partitionBy(*parts)
    _places[name] = scratch(spark, name)
    writer.option("path", _places[name]).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def store_cells(cells: DataFrame, name: str, buckets: int) -> DataFrame:
    return store(cells, name, "district_id", buckets, [*LANE, "step"], ["school_year"]).select(cells.columns)


def store_districts(districts: DataFrame, name: str, buckets: int) -> DataFrame:
    return store(districts, name, "district_id", buckets, ["district_id"])


def mark_of(spark: SparkSession, *paths: str) -> tuple[str, int]:
    """(a name for the files as they are now, their bytes): a file that is written anew changes the name."""
    path_of, seen, size = spark._jvm.org.apache.hadoop.fs.Path, [], 0
    for path in map(path_of, paths):
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        bytes_ = files.getContentSummary(path).getLength()
        seen.append(f"{path}:{bytes_}:{files.getFileStatus(path).getModificationTime()}")
        size += bytes_
    return hashlib.md5("|".join(seen).encode()).hexdigest()[:16], size


def stored_once(spark: SparkSession, name: str, paths: list[str], make) -> DataFrame:
    """The table that ``make(name, buckets)`` stores, made once an application and for each state of the files it comes from.

    One whose files are gone is made again.
    """
    mark, size = mark_of(spark, *paths)
    own = f"{name}_{mark}_{hashlib.md5(spark.sparkContext.applicationId.encode()).hexdigest()[:8]}"
    with _making:
        if spark.catalog.tableExists(own):
            place = spark._jvm.org.apache.hadoop.fs.Path(_places.get(own, "/nowhere"))
            if own in _places and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
                return spark.table(own)
            spark.sql(f"DROP TABLE {own}")
        return make(own, bucket_number(size))
