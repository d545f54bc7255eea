"""A session with the settings that the library counts on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "gridspan", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this machine import the package from where it is.

    On a cluster it is installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, root] if p)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary one.

    A cluster without it is an error: what one machine writes to its own disk the others don't see.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridspan-"))
        named = sc.getCheckpointDir()
    return named


#: Folders of written tables.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a written table."""
    _scratch.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Removes the tables that operators have written so far, when their results are no longer needed; how many folders went.

    Stored tables go too, and are made again when they are next read.
    """
    gone = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
