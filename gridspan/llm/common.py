"""What the operators of this subpackage share: tables, folders, Arrow batches and rolling hashes.

Text is handled as the UTF-8 bytes of Arrow buffers, so that the work of a batch is a few
numpy passes instead of a Python loop over characters.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Bytes hashed at a time; bounds the scratch memory of a batch.
SLICE = 1 << 20

#: Bytes of an Arrow batch: a worker holds a few times that.
BATCH_BYTES = 16 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD_MULTIPLIER = 0xD1342543DE82EF95
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Folders of written tables.
_scratch: list[str] = []
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers and sets a checkpoint folder where none is set.

    On a cluster the package is installed or sent with ``--py-files``; the path entry
    below serves local sessions. The folder of ``spark.checkpoint.dir`` always wins; without
    one a local session gets a temporary folder, and a cluster, whose machines don't share
    any, an error.
    """
    root = str(Path(__file__).resolve().parents[2])
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, root] if p)
    if shared_folder(spark) is None:
        if not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def is_local(master: str) -> bool:
    """Whether all executors are in one process of this machine."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, or None where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a written table."""
    ready(spark)
    made = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(made)
    return made


def drop_scratch(spark: SparkSession) -> int:
    """Removes the tables that operators have written so far, when their results are no longer needed; how many folders went."""
    gone = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def by_place(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ..., and those names of the wanted columns.

    What keeps all columns works on these, so that no name can clash or hold odd characters;
    ``toDF(*docs.columns)`` names them back.
    """
    names = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(w.lower())}" for w in wanted]


def unsigned(c: Column) -> Column:
    """A non-negative long from a hash."""
    return c.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


# -- Arrow and numpy -------------------------------------------------------------------------


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, end to end, and the offset of each (one more than strings)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def groups_of(offsets: np.ndarray, most: int = SLICE):
    """(first, last) ranges of documents of about ``most`` bytes together; a longer one stands alone."""
    first = 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def powers(n: int, multiplier: int = _MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """multiplier ** i and its inverse ** i modulo 2 ** 64, for i up to n."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE + 4096)
        inverse = pow(multiplier, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, m, np.uint64)])) for m in (multiplier, inverse))
        if size <= 4 * SLICE:
            _powers[multiplier] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(values: np.ndarray, multiplier: int) -> np.ndarray:
    """Running sums of values[i] * multiplier ** i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), multiplier)[0][: len(values)], out=out[1:])
    return out


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_VALUES[buf], _MULTIPLIER)


def byte_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix), _MULTIPLIER)[1][start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    return prefix_hash(hashes, _WORD_MULTIPLIER)


def word_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix), _WORD_MULTIPLIER)[1][start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint spans, a slice of bytes at a time."""
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        base = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, base + SLICE, "right")))
        prefix = byte_prefix(buf[base : int(end[last - 1])])
        out[first:last] = byte_spans(prefix, start[first:last] - base, end[first:last] - base)
        first = last
    return out


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each document's first word (one more than documents)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:n]) > 0


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])]


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow of a function over batches; a worker gives back the memory that its task used."""

    def tidy(batches):
        with np.errstate(over="ignore"):
            yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Free memory goes back to the system: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_batch(df: DataFrame, function, schema: str) -> DataFrame:
    """in_arrow with a function from RecordBatch to RecordBatch (or None)."""

    def run(batches):
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out

    return in_arrow(df, run, schema)
