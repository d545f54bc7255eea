"""Token ids in files of directly addressable codes: any token is read without decoding others.

An id is split into chunks of eight bits, the lowest first. Level k of a file holds the k-th
chunks of all ids that have one, end to end. A bitmap says which chunks of a level go on in the
next, and a directory of ranks, one for each block of bits, where: the number of
bits set before a place is the place of its next chunk.

File, all numbers little-endian: magic, number of levels (u32), of documents (u64), of ids
(u64); document ids (i64), bits of those that are null, ends of documents in ids (u64); per
level the number of its chunks (u64), the chunks, and but for the last the bitmap and the
directory (u64); crc32 of all that (u32).
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_rows, in_arrow, ready, scratch, table
from .packing import TOKENIZER, _encoder

# Fixed values of the format.
MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIQQ")
BLOCK = 512

END_ID = 2
#: Ids of a file, after which the next document begins another, and bytes of a row group of written files.
FILE_IDS, GROUP_BYTES = 1 << 20, 16 << 20
#: Tokens looked up in one row.
WANTED = 1 << 16

FILES = "part int, seq int, n_docs long, n_ids long, content binary"
TEXTS = "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<bigint>, problem string"

_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


# -- one file ---------------------------------------------------------------------------------


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of the documents' ids, which lie end to end in ``ids``."""
    ends = np.cumsum(lengths, dtype="<u8")
    nulls = np.array([d is None for d in doc_ids], bool)
    levels, left = [], ids.astype(np.uint32)
    while True:
        level = [struct.pack("<Q", len(left)), (left & 0xFF).astype(np.uint8).tobytes()]
        goes_on = left > 0xFF
        levels.append(level)
        if not goes_on.any():
            break
        bits = np.packbits(goes_on, bitorder="little")
        sums = np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.int64))
        level += [bits.tobytes(), np.concatenate([[0], sums[:-1]]).astype("<u8").tobytes()]
        left = left[goes_on] >> np.uint32(8)
    body = b"".join([HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(nulls, bitorder="little").tobytes(), ends.tobytes(), *(x for level in levels for x in level)])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Level:
    chunks: np.ndarray
    bits: np.ndarray | None = None
    ranks: np.ndarray | None = None

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place: the directory's number and those of one block."""
        out = np.empty(len(places), np.int64)
        width = BLOCK // 8
        for k in range(0, len(places), 4096):
            some = places[k : k + 4096]
            block = np.minimum(some // BLOCK, len(self.ranks) - 1)
            byte = block[:, None] * width + np.arange(width + 1)
            here = np.where(byte < len(self.bits), self.bits[np.minimum(byte, len(self.bits) - 1)], 0)
            whole = byte < (some // 8)[:, None]
            last = byte == (some // 8)[:, None]
            here = np.where(whole, here, np.where(last, here & ((1 << (some % 8)) - 1)[:, None], 0)).astype(np.uint8)
            out[k : k + 4096] = self.ranks[block].astype(np.int64) + _POPCOUNT[here].sum(axis=1)
        return out

    def flags(self, start: int, end: int) -> np.ndarray:
        """The bits of the places [start, end)."""
        first = start // 8
        return np.unpackbits(self.bits[first : -(-end // 8)], bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)


class Codes:
    """A file that was read: documents, and ids by place. ValueError says what is wrong with it."""

    def __init__(self, content: bytes):
        if len(content) < HEAD.size + 4 or content[:4] != MAGIC:
            raise ValueError("no file of codes")
        if zlib.crc32(memoryview(content)[:-4]) != struct.unpack_from("<I", content, len(content) - 4)[0]:
            raise ValueError("checksum doesn't fit")
        _, n_levels, self.n_docs, self.n_ids = HEAD.unpack_from(content)
        self.at, self.content = HEAD.size, content
        doc_ids, nulls = self._take("<i8", self.n_docs), np.unpackbits(self._take(np.uint8, -(-self.n_docs // 8)), count=self.n_docs, bitorder="little")
        self.doc_ids = pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool))
        self.ends = self._take("<u8", self.n_docs).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            level = Level(self._take(np.uint8, n))
            if k + 1 < n_levels:
                level.bits, level.ranks = self._take(np.uint8, -(-n // 8)), self._take("<u8", -(-n // BLOCK))
            self.levels.append(level)
        if self.at != len(content) - 4 or not self.levels or len(self.levels[0].chunks) != self.n_ids:
            raise ValueError("lengths don't fit")

    def _take(self, kind, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.at + size > len(self.content) - 4:
            raise ValueError("file is cut off")
        self.at += size
        return np.frombuffer(self.content, kind, n, self.at - size)

    def tokens_at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each by its own chunks."""
        out, open_, at = np.zeros(len(places), np.uint32), np.arange(len(places)), np.asarray(places, np.int64)
        for k, level in enumerate(self.levels):
            out[open_] |= level.chunks[at].astype(np.uint32) << np.uint32(8 * k)
            if level.bits is None:
                break
            more = (level.bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            open_, at = open_[more], level.rank(at[more])
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of the places [start, end): two ranks a level, then chunks one after another."""
        out, open_ = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, level in enumerate(self.levels):
            if start == end:
                break
            out[open_] |= level.chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            if level.bits is None:
                break
            open_ = open_[level.flags(start, end)]
            start, end = level.rank(np.array([start, end])).tolist()
        return out


# -- on Spark ---------------------------------------------------------------------------------


def token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, seq, n_docs, n_ids, content``: files of the documents' ids in order of (part, seq), documents in order of id.

    One shuffle deals texts out by ranges of id; texts of one id are in order of their hash, so
    that an id that many rows have is dealt out too. Null ids stand first, a null
    text is the end id alone, and equal rows stand side by side. A file ends with the document
    that makes it ``file_ids`` long, so a worker holds one file. An empty table gives no files.
    """
    ready(docs.sparkSession)
    order = ["doc_id", "tie"]
    rows = doc_rows(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])

    def run(batches):
        import public_tokenizers
        from pyspark import TaskContext

        encoder, part, seq = _encoder(path or public_tokenizers.path(TOKENIZER)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, held = [], [], bytearray()

        def file():
            content, n_ids = encode_file(doc_ids, np.array(lengths, np.int64), np.frombuffer(bytes(held), "<u4")), len(held) // 4
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [n_ids], "content": [content]}, kinds)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                doc_ids.append(doc)
                raw = encoder.encode(text.as_py()) + end
                held += raw
                lengths.append(len(raw) // 4)
                if len(held) >= 4 * file_ids:
                    yield file()
                    doc_ids, lengths, held, seq = [], [], bytearray(), seq + 1
        if doc_ids:
            yield file()

    return in_arrow(dealt, run, FILES)


def read_texts(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of files (``part, seq, content``), each read by its own span.

    ``part, seq, doc_id, local_start, n_tokens, ids_crc32, ids, problem``; ``ids`` is null unless
    wanted. A file that can't be read is one row whose ``problem`` says why.
    """
    ready(files.sparkSession)
    kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64())), ("problem", pa.string())])

    def run(batches):
        for batch in batches:
            for part, seq, content in zip(*(batch.column(c) for c in ("part", "seq", "content")), strict=True):
                try:
                    codes = Codes(content.as_py() or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"part": part.as_py(), "seq": seq.as_py(), "problem": str(e)}], kinds)
                    continue
                starts = np.concatenate([[0], codes.ends])
                for low in range(0, codes.n_docs, 4096):
                    high = min(low + 4096, codes.n_docs)
                    texts = [codes.span(int(starts[d]), int(starts[d + 1])) for d in range(low, high)]
                    n = high - low
                    ids = pa.array([t.astype(np.int64) for t in texts] if with_ids else [None] * n, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.repeat(seq, n), codes.doc_ids[low:high], pa.array(starts[low:high]), pa.array(np.diff(starts[low : high + 1])), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in texts], pa.int64()), ids, pa.nulls(n, pa.string())], schema=kinds)

    return in_arrow(files.select("part", "seq", "content"), run, TEXTS)


def file_starts(files: DataFrame) -> DataFrame:
    """``part, seq, base``: the number of ids in all files before.

    Sums run over the files of a part, and over the parts, of which a shuffle's number of
    partitions is the bound; contents are not read.
    """
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("__before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return sizes.withColumn("__within", within).join(parts, "part").select("part", "seq", (F.col("__before") + F.col("__within")).alias("base"))


def read_documents(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids, problem``: ``start`` counts the ids of all documents before."""
    rows = read_texts(files, with_ids).join(file_starts(files), ["part", "seq"])
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "ids", "problem")


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``place, token`` of the places in ``wanted`` (counted over all files): only their own chunks are read.

    A place finds its file by the multiples of the longest file's length that the file touches,
    an equality. A file's places come in rows of WANTED at most. Places beyond the last id have no row.
    """
    ready(files.sparkSession)
    longest = F.lit(files.agg(F.coalesce(F.max("n_ids"), F.lit(1)).alias("n")).first()["n"])
    bounds = files.select("part", "seq", "n_ids").join(file_starts(files), ["part", "seq"])
    touched = bounds.withColumn("__cell", F.explode(F.array_distinct(F.array(F.floor(F.col("base") / longest), F.floor((F.col("base") + F.col("n_ids") - 1) / longest)))))
    places = wanted.select(F.col("place").cast("long").alias("place")).filter("place >= 0").distinct().withColumn("__cell", F.floor(F.col("place") / longest))
    found = places.join(touched, "__cell").filter("place >= base AND place < base + n_ids")
    grouped = found.groupBy("part", "seq", "base", F.floor((F.col("place") - F.col("base")) / WANTED).alias("block")).agg(F.collect_list("place").alias("places"))
    rows = grouped.join(files.select("part", "seq", "content"), ["part", "seq"]).select("base", "places", "content")

    def run(batches):
        for batch in batches:
            for base, places, content in zip(*batch.columns, strict=True):
                at = np.array(places.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(Codes(content.as_py()).tokens_at(at - base.as_py()).astype(np.int64))], names=["place", "token"])

    return in_arrow(rows, run, "place long, token long")


def written_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files of ``docs`` as a written table in the shared folder, which outlives executors."""
    spark = ready(docs.sparkSession)
    place = scratch(spark, "codes")
    token_files(docs, path, end_id, id_col=id_col, text_col=text_col).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(place)
    return spark.read.schema(FILES).parquet(place)


def op13_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written_files(table(ready(spark), sf_dir, "documents"))
    return read_documents(files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
