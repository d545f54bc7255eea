"""WARC archives in zstandard: written with duplicates as revisits, read back frame by frame."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, ready, scratch, table

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that carries an archive's dictionary
DICTIONARY_KIND = 0xEC30A437  # first word of a structured dictionary
LEAST_DUPLICATE = 100
CRLF = b"\r\n"

#: Payload bytes of an archive, and of the payloads that its dictionary is made from.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10
LEVEL = 3

ARCHIVES = "archive_id string, content binary"
RECORDS = "archive_id string, frame long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, stored_bytes long, payload binary, problem string"


# -- one archive ------------------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str, digest: str, n_bytes: int, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload of its own."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + re.sub(r"\s", "%20", uri).encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: " + str(n_bytes).encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <" + refers_to.encode() + b">"]
    head += [b"Content-Type: text/html", b"Content-Length: " + str(len(payload)).encode()]
    return CRLF.join(head) + CRLF * 2 + payload + CRLF * 2


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or their first bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    structured = dictionary[:4] == struct.pack("<I", DICTIONARY_KIND)
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if structured else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    """The dictionary in a leading skippable frame, then one frame a record, each with its size and checksum."""
    tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
    lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return lead + b"".join(map(tool.compress, records))


def read_archive(content: bytes) -> Iterator[tuple[int, bytes, str]]:
    """(frame, record, problem) of each frame; damage ends the archive with a problem."""
    at, frame, dictionary = 0, 0, None
    while at + 8 <= len(content) and struct.unpack_from("<I", content, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
        magic, size = struct.unpack_from("<II", content, at)
        if at + 8 + size > len(content):
            yield frame, b"", "skippable frame is cut off"
            return
        if magic == DICTIONARY_MAGIC and at == 0:
            dictionary = content[8 : 8 + size]
            if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
                dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
        at += 8 + size
    tool = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary) if dictionary else None)
    view = memoryview(content)
    while at < len(content):
        one = tool.decompressobj()
        try:
            data = one.decompress(view[at:])
            if not one.eof:
                yield frame, data, "frame is cut off"
                return
        except zstandard.ZstdError as e:
            yield frame, b"", f"frame can't be decoded: {e}"
            return
        at = len(content) - len(one.unused_data)
        yield frame, data, ""
        frame += 1


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, str]:
    """(headers by lower-case name, block, problem): version line, header lines, length and digest are validated."""
    end = data.find(CRLF * 2)
    if end < 0:
        return {}, b"", "no end of headers"
    lines = data[:end].split(CRLF)
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return {}, b"", "no WARC version"
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return headers, b"", "a header line has no name"
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]:
        return headers, b"", f"no {missing[0]}"
    if not headers["content-length"].isdigit():
        return headers, b"", "content-length is no number"
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(data) != end + 4 + size + 4 or data[-4:] != CRLF * 2:
        return headers, block, "content-length doesn't fit the record"
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "").startswith("sha256:") and hashlib.sha256(block).hexdigest() != headers["warc-payload-digest"][7:]:
        return headers, block, "payload doesn't have its digest"
    return headers, block, ""


# -- on Spark ---------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST_DUPLICATE) -> DataFrame:
    """``page_id, uri, payload, digest, n_bytes, refers_to`` of every page; refers_to is null for a response.

    Of pages with one payload of at least ``least`` bytes, the smallest id is the response.
    Digests are aggregated before the shuffle; those of several pages are a written table of a
    row each. The planner broadcasts it while it is small, so that payloads stay where they
    are, and joins by shuffle beyond, where it splits a digest that very many pages have.
    """
    data = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), data.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    firsts = keyed.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("first_digest"), "first_id")
    place = scratch(pages.sparkSession, "firsts")
    firsts.write.parquet(place)
    firsts = pages.sparkSession.read.schema("first_digest string, first_id long").parquet(place)
    return keyed.join(firsts, F.col("digest") == F.col("first_digest"), "left").select("page_id", "uri", "payload", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_archives(planned: DataFrame) -> DataFrame:
    """Archives of some 8 MB of payload, ``archive_id, content``; each is whole in one row."""
    ready(planned.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        records, samples, size, sampled = [], [], 0, 0

        def flush():
            nonlocal records, samples, size, sampled, n
            content = write_archive(records, dictionary_of(samples))
            out = pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([content], pa.binary())], names=["archive_id", "content"])
            records, samples, size, sampled, n = [], [], 0, 0, n + 1
            return out

        for batch in batches:
            for page, uri, payload, digest, n_bytes, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "digest", "n_bytes", "refers_to")), strict=True):
                block = b"" if first is not None else payload
                own = f"urn:page:{'' if page is None else page}"
                records.append(record("response" if first is None else "revisit", own, uri, digest, n_bytes, block, None if first is None else f"urn:page:{first}"))
                size += len(block) + 500
                if sampled < SAMPLE_BYTES:
                    samples.append(block[: 128 << 10])
                    sampled += len(samples[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return in_arrow(planned, run, ARCHIVES)


def _page_of(record_id: str) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", record_id or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame, id_col: str = "archive_id", content_col: str = "content") -> DataFrame:
    """The records of archives in a binary column, such as ``binaryFile`` gives (``path``, ``content``).

    One row per frame. ``problem`` is empty for a valid record, else it says what is wrong;
    a damaged frame ends its archive. Null or empty content has no records.
    """
    ready(archives.sparkSession)
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        schema = pa.schema([("archive_id", pa.string()), ("frame", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("stored_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("__name").to_pylist(), batch.column("__content"), strict=True):
                rows, held = [], 0
                for frame, data, problem in read_archive(content.as_py() or b""):
                    headers, block, wrong = parse_record(data) if not problem else ({}, b"", problem)
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    length = headers.get("x-payload-length", "")
                    rows.append((name, frame, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), _page_of(headers.get("warc-record-id")), _page_of(headers.get("warc-refers-to")), digest or None, int(length) if length.isdigit() else len(block), len(block), block, wrong))
                    held += len(block)
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return in_arrow(archives.select(F.col(id_col).cast("string").alias("__name"), F.col(content_col).alias("__content")), run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages' archives to the shared folder as a table and reads their records back.

    A null payload is empty, a null id is kept null and is never the one referred to. Pages
    that repeat the smallest id of a payload are all responses. An empty table has no archives.
    """
    spark = ready(pages.sparkSession)
    place = scratch(spark, "warc")
    write_archives(plan_records(pages, id_col, uri_col, payload_col)).write.option("compression", "none").parquet(place)
    return read_archives(spark.read.parquet(place))


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes", "problem")


SQL = {
    "op10_warc_zstd": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
), f AS (
  SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to,
  CAST(CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN n ELSE 0 END AS BIGINT) AS stored_bytes, '' AS problem
FROM d LEFT JOIN f USING (digest)
"""
}
