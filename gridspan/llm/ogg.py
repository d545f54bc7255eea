"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, doc_rows, in_arrow, ready, table

# Fixed values of the format and of the stored payload.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
UNIT, PAD, TAIL = 576, 255, 32
HEADER = struct.Struct("<4sBBqIIIB")

#: Samples a second, packets a page, and the serial numbers of the two streams.
RATE, PAGE_PACKETS = 48_000, 80
AUDIO, MARKS = 0x41, 0x4D

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, unreflected, from 0: zlib's on mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int  # of the page on which it ends; -1 if that page has none
    seconds: float | None


@dataclass
class Parsed:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    problems: list[str] = field(default_factory=list)


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def build_page(serial: int, sequence: int, granule: int, flags: int, laces: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(laces)) + laces
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream from (packet, granule position at its end)."""
    pages, laces, body, granule, begun, ends = [], b"", [], -1, False, 0

    def close(more: bool) -> None:
        nonlocal laces, body, granule, begun, ends
        flags = CONTINUED * begun | FIRST * (not pages)
        pages.append((flags, granule, laces, b"".join(body)))
        laces, body, granule, begun, ends = b"", [], -1, more, 0

    for k, (data, end) in enumerate(packets):
        values, at = lacing(len(data)), 0
        while values:
            room = 255 - len(laces)
            now, values = values[:room], values[room:]
            size = sum(now)
            laces += now
            body.append(data[at : at + size])
            at += size
            if values:
                close(True)
        granule, ends = end, ends + 1
        if k == 0 or ends >= PAGE_PACKETS:  # the first packet has a page of its own
            close(False)
    if laces or not pages:
        close(False)
    flags, *rest = pages[-1]
    pages[-1] = (flags | LAST, *rest)
    return [build_page(serial, i, g, f, x, b) for i, (f, g, x, b) in enumerate(pages)]


def multiplex(streams: list[list[bytes]]) -> bytes:
    """First pages first, then the streams' pages in turn."""
    out, rest = [s[0] for s in streams], [s[1:] for s in streams]
    while any(rest):
        for s in rest:
            if s:
                out.append(s.pop(0))
    return b"".join(out)


def parse(content: bytes, rates: dict[int, int] | None = None) -> Parsed:
    """All packets of all streams in the order they end, with every check.

    A page with a wrong checksum, version or length is left out and reported, and the search
    goes on at the next capture pattern; a gap in a stream's page numbers drops the packet
    that it breaks. ``rates``: granules a second by serial; RATE for the others.
    """
    found, at = Parsed(), 0
    state: dict[int, dict] = {}
    while at < len(content):
        if content[at : at + 4] != CAPTURE:
            nxt = content.find(CAPTURE, at + 1)
            found.problems.append(f"no page at byte {at}")
            if nxt < 0:
                break
            at = nxt
            continue
        if at + 27 > len(content):
            found.problems.append(f"page at byte {at} is cut off")
            break
        _, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(content, at)
        laces = content[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        page = content[at:end]
        if version or len(laces) < n or end > len(content) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            found.problems.append(f"page at byte {at} fails its check")
            nxt = content.find(CAPTURE, at + 4)
            if nxt < 0:
                break
            at = nxt
            continue
        found.pages += 1
        s = state.setdefault(serial, {"next": 0, "part": [], "open": False, "number": 0})
        if sequence != s["next"]:
            found.problems.append(f"stream {serial} lacks page {s['next']}")
            s["part"], s["open"] = [], False
        s["next"] = sequence + 1
        skip = bool(flags & CONTINUED) and not s["open"]
        if not flags & CONTINUED and s["open"]:
            found.problems.append(f"stream {serial} breaks off a packet")
            s["part"] = []
        pos, run, done = at + 27 + n, 0, []
        for v in laces:
            run += v
            if v < 255:
                s["part"].append(content[pos : pos + run])
                pos, run = pos + run, 0
                if not skip:
                    done.append(b"".join(s["part"]))
                skip, s["part"] = False, []
        if n and laces[-1] == 255:
            s["part"].append(content[pos : pos + run])
            s["open"] = not skip
        else:
            s["open"] = False
        rate = (rates or {}).get(serial, RATE)
        for k, data in enumerate(done):
            last = k == len(done) - 1 and granule >= 0
            found.packets.append(Packet(serial, s["number"], data, granule if last else -1, granule / rate if last else None))
            s["number"] += 1
        at = end
    return found


def store(payload: bytes) -> bytes:
    """A payload of 8-bit samples as an Ogg file of two streams: the samples, and a mark every second of them."""
    n = len(payload) // UNIT
    head = b"\x01pcm8" + struct.pack("<IQ", RATE, len(payload))
    audio = [(head, 0)] + [(payload[i * UNIT : (i + 1) * UNIT], (i + 1) * UNIT) for i in range(n)]
    marks = [(b"\x01mark" + struct.pack("<I", RATE), 0)] + [(struct.pack("<QI", t, zlib.crc32(payload[t : t + RATE])), min(t + RATE, len(payload))) for t in range(0, len(payload), RATE)]
    return multiplex([stream_pages(AUDIO, audio), stream_pages(MARKS, marks)])


def load(content: bytes) -> tuple[bytes, Parsed]:
    """The samples of a stored file; ValueError if any check fails."""
    parsed = parse(content)
    audio = [p for p in parsed.packets if p.serial == AUDIO]
    if parsed.problems or not audio or audio[0].data[:5] != b"\x01pcm8":
        raise ValueError("; ".join(parsed.problems) or "no stream of samples")
    payload = b"".join(p.data for p in audio[1:])
    if struct.unpack_from("<Q", audio[0].data, 9)[0] != len(payload) or audio[-1].granule != len(payload):
        raise ValueError("the samples end too early")
    for p in parsed.packets:
        if p.serial == MARKS and p.number:
            t, crc = struct.unpack("<QI", p.data)
            if zlib.crc32(payload[t : t + RATE]) != crc:
                raise ValueError(f"the samples at {t} don't have their mark")
    return payload, parsed


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def features(payload: bytes, parsed: Parsed) -> str:
    """Streams, pages, packets and times of the file; mean and peak of the samples."""
    streams = sorted({p.serial for p in parsed.packets})
    last = max(p.seconds for p in parsed.packets if p.seconds is not None)
    samples = np.frombuffer(payload, np.uint8)
    return f"streams={len(streams)};pages={parsed.pages};packets={','.join(str(sum(p.serial == s for p in parsed.packets)) for s in streams)};seconds={last:.6f};mean={samples.mean():.6f};peak={samples.max()}"


# -- on Spark ---------------------------------------------------------------------------------


def ogg_packets(media: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """The packets of Ogg files in a binary column: ``id, serial, number, granule, seconds, data, problem``.

    Null or empty content has no packets. Damage gives a row of its own with ``problem`` set.
    """
    ready(media.sparkSession)
    kind = media.select(id_col).schema[0].dataType.simpleString()
    schema = pa.schema([("serial", pa.int64()), ("number", pa.int64()), ("granule", pa.int64()), ("seconds", pa.float64()), ("data", pa.binary()), ("problem", pa.string())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parsed = parse(batch.column(1)[i].as_py() or b"")
                rows = [(p.serial, p.number, p.granule, p.seconds, p.data, None) for p in parsed.packets] + [(None, None, None, None, None, x) for x in parsed.problems]
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    cols = [pa.array([r[k] for r in part], schema.field(k).type) for k in range(6)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(i, 1)] * len(part)), *cols], names=["id", *schema.names])

    return in_arrow(media.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")), run, f"id {kind}, serial long, number long, granule long, seconds double, data binary, problem string")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text, in UTF-8 and padded, as an Ogg file."""
    ready(docs.sparkSession)

    def one(batch):
        texts = [t.as_py() for t in batch.column("text").cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return by_batch(doc_rows(docs, id_col, text_col), one, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads stored texts back and digests what was read."""
    ready(media.sparkSession)

    def one(batch):
        cols: list[list] = [[] for _ in range(6)]
        for content in batch.column("media"):
            content = content.as_py()
            payload, parsed = load(content)
            for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(content), hashlib.sha256(content).hexdigest(), features(payload, parsed)), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *map(pa.array, cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return by_batch(media, one, SCHEMA)


def op9_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file and read back.

    A null or empty text is one unit of padding. Equal texts give equal files and values;
    rows are handled alone, so null ids, ties and repeats need no care; a long text is held
    a few times over in one task and no more. An empty table gives no rows.
    """
    return media_digests(stored_texts(table(spark, sf_dir, "documents")))
