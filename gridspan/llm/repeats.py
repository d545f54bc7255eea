"""Repeated stretches across documents: seeds found by winnowing, joined on Spark, settled in small groups.

Shared by the byte-wise and the word-wise substring deduplication. A stretch is ``length``
symbols; every stretch holds an anchor, a run of ``gram`` symbols that winnowing picks by
content, so equal stretches meet at equal anchors, at the same place within the stretch:

1. Each document's anchors, with a hash of the anchor and one of its context (all symbols of
   the stretches that have this anchor), are shuffled by anchor. Of equal contexts all but the
   first are covered whole: each of their stretches starts earlier in the first. Anchors with
   one context end here.
2. First contexts of anchors with several contexts are fetched from their documents and
   settled together, a bounded number at a time.
3. Covered places are joined to the documents again.

Nothing holds all occurrences of an anchor. Equal contexts are reduced to the first already in
each batch. Where one anchor has many contexts, it is not enough to tell stretches apart, and a
longer one takes its place: a context is cut into PARTS by how far its stretches reach to the
left of the anchor, and each part is keyed with all symbols that its stretches share, 9 in 10
of a stretch. A context so gives at most PARTS rows, most of which meet no other. Where even
that is shared too widely, single stretches are the keys. Anchors and parts that a sample of
documents finds in HOT_SHARE of them are cut when they are found, others beyond WIDE contexts
when they are fetched. Each way gives the same spans, so neither sample nor thresholds touch
the result, and neither depends on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import winnow
from .common import SLICE, by_batch, byte_prefix, byte_spans, find_words, groups_of, in_arrow, mixed, ready, scratch, span_hashes, utf8, word_prefix, word_spans

#: Contexts of one key that are settled together; up to so many times that, they are cut into parts, beyond into single stretches.
WIDE, WIDER = 2000, 16
#: Parts of a context, by the reach of its stretches to the left of the anchor.
PARTS = 8
#: One in so many documents is looked at for keys in a share of at least HOT_SHARE of them: at
#: most (keys of a document) / HOT_SHARE keys, whatever the number of documents.
HOT_SAMPLE, HOT_SHARE = 32, 0.004
#: Stretches settled at a time.
AT_ONCE = 150_000

NO_ID = -(1 << 63)
#: shape: stretches of the context, and 2 ** 12 times how far the first reaches to the left of the anchor; state: SEED, PART or AGAIN.
SEEDS = "anchor long, context long, doc long, tie int, start int, shape int, state int"
CONTEXTS = "key long, doc long, tie int, start int, shape int, payload binary, more binary"
SPANS = "doc long, tie int, start int, length int"
#: What a row of SEEDS is: a context under its anchor, a part of one under a longer key, or one that repeats an earlier one of its batch.
SEED, PART, AGAIN = 0, 1, 2


@dataclass(frozen=True)
class Symbols:
    """What a stretch is made of. ``earlier`` says what counts as earlier: any place or only another document."""

    name: str
    length: int
    gram: int
    by_document: bool

    @property
    def width(self) -> int:
        """Grams of a stretch."""
        return self.length - self.gram + 1

    @property
    def part(self) -> int:
        """Stretches of a part, at most."""
        return -(-self.width // PARTS)


@dataclass
class Sequence:
    """Symbols of some documents end to end: offsets, hashes of spans, and the part of each document that is reported."""

    docs: np.ndarray
    offsets: np.ndarray
    base: int
    core: tuple[int, int] | None
    spans: Callable[[np.ndarray, np.ndarray], np.ndarray]


def sequences(kind: Symbols, buf: np.ndarray, off: np.ndarray) -> Iterator[Sequence]:
    for a, b in groups_of(off):
        piece, own = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        if kind.name == "words":
            start, end, first = find_words(piece, own)
            prefix = word_prefix(span_hashes(piece, start, end))
            yield Sequence(np.arange(a, b), first, 0, None, lambda s, e, p=prefix: word_spans(p, s, e))
        elif len(piece) <= 2 * SLICE:
            prefix = byte_prefix(piece)
            yield Sequence(np.arange(a, b), own, 0, None, lambda s, e, p=prefix: byte_spans(p, s, e))
        else:  # a long document, in parts that overlap by what a context needs
            for c in range(0, len(piece), SLICE):
                lo, hi = max(0, c - 2 * kind.length), min(len(piece), c + SLICE + 2 * kind.length)
                prefix = byte_prefix(piece[lo:hi])
                yield Sequence(np.array([a]), np.array([0, hi - lo]), lo, (c, c + SLICE), lambda s, e, p=prefix: byte_spans(p, s, e))


def find_anchors(kind: Symbols, seq: Sequence) -> tuple[np.ndarray, ...]:
    """(document, anchor, first stretch, last stretch, anchor hash), places within the sequence.

    A stretch belongs to the anchor that winnowing picks for it, so that each is dealt with
    once; those of an anchor follow one another, and its context is what they span.
    """
    off = seq.offsets
    n = int(off[-1])
    none = np.zeros(0, np.int64)
    if n < kind.length:
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(n - kind.gram + 1)
    which = np.repeat(np.arange(len(off) - 1), np.diff(off))
    hashes = seq.spans(at, at + kind.gram)
    valid = at + kind.length <= off[which[: len(at)] + 1]
    a, keys = winnow(hashes, valid, kind.width)
    d, key = which[a], keys[a]
    # of two neighbours the smaller one has all stretches that hold it
    same = d[1:] == d[:-1]
    last = np.concatenate([np.where(same, np.where(key[:-1] < key[1:], a[:-1], a[1:] - kind.width), a[:-1]), a[-1:]])
    last = np.minimum(last, off[d + 1] - kind.length)
    first = np.maximum(off[d], a - kind.width + 1)
    first[1:] = np.where(same, np.maximum(first[1:], last[:-1] + 1), first[1:])
    keep = last >= first
    if seq.core is not None:
        keep &= (a + seq.base >= seq.core[0]) & (a + seq.base < seq.core[1])
    return d[keep], a[keep], first[keep], last[keep], hashes[a[keep]]


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts[i] copies of i: i, and the copy's number."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def find_seeds(kind: Symbols, seq: Sequence, hot: np.ndarray | tuple = ()) -> tuple[np.ndarray, ...]:
    """(document, first stretch, shape, key, context hash, state) of each context, or part of one under a hot key.

    ``hot`` is a sorted array of keys: contexts of an anchor among them are cut into parts,
    and parts whose key is among them into single stretches.
    """
    d, a, first, last, key = find_anchors(kind, seq)
    state = np.full(len(d), SEED, np.int32)
    for finer, before in ((kind.part, SEED), (1, PART)):
        cut = np.flatnonzero(_among(key, hot) & (state == before))
        if not len(cut):
            continue
        low, high = (a - last)[cut] // finer, (a - first)[cut] // finer
        of, step = _steps(high - low + 1)
        j, old = low[of] + step, cut[of]
        reach = j * finer
        f, l = np.maximum(first[old], a[old] - reach - finer + 1), np.minimum(last[old], a[old] - reach)  # noqa: E741
        shared = mixed(seq.spans(a[old] - reach, a[old] - reach - finer + 1 + kind.length) ^ mixed(j.astype(np.uint64) + np.uint64(finer)))
        stay = np.ones(len(d), bool)
        stay[cut] = False
        d, a, first, last, key, state = (np.concatenate([x[stay], y]) for x, y in ((d, d[old]), (a, a[old]), (first, f), (last, l), (key, shared), (state, np.full(len(old), PART, np.int32))))
    context = mixed(seq.spans(first, last + kind.length) ^ mixed((a - first).astype(np.uint64)))
    return seq.docs[d], first - seq.offsets[d] + seq.base, last - first + 1 + ((a - first) << 12), key, context, state


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, doc, tie, text``: a null id stands before all others; rows of one id and text are one document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), (F.crc32(F.col("text").cast("binary")) - F.lit(1 << 31)).cast("int").alias("tie"), "text")


def seeds(rows: DataFrame, kind: Symbols, hot: list[int], fold: bool = True) -> DataFrame:
    """All contexts, those under hot keys in parts. With ``fold``, what repeats an earlier context of its batch is AGAIN and goes to any task."""
    often = np.sort(np.array(hot, np.int64).astype(np.uint64))

    def one(batch):
        buf, off = utf8(batch.column("text"))
        doc_ids, ties = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
        found = [find_seeds(kind, s, often) for s in sequences(kind, buf, off)]
        if not found:
            return None
        d, pos, shape, anchor, context, state = map(np.concatenate, zip(*found, strict=True))
        if not len(d):
            return None
        doc, tie = doc_ids[d], ties[d]
        if fold:
            both = mixed(anchor + np.uint64(0x632BE59BD9B4E019) * context)
            order = np.lexsort((pos, tie, doc, both))
            g = both[order]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            o_doc, o_tie, o_pos = doc[order], tie[order], pos[order]
            later = o_doc > o_doc[lead]
            if not kind.by_document:
                later |= (o_doc == o_doc[lead]) & ((o_tie != o_tie[lead]) | (o_pos != o_pos[lead]))
            again = order[later]
            state[again] = AGAIN
            anchor[again] = mixed(anchor[again] ^ mixed(doc[again].astype(np.uint64) + pos[again].astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(context.astype(np.int64)), pa.array(doc), pa.array(tie.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(shape.astype(np.int32)), pa.array(state)], names=[x.split()[0] for x in SEEDS.split(", ")])

    return by_batch(rows.select("doc", "tie", "text"), one, SEEDS)


def hot_keys(rows: DataFrame, kind: Symbols) -> list[int]:
    """Anchors, and then parts of their contexts, in a share of HOT_SHARE of a sample of documents, two at least."""
    spark = rows.sparkSession
    place = scratch(spark, "sample")
    rows.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(HOT_SAMPLE)) == 0).select("doc", "tie", "text").write.parquet(place)
    sample = spark.read.schema("doc long, tie int, text string").parquet(place)
    least = max(2.0, HOT_SHARE * sample.count())
    hot: list[int] = []
    for _ in range(2):
        often = seeds(sample, kind, hot).filter(F.col("state") != AGAIN).groupBy("anchor").count().filter(F.col("count") >= least)
        hot += [r[0] for r in often.select("anchor").collect()]
    return sorted(set(hot))


def matched(rows: DataFrame, kind: Symbols, fold: bool = True) -> DataFrame:
    """``doc, tie, covered, need``: contexts that are covered whole, and those to be settled."""
    order = ["doc"] if kind.by_document else ["doc", "tie", "start"]
    found = seeds(rows, kind, hot_keys(rows, kind), fold).repartition("anchor")
    by_anchor = Window.partitionBy("anchor")
    # of equal contexts the first; in the word-wise case all those of the first document, of which one counts
    own = Window.partitionBy("anchor", "context").orderBy(*order)
    first = F.rank().over(own) == 1 if fold else F.lit(True)
    ranked = found.withColumn("first", first & (F.col("state") != AGAIN)).withColumn("counts", F.col("first") & ((F.row_number().over(own) == 1) if fold else F.lit(True)))
    ranked = ranked.withColumns({"firsts": F.sum(F.col("counts").cast("int")).over(by_anchor), "docs_differ": F.min("doc").over(by_anchor) < F.max("doc").over(by_anchor)})
    several = (F.col("firsts") > 1) & (F.col("docs_differ") if kind.by_document else F.lit(True))
    level = F.when(F.col("firsts") <= WIDE, 0).when((F.col("firsts") <= WIDE * WIDER) & (F.col("state") == SEED), 1).otherwise(2).cast("int")
    kept = ranked.withColumn("is_need", F.col("first") & several).filter(~F.col("first") | F.col("is_need"))
    whole = F.struct("start", (F.col("shape").bitwiseAND(F.lit(4095)) + F.lit(kind.length - 1)).alias("length"))
    return kept.groupBy("doc", "tie").agg(F.collect_set(F.when(~F.col("is_need"), whole)).alias("covered"), F.collect_set(F.when(F.col("is_need"), F.struct("start", "shape", F.col("anchor").alias("key"), level.alias("level")))).alias("need"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def cut(kind: Symbols, level: int, key: int, start: int, n: int, reach: int, take: Callable[[int, int], bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(key, start, stretches, reach, payload) of a context: whole, in parts (level 1) or in single stretches (level 2).

    ``take(a, b)`` gives the symbols from a to b of the document; reach is that of the first
    stretch to the left of the anchor.
    """
    if level == 0:
        yield key, start, n, reach, take(start, start + n - 1 + kind.length)
    elif level == 1:
        anchor, size = start + reach, kind.part
        for j in range((reach - n + 1) // size, reach // size + 1):
            f, last = max(start, anchor - j * size - size + 1), min(start + n - 1, anchor - j * size)
            shared = take(anchor - j * size, anchor - j * size - size + 1 + kind.length)
            yield hash_of(b"%d %d " % (key, j) + shared), f, last - f + 1, anchor - f, take(f, last + kind.length)
    else:
        for s in range(start, start + n):
            own = take(s, s + kind.length)
            yield hash_of(own), s, 1, start + reach - s, own


def contexts(joined: DataFrame, kind: Symbols, fold: bool = True) -> DataFrame:
    """The contexts to be settled, under their keys; of those with many, parts or single stretches.

    The payload is the context itself, words with one blank between. What a cut finds that its
    batch has already seen earlier is covered: it comes without payload. Where repeats within a
    document don't count, a document's equal contexts are one row, with the other places in ``more``.
    """
    words = kind.name == "words"

    def one(batch):
        at, items = _lists(batch, "need")
        if not len(items):
            return None
        starts, shapes, keys, levels = (items.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(4))
        doc_ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        texts = batch.column("text").cast(pa.binary())
        out: list[tuple] = []
        seen: dict[tuple, tuple] = {}
        for i in np.lexsort((ties, doc_ids)).tolist():
            mine = range(int(at[i]), int(at[i + 1]))
            if not mine:
                continue
            doc, tie, raw = int(doc_ids[i]), int(ties[i]), texts[i].as_py()
            if words:
                split = raw.split()  # cuts bytes at the six ASCII characters
                take = lambda a, b, x=split: b" ".join(x[a:b])
            else:
                take = lambda a, b, x=raw: x[a:b]
            places: dict[tuple, list[int]] = {}
            for k in sorted(mine, key=starts.__getitem__):
                for key, s, n, reach, payload in cut(kind, levels[k], keys[k], starts[k], shapes[k] & 4095, shapes[k] >> 12, take):
                    if levels[k] and fold:
                        first = seen.setdefault((key, reach, payload), (doc, tie, s))
                        if first[0] < doc or not kind.by_document and first != (doc, tie, s):
                            out.append((hash_of(b"%d %d" % (doc, s)), doc, tie, s, n, None, None))  # to any task
                            continue
                    if kind.by_document:
                        places.setdefault((key, n + (reach << 12), payload), []).append(s)
                    else:
                        out.append((key, doc, tie, s, n + (reach << 12), payload, None))
            for (key, shape, payload), own in places.items():
                out.append((key, doc, tie, own[0], shape, payload, np.array(own[1:], np.int32).tobytes() if len(own) > 1 else None))
        if not out:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])

    return by_batch(joined.select("doc", "tie", "text", "need"), one, CONTEXTS)


def hash_of(data: bytes) -> int:
    """A signed 64-bit hash of a few bytes."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Group:
    """Contexts that are settled together, those of a key side by side and in the order of their places."""

    payloads: list[bytes]
    stretches: np.ndarray
    reach: np.ndarray
    key: np.ndarray
    doc: np.ndarray


#: From a group: the covered runs of symbols, as (context, first symbol, length).
Settler = Callable[[Group], tuple[np.ndarray, np.ndarray, np.ndarray]]


def settle(found: DataFrame, kind: Symbols, covered_runs: Settler, fold: bool = True) -> DataFrame:
    """Spans covered by earlier equal stretches, ``doc, tie, start, length``."""

    def decide(rows: list[tuple], out: list[tuple]) -> pa.RecordBatch | None:
        if len(rows) > 1:
            keys, shape = np.array([r[0] for r in rows]), np.array([r[4] for r in rows])
            group = Group([r[5] for r in rows], shape & 4095, shape >> 12, np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])), np.array([r[1] for r in rows]))
            for i, first, length in zip(*(x.tolist() for x in covered_runs(group)), strict=True):
                _, doc, tie, start, _, _, more = rows[i]
                out.append((doc, tie, start + first, length))
                if more:
                    out += [(doc, tie, s + first, length) for s in np.frombuffer(more, np.int32).tolist()]
        if not out:
            return None
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "tie", "start", "length"])

    def run(batches):
        with np.errstate(over="ignore"):
            rows: list[tuple] = []
            out: list[tuple] = []
            held, first = 0, None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, doc, tie, start, shape, payload, more = row
                    n = shape & 4095
                    if payload is None:
                        out.append((doc, tie, start, n - 1 + kind.length))
                        continue
                    if rows and row[:5] == rows[-1][:5]:
                        continue  # one row of the input twice
                    if first is None or first[0] != key:
                        if held >= AT_ONCE or len(out) >= AT_ONCE:
                            if (made := decide(rows, out)) is not None:
                                yield made
                            rows, out, held = [], [], 0
                        first = row
                    elif fold and payload == first[5] and shape == first[4]:  # equals the first: covered whole, so it need not be held
                        if doc > first[1] or not kind.by_document:
                            out += [(doc, tie, s, n - 1 + kind.length) for s in (start, *(np.frombuffer(more, np.int32).tolist() if more else ()))]
                        continue
                    rows.append(row)
                    held += n
            if (made := decide(rows, out)) is not None:
                yield made

    return in_arrow(found.repartition("key").sortWithinPartitions("key", "doc", "tie", "start"), run, SPANS)


def marked(docs: DataFrame, kind: Symbols, covered_runs: Settler, id_col: str = "doc_id", text_col: str = "text", fold: bool = True) -> DataFrame:
    """``doc_id, text, spans`` of every row: the spans that are covered, in symbols.

    ``fold`` drops contexts that equal an earlier one before they are settled, which changes
    no result: all their stretches start in the earlier one.
    """
    spark = ready(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    at = scratch(spark, "repeats")
    matched(rows, kind, fold).write.parquet(f"{at}/matched")
    span = "array<struct<start:int,length:int>>"
    match = spark.read.schema(f"doc long, tie int, covered {span}, need array<struct<start:int,shape:int,key:long,level:int>>").parquet(f"{at}/matched")
    by_doc = rows.repartition("doc", "tie")
    need = match.filter(F.size("need") > 0).select("doc", "tie", "need")
    settle(contexts(by_doc.join(need, ["doc", "tie"]), kind, fold), kind, covered_runs, fold).groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "length")).alias("spans")).write.parquet(f"{at}/spans")
    spans = spark.read.schema(f"doc long, tie int, spans {span}").parquet(f"{at}/spans")
    both = match.select("doc", "tie", "covered").join(spans, ["doc", "tie"], "full")
    none = F.array().cast(span)
    return by_doc.join(both, ["doc", "tie"], "left").select("doc_id", "text", F.concat(F.coalesce("covered", none), F.coalesce("spans", none)).alias("spans"))


def marks(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the covered spans of row i, in symbols."""
    spans = batch.column("spans")[i].values
    start, length = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
    return start, start + length
