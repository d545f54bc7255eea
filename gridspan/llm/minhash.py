"""Order MinHash near-duplicates: k-mers in text order as sketches, banded alignment as proof.

Two texts meet where a sketch of theirs is equal: in a bucket. What shares a bucket is then
compared to the end, without making a row for every pair:

1. Each text meets the first of its bucket; links that alignment proves make the first classes.
2. A bucket whose texts are still of several classes is open. Its texts are dealt out in blocks,
   and each pair of blocks is compared in one task, which returns only the links it finds: pairs
   of one class are passed over, and so are those that lengths or the words that they have in
   common, whatever their order, rule out. All other pairs are aligned.

Texts whose lengths are too different are never near; so a bucket is divided by bands of length,
in which each text stands in its own and in the next one down.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batch, by_place, find_words, groups_of, in_arrow, mixed, ready, scratch, span_hashes, table, utf8

#: Words of a k-mer, least similarity, sketches, and k-mers of a sketch.
GRAM, SIMILARITY = 5, 0.8
SKETCHES, TOGETHER = 84, 2
#: Texts of fewer words also have sketches of single words, for few k-mers outlive an edit.
SHORT, SHORT_SKETCHES, SHORT_TOGETHER = 80, 20, 3
#: Bytes and texts of a block of an open bucket.
BLOCK_BYTES, BLOCK_TEXTS = 4 << 20, 1000
#: Counters that the words of a text are hashed to, for a first bound on what two texts have in common.
COUNTERS = 256
#: A text, or a node of edges, counts as hot if this share of all rows or more have it, which 1 / HOT_SHARE can at most; its rows are joined in so many parts.
HOT_SHARE, HOT_PARTS = 0.001, 64
#: Rows that are not worth dealing, whatever their share.
FEW = 1000

NO_ID = -(1 << 62)


def _picked(values: np.ndarray, begin: np.ndarray, n: np.ndarray, sketches: int, together: int, seed: int) -> np.ndarray:
    """[document, sketch]: hashes of the ``together`` values of smallest hash of each document, in the order of the text.

    A hash carries its place in the low bits, so that the least one also says where it is.
    """
    bits = np.uint64(max(20, int(len(values)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(values), dtype=np.uint64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    rng = np.random.default_rng(seed)
    flips, factors = rng.integers(1, 2**63, (2, sketches), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(begin), sketches), np.uint64)
    h = np.empty(len(values), np.uint64)
    for j in range(sketches):
        np.bitwise_xor(values, flips[j], out=h)
        h *= factors[j]
        h &= ~mask
        h |= place
        found = []
        for i in range(together):
            at = (np.minimum.reduceat(h, begin) & mask).astype(np.int64)
            found.append(np.where(n > i, at, -1))  # a document of fewer values has none left
            h[at[n > i]] = most
        own = np.full(len(begin), flips[j], np.uint64)
        for at in np.sort(np.stack(found), axis=0):
            own = mixed(own * np.uint64(0x2545F4914F6CDD1D) + np.where(at >= 0, values[np.maximum(at, 0)], 0))
        out[:, j] = own
    return out


def _labelled(kmer: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of k-mers, each with how often it occurred before in its document."""
    key = mixed(kmer) ^ mixed(doc.astype(np.uint64) + np.uint64(0x1234567))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    label = np.empty(len(key), np.uint64)
    label[order] = np.arange(len(key)) - lead
    return mixed(kmer + mixed(label + np.uint64(0x51)))


def order_sketches(buf: np.ndarray, off: np.ndarray, gram: int = GRAM, sketches: int = SKETCHES, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents with a word, their words, hashes, offsets of each document's hashes): Order MinHash sketches.

    K-mers are labelled with how often they occurred before, so that repeats differ. For each
    sketch the ``together`` labelled k-mers of smallest hash are taken and hashed in the order
    of the text. A document of fewer words than a k-mer has one k-mer: all its words. One of
    fewer than SHORT words also has sketches of SHORT_TOGETHER words.
    """
    start, end, first = find_words(buf, off)
    words = np.diff(first)
    docs = np.flatnonzero(words)
    if not len(docs):
        return docs, docs, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    hashes = span_hashes(buf, start, end)
    size = words[docs]
    n = np.maximum(1, size - gram + 1)
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(docs)), n)
    at = np.arange(len(doc)) - np.repeat(begin, n) + np.repeat(first[docs], n)
    padded = np.concatenate([hashes, np.zeros(gram, np.uint64)])
    last = np.repeat(first[docs + 1], n)
    kmer = np.zeros(len(at), np.uint64)
    for i in range(gram):
        kmer = kmer * np.uint64(0x9E3779B97F4A7C15) + np.where(at + i < last, padded[at + i], 0)
    long_ = _picked(_labelled(kmer, doc), begin, n, sketches, together, 7)
    few = np.flatnonzero(size < SHORT)
    counts = np.full(len(docs), sketches)
    counts[few] += SHORT_SKETCHES
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.uint64)
    out[((ends - counts)[:, None] + np.arange(sketches)).ravel()] = long_.ravel()
    if len(few):
        m = size[few]
        to = np.cumsum(m) - m
        of = np.repeat(np.arange(len(few)), m)
        own = hashes[np.arange(len(of)) - to[of] + first[docs[few]][of]]
        short = _picked(_labelled(own, of), to, m, SHORT_SKETCHES, SHORT_TOGETHER, 11)
        out[((ends[few] - SHORT_SKETCHES)[:, None] + np.arange(SHORT_SKETCHES)).ravel()] = short.ravel()
    return docs, size, out, np.concatenate([[0], ends])


class Places:
    """Where each word of a text stands, as bits of a window of it, in memory that grows with the text.

    A frequent word, of which there are few, has a bit for each place of the text; the bits of
    any other are set from the list of its places.
    """

    def __init__(self, words: list[int], width: int):
        self.width, self.full = width, (1 << width) - 1
        self.at: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            self.at.setdefault(w, []).append(i)
        self.bits: dict[int, int] = {}
        often = max(64, len(words) // 512)
        for w, places in self.at.items():
            if len(places) > often:
                raw = np.zeros(len(words), np.uint8)
                raw[places] = 1
                self.bits[w] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")

    def window(self, word: int, shift: int) -> int:
        """Bit i: whether the word stands at place shift + i."""
        bits = self.bits.get(word)
        if bits is not None:
            return (bits >> shift if shift >= 0 else bits << -shift) & self.full
        places = self.at.get(word)
        if places is None:
            return 0
        if len(places) == 1:
            i = places[0] - shift
            return 1 << i if 0 <= i < self.width else 0
        near = places[bisect_left(places, shift) : bisect_left(places, shift + self.width)]
        if len(near) < 8:
            found = 0
            for p in near:
                found |= 1 << (p - shift)
            return found
        raw = bytearray(self.width // 8 + 1)
        for p in near:
            raw[(p - shift) >> 3] |= 1 << ((p - shift) & 7)
        return int.from_bytes(raw, "little")


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is more: bit-parallel alignment in a band.

    A column of the band, 2 most + 1 cells, is two integers: where the next cell is one more,
    and where one less. It moves down its diagonal with each symbol of the shorter sequence,
    and along the last row at the end. What both begin or end with is left out first. Memory
    grows with the sequences and not with their product.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    first, last = 0, len(b)
    while first < last and a[first] == b[first]:
        first += 1
    while last > first and a[last - 1 + len(a) - len(b)] == b[last - 1]:
        last -= 1
    a, b = a[first : last + len(a) - len(b)], b[first:last]
    n, m = len(a), len(b)
    if not m:
        return n
    limit, most = most, min(most, n)
    if not most:
        return 1
    width = 2 * most + 1
    full, top, side = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    where = Places(a, width)
    more, less, distance, shift = full << (width - most - 1) & full, 0, most, most + 1 - width
    hopeless = most + m - (n - most)
    for i, x in enumerate(b):
        hit = where.window(x, shift)
        same = ((((hit & more) + more) ^ more) | hit | less) & full
        up, down = less | full & ~(same | more), same & more
        if i < n - most:
            distance += not same & top
        else:
            distance += bool(up & side) - bool(down & side)
            side >>= 1
        if distance > hopeless:
            return limit + 1
        more, less = down | full & ~(same >> 1 | up), same >> 1 & up
        shift += 1
    return distance if distance <= most else limit + 1


def alignment_similarity(a: list, b: list, least: float) -> float:
    """1 - edit distance / longer length, in words; 0 if below ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    numbers: dict = {}
    x, y = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (a, b))
    # words that the longer one has more often, whatever their order, are one edit each
    counts = np.bincount(x, minlength=len(numbers)) - np.bincount(y, minlength=len(numbers))
    if max(int(counts[counts > 0].sum()), -int(counts[counts < 0].sum())) > most:
        return 0.0
    distance = banded_distance(x, y, most)
    return 0.0 if distance > most else 1 - distance / longer if longer else 1.0


# -- on Spark ---------------------------------------------------------------------------------


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, digest, text``: a text without an id stands under its digest, below all ids of documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
    return rows.withColumn("doc", F.coalesce("doc", F.lit(NO_ID) + F.col("digest").bitwiseAND(F.lit((1 << 48) - 1))))


def sketched(rows: DataFrame) -> DataFrame:
    """``digest, doc, size, keys``: the sketches of every different text of a batch, under its first document there."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                docs, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "digest"))
                order = np.lexsort((docs, digests))
                again = np.zeros(len(docs), bool)
                again[order[1:]] = digests[order][1:] == digests[order][:-1]
                stay = np.flatnonzero(~again)
                buf, off = utf8(batch.column("text").take(pa.array(stay)))
                for a, b in groups_of(off):
                    which, size, keys, at = order_sketches(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    if len(which):
                        own = stay[a:b][which]
                        yield pa.RecordBatch.from_arrays([pa.array(digests[own]), pa.array(docs[own]), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.astype(np.int64)))], names=["digest", "doc", "size", "keys"])

    return in_arrow(rows.select("doc", "digest", "text"), run, "digest long, doc long, size int, keys array<long>")


def bucket_members(sketches: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``key, band, upper, node, size, digest``: the texts of every bucket that has several, by bands of length.

    Each text stands in its own band and, as ``upper``, in the next one down.
    """
    by_key = Window.partitionBy("key")
    rows = sketches.select(F.explode("keys").alias("key"), "digest", "doc", "size").repartition("key")
    shared = rows.withColumn("several", F.min("digest").over(by_key) < F.max("digest").over(by_key)).filter("several")
    nodes = shared.groupBy("key", "digest").agg(F.min("doc").alias("node"), F.first("size").alias("size"))
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(1.0001 * math.log(1 / least))).cast("int")
    places = F.array(F.struct(band.alias("band"), F.lit(False).alias("upper")), F.struct((band - 1).alias("band"), F.lit(True).alias("upper")))
    return nodes.select(F.explode(places).alias("p"), "key", "node", "size", "digest").select("key", "p.band", "p.upper", "node", "size", "digest")


def first_pairs(members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a, b`` with a < b: each text with the first of its bucket and band."""
    first = members.groupBy("key", "band").agg(F.min(F.struct("node", "size")).alias("head"))
    alike = F.least("size", "head.size") >= F.lit(least) * F.greatest("size", "head.size")
    return members.join(first, ["key", "band"]).filter((F.col("head.node") < F.col("node")) & alike).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()


def texts_of(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, text`` of every text that shares a bucket, as a written table."""
    spark = rows.sparkSession
    place = scratch(spark, "texts")
    wanted = members.select(F.col("node").alias("doc"), "digest").distinct()
    rows.hint("merge").join(wanted, ["doc", "digest"], "left_semi").select(F.col("doc").alias("node"), "text").dropDuplicates(["node", "text"]).write.parquet(place)
    return spark.read.schema("node long, text string").parquet(place)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose words align: ``a, b``."""

    def align(batch):
        x, y = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        near = [alignment_similarity(p.as_py().split(), q.as_py().split(), least) >= least for p, q in zip(x, y, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    # the join by b comes last, for a may be the first of very many
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return by_batch(both.select("a", "b", "text_a", "text_b"), align, "a long, b long")


@dataclass
class Member:
    """A text of an open bucket: its block, whether it is of the upper band, and the open buckets that it is in, of its own band and as an upper one."""

    node: int
    label: int
    block: int
    upper: bool
    own: list[int]
    above: list[int]
    words: list[bytes]


def _numbered(members: list[Member]) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """(the words of each as numbers, [text, counter] counts, numbers of words with their occurrence end to end, offsets)."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in m.words] for m in members]
    flat = np.fromiter((w for own in words for w in own), np.int64)
    off = np.cumsum([0, *map(len, words)])
    text = np.repeat(np.arange(len(words)), np.diff(off))
    counts = np.bincount(text * COUNTERS + flat % COUNTERS, minlength=len(words) * COUNTERS).reshape(len(words), COUNTERS).astype(np.int32)
    order = np.lexsort((flat, text))
    new = np.concatenate([[True], (np.diff(text[order]) > 0) | (np.diff(flat[order]) > 0)])
    occurrence = np.empty(len(flat), np.int64)
    occurrence[order] = np.arange(len(flat)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    _, labelled = np.unique(flat * (int(occurrence.max()) + 1) + occurrence, return_inverse=True)
    return words, counts, labelled, off


def links_of(members: list[Member], bucket: int, blocks: tuple[int, int], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that join all near texts of two blocks of a bucket, or of one with itself, that are of different classes.

    A pair is looked at in the first bucket that it shares and in which it is not two upper
    texts: those meet in their own band. Two texts are near only if they have enough words in common, whatever their order:
    counted first by counters and then one by one. Others are aligned, the most alike first,
    unless links have joined their classes by then.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    words, counts, labelled, off = _numbered(members)
    size, block, upper = np.diff(off), np.array([m.block for m in members]), np.array([m.upper for m in members])
    label, node = np.array([m.label for m in members]), np.array([m.node for m in members])
    lower: dict[int, list[int]] = {}
    uppers: dict[int, list[int]] = {}
    for i, m in enumerate(members):
        for found, buckets in ((lower, m.own), (uppers, m.above)):
            for k in buckets:
                if k < bucket:
                    found.setdefault(k, []).append(i)
    own_of, upper_of = ({k: np.array(v) for k, v in found.items()} for found in (lower, uppers))
    none = np.zeros(0, np.int64)
    own = np.zeros(int(labelled.max()) + 1 if len(labelled) else 1, bool)
    here, there = np.flatnonzero(block == blocks[0]), np.flatnonzero(block == blocks[1])
    for i in here.tolist():
        others = there[there > i] if blocks[0] == blocks[1] else there
        fits = (label[others] != label[i]) & (node[others] != node[i]) & ~(upper[others] & upper[i])
        need = least * np.maximum(size[others], size[i]) - 1e-9
        fits &= np.minimum(size[others], size[i]) >= need
        if not fits.any():
            continue
        # in an earlier bucket an own text met all others, an upper one the own ones
        met = np.zeros(len(members), bool)
        for k in members[i].own:
            met[own_of.get(k, none)] = True
            met[upper_of.get(k, none)] = True
        for k in members[i].above:
            met[own_of.get(k, none)] = True
        fits &= ~met[others]
        others, need = others[fits], need[fits]
        fits = np.minimum(counts[others], counts[i]).sum(axis=1) >= need
        others, need = others[fits], need[fits]
        if not len(others):
            continue
        own[labelled[off[i] : off[i + 1]]] = True
        at = np.concatenate([np.arange(off[k], off[k + 1]) for k in others.tolist()])
        common = np.add.reduceat(own[labelled[at]].astype(np.int64), np.cumsum(size[others]) - size[others])
        own[labelled[off[i] : off[i + 1]]] = False
        fits = common >= need
        others, common = others[fits], common[fits]
        for k in others[np.argsort(-common, kind="stable")].tolist():
            x, y = find(int(label[i])), find(int(label[k]))
            most = int((1 - least) * max(size[i], size[k]) + 1e-9)
            if x != y and banded_distance(words[i], words[k], most) <= most:
                root[max(x, y)] = min(x, y)
                yield min(members[i].node, members[k].node), max(members[i].node, members[k].node)


def with_partners(named: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``named`` that some other of their bucket and band can be near to: of another class, and long or short enough.

    Pairs of two ``upper`` texts belong to the next band. ``blocks`` is how many blocks the bucket is dealt in.
    """
    bucket = Window.partitionBy("key", "band")
    of = lambda f, c, upper: f(F.when(F.col("upper") == F.lit(upper), F.col(c))).over(bucket)
    ends = {f"{n}_{c}_{'up' if u else 'low'}": of(f, c, u) for n, f in (("min", F.min), ("max", F.max)) for c in ("label", "size") for u in (False, True)}
    differs = lambda part: (F.col(f"min_label_{part}") != F.col("label")) | (F.col(f"max_label_{part}") != F.col("label"))
    fits = F.lit(least - 1e-9)
    low = differs("low") | (differs("up") & (F.col("size") >= fits * F.col("min_size_up")))
    up = differs("low") & (F.col("max_size_low") >= fits * F.col("size"))
    size, n = F.sum(F.col("size").cast("long") * 8).over(bucket), F.count(F.lit(1)).over(bucket)
    blocks = F.greatest(F.ceil(size / F.lit(BLOCK_BYTES)), F.ceil(n / F.lit(BLOCK_TEXTS))).cast("int")
    return named.withColumns({**ends, "blocks": blocks}).filter(F.when(F.col("upper"), up).otherwise(low)).select(*named.columns, "blocks")


def open_links(members: DataFrame, labels: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a, b``: links between texts of different classes that share a bucket and a band.

    A bucket's texts are dealt out in blocks of about BLOCK_BYTES and BLOCK_TEXTS; a task
    compares two blocks. A text is fetched once, with the list of its buckets, whose number the
    sketches bound, and only then copied to them.
    """
    spark = members.sparkSession
    place = scratch(spark, "open")
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    with_partners(labelled, least).select(F.xxhash64("key", "band").alias("bucket"), "blocks", block.alias("block"), "upper", "node", "label").write.parquet(place)
    dealt = spark.read.schema("bucket long, blocks int, block int, upper boolean, node long, label long").parquet(place)
    of_band = lambda upper: F.transform(F.filter("places", lambda p: p["upper"] == F.lit(upper)), lambda p: p["bucket"])
    by_text = dealt.groupBy("node", "label").agg(F.collect_list(F.struct("bucket", "blocks", "block", "upper")).alias("places")).join(texts, "node")
    each = by_text.select("node", "label", of_band(False).alias("own"), of_band(True).alias("above"), "text", F.explode("places").alias("p")).select("p.*", "node", "label", "own", "above", "text")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    parts = each.withColumn("at", F.explode(others)).select("bucket", "at.i", "at.j", "node", "label", "block", "upper", "own", "above", "text")

    def run(batches):
        own, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != own:
                    yield from compared(own, rows)
                    own, rows = row[:3], []
                rows.append(Member(*row[3:9], row[9].encode().split()))
        yield from compared(own, rows)

    def compared(own, rows):
        if len({r.label for r in rows}) > 1:
            found = list(links_of(rows, own[0], own[1:], least))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    pair = ["bucket", "i", "j"]
    return in_arrow(parts.repartition(*pair).sortWithinPartitions(*pair, "node"), run, "a long, b long").distinct()


def linked_buckets(sketches: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): verified links ``a, b``, and the components ``node, label`` that they make.

    Two texts that share a bucket and are near always end in one component.
    """
    spark = rows.sparkSession
    place = scratch(spark, "links")
    edge = "a long, b long"
    bucket_members(sketches, least).write.parquet(f"{place}/members")
    members = spark.read.schema("key long, band int, upper boolean, node long, size int, digest long").parquet(f"{place}/members")
    texts = texts_of(members, rows)
    verified(first_pairs(members, least), texts, least).write.parquet(f"{place}/edges/k=0")
    labels = components(spark.read.schema(edge).parquet(f"{place}/edges/k=0"))
    open_links(members, labels, texts, least).write.parquet(f"{place}/edges/k=1")
    edges = spark.read.schema(edge).parquet(f"{place}/edges/k=0", f"{place}/edges/k=1").distinct()
    if spark.read.schema(edge).parquet(f"{place}/edges/k=1").isEmpty():
        return edges, labels
    return edges, components(edges)


def dealt_join(rows: DataFrame, facts: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """``rows`` joined to ``facts``, which has a row for a ``node`` at most, on ``key``; the rows of a hot key are dealt out by ``spread``.

    Hot keys are bounded by their share of ``total``; only their facts are copied, one to each part.
    """
    hot = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(HOT_SHARE * total, FEW)).select(key).collect()]
    if not hot:
        return rows.join(facts, F.col(key) == F.col("node"))
    part = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("node").isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = facts.withColumn("__at", F.explode(parts))
    return rows.withColumn("__part", part).join(copied, (F.col(key) == F.col("node")) & (F.col("__part") == F.col("__at"))).drop("__part", "__at")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component, for all nodes of ``edges`` (a, b).

    Edges are turned into stars in turns: the larger neighbours of a node that has a smaller
    one are linked to the least of those too, then each node's smaller neighbours and itself to
    the smallest of them. Edges soon are about as many as nodes; it ends when nothing
    changes, and every node is then linked to the smallest of its component. What is linked
    to one smallest node already matches in no join, and the rows of a node with very many
    neighbours are dealt out in parts. Every turn is a written table.
    """
    spark = edges.sparkSession
    place = scratch(spark, "components")
    kept, k, before = edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high > low").distinct(), 0, None
    while True:
        kept.write.parquet(f"{place}/{k}")
        kept = spark.read.schema("high long, low long").parquet(f"{place}/{k}")
        now = tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())
        if now == before:
            roots = kept.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct()
            return kept.select(F.col("high").alias("node"), F.col("low").alias("label")).unionByName(roots)
        least = kept.groupBy("high").agg(F.min("low").alias("least")).withColumnRenamed("high", "node")
        raised = dealt_join(kept, least, "low", "high", now[0]).select("high", F.col("least").alias("low"))
        kept.unionByName(raised).distinct().write.parquet(f"{place}/{k}-raised")
        large = spark.read.schema("high long, low long").parquet(f"{place}/{k}-raised")
        first = large.groupBy("high").agg(F.min("low").alias("least"), F.max("low").alias("most"))
        several = first.filter("least < most").select(F.col("high").alias("node"), "least")
        linked = dealt_join(large, several, "high", "low", now[0]).filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        kept = linked.unionByName(first.select("high", F.col("least").alias("low"))).distinct()
        before, k = now, k + 1


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, digest, class_id, n_links, n_copies`` of every document.

    ``class_id`` is the smallest document of the class: documents joined by equal texts or by
    verified links. ``n_links``: verified links of the text to other texts, of the pairs that
    were aligned; ``n_copies``: rows with the very same text. A link's texts are at least ``least`` alike by alignment of words.

    Null and empty texts are copies of each other and near nothing else. A null id gives way
    to a negative number made from the text. Rows of one id are one document and share a
    class. Repeated rows count as copies. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    rows = identified(docs, id_col, text_col)
    place = scratch(spark, "classes")
    edges, labels = linked_buckets(sketched(rows), rows, least)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    linked = labels.join(degree, "node")
    ids = rows.select("doc", "digest")
    ids.groupBy("digest").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").write.parquet(f"{place}/copies")
    copies = spark.read.schema("digest long, node long, copies long").parquet(f"{place}/copies")
    # texts of a large share of all rows, of which there are few, are joined in HOT_PARTS parts
    hot = [r[0] for r in copies.filter(F.col("copies") >= HOT_SHARE * docs.count()).select("digest").collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    of_copies = copies.join(linked, "node", "left").select("digest", F.col("node").alias("copy_node"), "copies", F.col("label").alias("copy_label"), F.col("links").alias("copy_links"), F.explode(parts).alias("part"))
    dealt = ids.withColumn("part", F.when(is_hot, F.pmod(F.xxhash64("doc"), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0)))
    # a document alone with its text has its own label; copies have that of their first
    found = dealt.join(of_copies, ["digest", "part"], "left").join(linked.withColumnRenamed("node", "doc"), "doc", "left")
    alone = F.col("copy_node").isNull()
    label = F.when(alone, F.coalesce("label", "doc")).otherwise(F.coalesce("copy_label", "copy_node"))
    links = F.when(alone, F.col("links")).otherwise(F.col("copy_links"))
    return found.select("doc", "digest", label.alias("class_id"), F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: of each class its smallest document, once."""
    found = near_duplicates(docs, least, id_col, text_col)
    stay = found.filter(F.col("doc") == F.col("class_id")).groupBy("class_id").agg(F.min("digest").alias("digest")).select(F.col("class_id").alias("doc"), "digest")
    plain, (own_id, own_text) = by_place(docs, id_col, text_col)
    marked = plain.withColumn("digest", F.xxhash64(F.coalesce(F.col(own_text).cast("string"), F.lit("")))).withColumn("doc", F.coalesce(F.col(own_id).cast("long"), F.lit(NO_ID) + F.col("digest").bitwiseAND(F.lit((1 << 48) - 1))))
    once = Window.partitionBy("doc", "digest").orderBy("doc")
    return marked.join(stay, ["doc", "digest"]).withColumn("n", F.row_number().over(once)).filter("n = 1").drop("doc", "digest", "n").toDF(*docs.columns)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document; ``kept``: whether it is the one of its class that stays."""
    found = near_duplicates(table(ready(spark), sf_dir, "documents"))
    return found.select(F.when(F.col("doc") >= NO_ID + (1 << 48), F.col("doc")).alias("doc_id"), "class_id", "n_links", "n_copies", (F.col("doc") == F.col("class_id")).alias("kept"))
