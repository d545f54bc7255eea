"""Packing token sequences: a configuration linear program over the histogram of lengths."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_rows, in_arrow, ready, scratch, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Chunks, and parts of chunks, whose ids a worker keeps.
CACHED = 400_000
#: The program is solved to this gap between its value and a dual bound, or in so many rounds, or until so many have brought neither a better value nor a better bound.
GAP, ROUNDS, PATIENCE = 0.005, 40, 8
#: Steps of the weights: for what a round leaves behind, and for what the best pattern with a length lacks; what patterns may lack.
STEP, ASCENT, NEAR_BEST = 0.01, 0.5, 0.003
#: How far a round covers lengths ahead, in rounds: as a rule, and where nothing else fills a pattern.
AHEAD, FAR_AHEAD = 0.05, 2.0
BUCKETS = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# -- tokens -----------------------------------------------------------------------------------


# Fixed values of the tokenizer: what it does to chunks of printable Latin-1 without apostrophes,
# which its normaliser only folds to lower case. All other chunks go through it whole.
PLAIN = re.compile(r"[!-&(-~\xa1-\xac\xae-\xff]+")
PARTS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


BYTE_LETTERS = _byte_letters()


class Encoder(dict):
    """Token ids of whole texts, by white-space separated chunks that are looked up.

    The tokenizer drops white space and looks at nothing across it, so a text's ids are those
    of its chunks, end to end. A missing plain chunk is cut here and goes to the tokenizer's
    model, any other to the tokenizer; the first chunks met, among them all frequent ones, are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join([self._part(p) for p in PARTS.findall(text.lower())])
        else:
            found = array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHED:
            self[chunk] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.parts) < CACHED:
                self.parts[part] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers. bytes.split() cuts at ASCII white space, which the tokenizer drops."""
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and an end id, cut only where longer than ``capacity``."""
    ready(docs.sparkSession)
    name = path

    def run(batches):
        import public_tokenizers

        encoder = _encoder(name or public_tokenizers.path(TOKENIZER))
        end = np.array([end_id], np.uint32).tobytes()
        width = 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                raw = encoder.encode(text.as_py()) + end
                for k in range(0, len(raw), width):
                    part = raw[k : k + width]
                    rows.append((doc, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(doc_rows(docs, id_col, text_col), run, PIECES)


# -- the linear program -----------------------------------------------------------------------


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The best value of a pattern for each room: knapsack by dynamic programming, any number of each length."""
    best = np.zeros(capacity + 1)
    for length, worth in zip(lengths[::-1].tolist(), value[::-1].tolist(), strict=True):
        if 2 * length > capacity:
            np.maximum(best[length:], best[: capacity + 1 - length] + worth, out=best[length:])
        else:  # rooms of one remainder as columns: a length is taken again from row to row
            rows = -(-(capacity + 1) // length)
            table = np.full(rows * length, -1.0)
            table[: capacity + 1] = best
            paid = worth * np.arange(rows)[:, None]
            best = (np.maximum.accumulate(table.reshape(rows, length) - paid, axis=0) + paid).ravel()[: capacity + 1]
    return best


@dataclass
class Cover:
    """A solution of the configuration program: numbers of patterns that cover every count, their sum, and a bound on any such sum.

    ``mean`` is the best cover that the rounds themselves came to, if there were any.
    """

    patterns: dict[tuple[tuple[int, int], ...], float]
    value: float
    bound: float
    rounds: int
    mean: dict[tuple[tuple[int, int], ...], float]


def _key(pattern: dict[int, int]) -> tuple[tuple[int, int], ...]:
    return tuple(sorted(pattern.items()))


def first_cover(counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """The patterns that the program begins with: those of best fit, as often as it uses them."""
    out: dict[tuple[tuple[int, int], ...], float] = {}
    for pattern, n in best_fit(counts, capacity):
        out[_key(pattern)] = out.get(_key(pattern), 0.0) + n
    return out


def fractional_cover(counts: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> Cover:
    """The configuration program by multiplicative weights: the fewest patterns, in fractions, that hold all counts.

    The program begins with the patterns of best fit, a cover whose value may be far from the
    bound or at it. Each length has a weight, at first its share of the capacity. A round prices all patterns
    by one knapsack over the weights. The counts, divided by the best price, are a bound: no
    solution is less. Then the round covers every count once more, with patterns that hold a
    length not yet covered and are filled at nearly the best price, by the lengths least
    covered so far. What it covers ahead is not covered in the next round, so that the mean of
    the rounds, a cover itself, gets better. Weights are multiplied up for lengths that no
    round's patterns fill up by themselves, and for those whose best pattern is below the best
    price, which raises the bound. It ends when value and bound are within ``gap``, or
    after ``rounds``, or PATIENCE of them without a better value or bound; the solution says how far they are apart.
    """
    lengths = np.flatnonzero(counts[: capacity + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return Cover({}, 0.0, 0.0, 0, {})
    need = counts[lengths].astype(float)
    log, covered = np.zeros(len(lengths)), np.zeros(len(lengths))
    found: dict[tuple[tuple[int, int], ...], float] = {}
    start = first_cover(counts, capacity)
    mass, bound, least, moved = 0.0, 0.0, np.inf, 0
    best_cover = Cover(start, float(sum(start.values())), 0.0, 0, {})
    for t in range(1, rounds + 1):
        weight = lengths / capacity * np.exp(log)
        best = _price(lengths, weight, capacity)
        top = best[capacity]
        now = float((need * weight).sum() / top)
        if now > bound * 1.0001:
            moved = t
        bound = best_cover.bound = max(bound, now)
        if best_cover.value <= (1 + gap) * bound:
            break
        behind = covered.copy()
        for i in range(len(lengths) - 1, -1, -1):
            behind[i] = covered[i]
            while covered[i] < t - 1e-9:
                pattern = _filled(i, lengths, weight, best, covered, t, NEAR_BEST * top)
                much = min([(t - covered[i]) * need[i] / pattern[i], *((max(t + AHEAD, covered[j] + AHEAD) - covered[j]) * need[j] / m for j, m in pattern.items() if j != i)])
                key = tuple(sorted((int(lengths[j]), m) for j, m in pattern.items()))
                found[key] = found.get(key, 0.0) + much
                mass += much
                for j, m in pattern.items():
                    covered[j] += m * much / need[j]
        value = mass / covered.min()
        if value < least:
            least, best_cover.rounds, moved = value, t, t
            best_cover.mean = {p: x / covered.min() for p, x in found.items()}
        if value < best_cover.value:
            best_cover.patterns, best_cover.value = best_cover.mean, value
        if best_cover.value <= (1 + gap) * bound or t - moved >= PATIENCE:
            break
        log += STEP * np.clip(t - behind, -1, 1) + ASCENT * np.minimum((top - weight - best[capacity - lengths]) / weight, 1)
    return best_cover


def _filled(first: int, lengths: np.ndarray, weight: np.ndarray, best: np.ndarray, covered: np.ndarray, t: int, slack: float) -> dict[int, int]:
    """A pattern with ``first`` that lacks ``slack`` of the best price at most, or as little as can be; the least covered lengths first."""
    pattern, room = {first: 1}, len(best) - 1 - int(lengths[first])
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        lacks = best[room] - (weight[:k] + best[room - lengths[:k]])
        for most in (t + AHEAD, t + FAR_AHEAD):
            open_ = covered[:k] < most - 1e-9
            wanted = np.where(open_ & (lacks <= slack), covered[:k], np.inf)
            j = int(wanted.argmin())
            if wanted[j] < np.inf:
                break
        else:
            wanted = np.where(covered[:k] < t + AHEAD - 1e-9, lacks, np.inf)
            j = int(wanted.argmin())
            if wanted[j] == np.inf:
                break
        slack = max(slack - max(float(lacks[j]), 0.0), 0.0)
        pattern[j] = pattern.get(j, 0) + 1
        room -= int(lengths[j])
    return pattern


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best fit, largest first, over counts: (pattern, number). Equal steps are taken together."""
    left = counts[: capacity + 1].astype(np.int64).copy()
    out = []
    for length in range(capacity, 0, -1):
        while left[length]:
            pattern, room = {length: 1}, capacity - length
            while room > 0:
                free = left[1 : room + 1].copy()
                for x, m in pattern.items():
                    if x <= room:
                        free[x - 1] -= m
                fits = np.flatnonzero(free > 0)
                if not len(fits):
                    break
                nxt = int(fits[-1]) + 1
                pattern[nxt] = pattern.get(nxt, 0) + 1
                room -= nxt
            n = min(int(left[x]) // m for x, m in pattern.items())
            for x, m in pattern.items():
                left[x] -= n * m
            out.append((pattern, n))
    return out


def rounded(patterns: dict[tuple[tuple[int, int], ...], float], counts: np.ndarray, share: float, up: float, least: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole numbers of patterns that hold no more than the counts, and what they leave: the largest first.

    ``share`` of each number is taken, all that fit if it is infinite; a fraction of ``up`` or more counts as one. Patterns
    without a piece of ``least`` tokens are left out.
    """
    left, out = counts.astype(np.int64).copy(), []
    for pattern, x in sorted(patterns.items(), key=lambda p: (-p[1], p[0])):
        n = min(int(min(share * x, 1e15) + 1 - up + 1e-9), *(int(left[length]) // m for length, m in pattern))
        if n > 0 and pattern[-1][0] >= least:
            for length, m in pattern:
                left[length] -= n * m
            out.append((dict(pattern), n))
    return out, left


@dataclass
class Packing:
    """Patterns and numbers that hold every piece once; how many sequences the program gave; its value and bound."""

    patterns: list[tuple[dict[int, int], int]]
    sequences: int
    from_program: int
    value: float
    bound: float


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> Packing:
    """The program's solution in whole sequences, and what rounding leaves by best fit.

    Rounding loses where short pieces are spent on each other that long ones will need. So
    several shares of what the rounds came to are taken, with all patterns and with those only that hold
    a long piece, beside the whole parts of the best cover; the fewest sequences win, and of equals those with most from the program.
    """
    cover = fractional_cover(counts, capacity)
    best: Packing | None = None
    ways = [(s, u, x) for s in (1.0, np.inf, 0.5) for u in (1.0, 0.5) for x in (1, capacity // 2)]
    for patterns, (share, up, least) in [(cover.patterns, ways[0]), *((cover.mean, way) for way in ways if cover.mean)]:
        out, left = rounded(patterns, counts, share, up, least)
        own = sum(n for _, n in out)
        out += best_fit(left, capacity)
        total = sum(n for _, n in out)
        if best is None or (total, -own) < (best.sequences, -best.from_program):
            best = Packing(out, total, own, cover.value, cover.bound)
    return best


# -- on Spark ---------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in sequences of at most ``capacity``.

    Only the histogram of lengths, at most ``capacity`` rows at any scale, comes to the driver.
    A piece's rank among those of its length is a running count over hash buckets and then
    within one, so that a frequent length is spread over tasks; the rank finds the piece's
    sequence in the solution, whose rows are bounded by the patterns and don't grow with the pieces.
    """
    spark = pieces.sparkSession
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_buckets(pieces))).cast("int"))
    sizes = bucketed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "__bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    rows, first = [], 0
    begun: dict[int, int] = {}
    for pattern, n in solve(counts, capacity).patterns:
        at = 0
        for length, m in sorted(pattern.items(), reverse=True):
            rows.append((length, begun.get(length, 0), n * m, m, first, at))
            begun[length] = begun.get(length, 0) + n * m
            at += length * m
        first += n
    # each length's slots, dealt by ranks into as many cells as there are slots, so that a rank looks at those of its cell only; patterns, and so slots, are bounded by lengths and rounds
    by_length = spark.createDataFrame(slot_cells(rows), "__length long, __step long, __cells array<array<struct<__from:long,__n:long,__m:long,__first:long,__at:long>>>")
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = bucketed.withColumn("__rank", F.row_number().over(within) - 1).join(sizes, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("before"))
    found = ranked.join(F.broadcast(by_length), F.col("length") == F.col("__length")).withColumn("__slot", F.filter(F.get("__cells", F.floor(F.col("__rank") / F.col("__step")).cast("int")), lambda s: (s["__from"] <= F.col("__rank")) & (F.col("__rank") < s["__from"] + s["__n"]))[0])
    place = F.col("__rank") - F.col("__slot.__from")
    return found.select(*[F.col(c) for c in pieces.columns], (F.col("__slot.__first") + F.floor(place / F.col("__slot.__m"))).cast("long").alias("sequence_id"), (F.col("__slot.__at") + F.pmod(place, F.col("__slot.__m")) * F.col("length")).cast("long").alias("offset"))


def slot_cells(rows: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, list[list[tuple]]]]:
    """``(length, step, cells)`` from slots ``(length, from, n, m, first, at)``: cell k has the slots with a rank from k * step to before (k + 1) * step."""
    by_length: dict[int, list[tuple]] = {}
    for length, *slot in rows:
        by_length.setdefault(length, []).append(tuple(slot))
    out = []
    for length, slots in by_length.items():
        ranks = max(begin + n for begin, n, *_ in slots)
        step = -(-ranks // len(slots))
        cells: list[list[tuple]] = [[] for _ in range(-(-ranks // step))]
        for slot in slots:
            for k in range(slot[0] // step, (slot[0] + slot[1] - 1) // step + 1):
                cells[k].append(slot)
        out.append((length, step, cells))
    return out


def _buckets(pieces: DataFrame) -> int:
    """Hash buckets for ranks: as many as the shuffle has partitions, BUCKETS at least."""
    return max(BUCKETS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come;
    equal pieces are interchangeable, so which of them stands first doesn't matter. Null ids
    are kept. An empty table gives no rows. The pieces are written to the shared folder once,
    for texts to be encoded once only; a written table outlives executors.
    """
    spark = ready(docs.sparkSession)
    at = scratch(spark, "pieces")
    token_pieces(docs, path, capacity, end_id, id_col, text_col).write.parquet(at)
    return pack(spark.read.schema(PIECES).parquet(at), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
