"""Language identification: unigram pieces of a fixed vocabulary, all segmentations summed."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, in_arrow, mixed, powers, prefix_hash, ready, table

VOCABULARY = "piece_bpe_32k.model"
BEGIN = "▁"
#: Letters, mark included, of words that are scored many at a time; longer ones go one by one. The fit cuts longer ones.
BLOCK = 32
#: Different words whose scores a worker keeps.
KEPT = 400_000
#: The bounded sample that the pieces' probabilities are fitted on: rows per language.
SAMPLE = 400
#: Rounds of expectation and maximisation, what is added to each expected count, and the
#: probability of a character that no piece covers.
ROUNDS, ADDED, UNKNOWN = 3, 0.05, 1e-7
UNDECIDED = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_MULTIPLIER = 0xC2B2AE3D27D4EB4F


# -- pieces -----------------------------------------------------------------------------------


class Pieces:
    """Pieces by hash, in the order of their hashes; ``longest`` is the number of characters of the longest."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([int(code_hashes(codes(p), np.array([0]), np.array([len(p)]))[0]) for p in pieces], np.uint64)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, or ``size``."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], np.int32(self.size))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def code_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    with np.errstate(over="ignore"):
        if prefix is None:
            prefix = prefix_hash(mixed(points.astype(np.uint64) + np.uint64(1)), _MULTIPLIER)
        return mixed((prefix[end] - prefix[start]) * powers(len(prefix), _MULTIPLIER)[1][start] + (end - start).astype(np.uint64))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Pieces:
    """The pieces of letters, in lower case, of the vocabulary file; those that begin a word keep their mark."""
    import public_tokenizers
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = {tool.id_to_piece(i).lower() for i in range(tool.get_piece_size()) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i))}
    return Pieces(sorted(p for p in found if p.lstrip(BEGIN).isalpha() and BEGIN not in p[1:]))


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def blocks_of(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts words longer than BLOCK: (start, end, word) of each block."""
    n = np.maximum(1, -(-(end - start) // BLOCK))
    word = np.repeat(words, n)
    step = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(start, n) + BLOCK * step
    return s, np.minimum(s + BLOCK, np.repeat(end, n)), word


def lattice(pieces: Pieces, points: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(length of each word, piece at each [word, place, piece length - 1])."""
    length = end - start
    widest = int(length.max())
    if prefix is None:
        prefix = prefix_hash(mixed(points.astype(np.uint64) + np.uint64(1)), _MULTIPLIER)
    found = np.full((len(start), widest, min(pieces.longest, widest)), pieces.size, np.int32)
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    for k in range(1, found.shape[2] + 1):
        fits = np.flatnonzero(place + k <= length[word])
        at = start[word[fits]] + place[fits]
        found[word[fits], place[fits], k - 1] = pieces.find(code_hashes(points, at, at + k, prefix))
    return length, found


def forward(length: np.ndarray, found: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """[place, word, language]: the summed probability of all segmentations up to each place. chances has a last row of 0."""
    n, widest, longest = found.shape
    alpha = np.zeros((widest + 1, n, chances.shape[1]))
    alpha[0] = 1
    for j in range(1, widest + 1):
        live = np.flatnonzero(length >= j)
        total = alpha[j - 1][live] * UNKNOWN
        for k in range(1, min(longest, j) + 1):
            piece = found[live, j - k, k - 1]
            some = np.flatnonzero(piece < len(chances) - 1)
            if len(some):
                total[some] += alpha[j - k][live[some]] * chances[piece[some]]
        alpha[j][live] = total
    return alpha


def forward_long(pieces: Pieces, points: np.ndarray, chances: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """[language]: log of the summed probability of one word of any length.

    Only as many columns as the longest piece has characters are held; they are scaled at
    every place, and the scales' logs summed.
    """
    longest, n = pieces.longest, len(points)
    prefix = prefix_hash(mixed(points.astype(np.uint64) + np.uint64(1)), _MULTIPLIER)
    last = np.zeros((longest, chances.shape[1]))  # last[k - 1]: the sum up to k places back
    last[0] = 1
    logs = np.zeros(chances.shape[1])
    lengths = np.arange(1, longest + 1)
    for a in range(1, n + 1, at_once):
        ends = np.arange(a, min(a + at_once, n + 1))
        begins = ends[:, None] - lengths
        inside = begins >= 0
        hashes = code_hashes(points, np.maximum(begins, 0).ravel(), np.repeat(ends, longest), prefix).reshape(begins.shape)
        step = chances[np.where(inside, pieces.find(hashes.ravel()).reshape(begins.shape), pieces.size)]
        step[:, 0] += UNKNOWN
        for one in step:
            total = (last * one).sum(axis=0)
            logs += np.log(total)
            last[1:] = last[:-1] / total
            last[0] = 1
    return logs


def log_chances(pieces: Pieces, points: np.ndarray, start: np.ndarray, end: np.ndarray, chances: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """[word, language]: log of the summed probability of each word."""
    out = np.zeros((len(start), chances.shape[1]))
    size = end - start
    for i in np.flatnonzero(size > BLOCK).tolist():
        out[i] = forward_long(pieces, points[start[i] : end[i]], chances)
    order = np.argsort(size, kind="stable")[: int((size <= BLOCK).sum())]
    prefix = prefix_hash(mixed(points.astype(np.uint64) + np.uint64(1)), _MULTIPLIER) if len(order) else None
    for a in range(0, len(order), at_once):
        o = order[a : a + at_once]
        length, found = lattice(pieces, points, start[o], end[o], prefix)
        out[o] = np.log(forward(length, found, chances)[length, np.arange(len(o))])
    return out


# -- the model --------------------------------------------------------------------------------


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[piece, language] probabilities, and a last row of 0, by expectation and maximisation over ``counts`` [word, language].

    Words of over BLOCK letters are fitted in blocks; they are scored whole.
    """
    marked = [BEGIN + w for w in words]
    points = codes("".join(marked))
    end = np.cumsum([len(w) for w in marked])
    start = end - [len(w) for w in marked]
    s, e, word = blocks_of(np.arange(len(words)), start, end)
    n_langs = counts.shape[1]
    chances = np.full((pieces.size + 1, n_langs), 1 / pieces.size)
    chances[-1] = 0
    for _ in range(rounds):
        expected = np.zeros((pieces.size + 1, n_langs))
        for a in range(0, len(s), 8192):
            length, found = lattice(pieces, points, s[a : a + 8192], e[a : a + 8192])
            own = counts[word[a : a + 8192]]
            alpha = forward(length, found, chances)
            n, widest, longest = found.shape
            beta = np.zeros_like(alpha)
            beta[length, np.arange(n)] = 1
            for j in range(widest - 1, -1, -1):
                live = np.flatnonzero(length > j)
                total = beta[j + 1][live] * UNKNOWN
                for k in range(1, min(longest, widest - j) + 1):
                    total += beta[j + k][live] * chances[found[live, j, k - 1]]
                beta[j][live] = total
            whole = alpha[length, np.arange(n)]
            for j in range(widest):
                for k in range(1, min(longest, widest - j) + 1):
                    live = np.flatnonzero(found[:, j, k - 1] < pieces.size)
                    if len(live):
                        piece = found[live, j, k - 1]
                        share = alpha[j][live] * chances[piece] * beta[j + k][live] / whole[live] * own[live]
                        for lang in range(n_langs):
                            expected[:, lang] += np.bincount(piece, share[:, lang], pieces.size + 1)
        expected[:-1] += ADDED
        chances = expected / expected[:-1].sum(axis=0)
        chances[-1] = 0
    return chances


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, path: str | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, probabilities) from ``sample`` rows of each language, picked by a hash of their id and text.

    Only rows outside the held-out third with a language and a text are picked: of each
    language those of smallest draw. A row without an id is not held out and is drawn by its
    text; rows of one id and text count once. A language's rows are counted first, so that
    some four times the sample, and not all of them, meet to be ranked. The driver gets a count
    a language, of which there are to be some hundreds at most, and the words of the picked
    rows, counted. Nothing is learned from an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return [], np.zeros((1, 0))
    # a row's draw in [0, 1); per language, draws below some four times the wanted share hold the smallest ones
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, 4 * sample / n))])[F.col("lang")]
    few = rows.withColumn("draw", draw).filter(F.col("draw") < share + F.lit(1e-12)).dropDuplicates(["lang", "draw"])
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("n") <= sample)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count().collect()
    langs = sorted({r["lang"] for r in words})
    index = {w: i for i, w in enumerate(sorted({r["word"] for r in words}))}
    counts = np.zeros((len(index), len(langs)))
    for lang, word, n in words:
        counts[index[word], langs.index(lang)] = n
    if not langs:
        return [], np.zeros((1, 0))
    with np.errstate(over="ignore"):
        return langs, fit(vocabulary(path), list(index), counts)


class Scores:
    """Log probabilities of the words that a worker has met, by hash: the first KEPT of them, among them all frequent ones."""

    def __init__(self, n_langs: int):
        self.hashes, self.logs = np.zeros(0, np.uint64), np.zeros((0, n_langs))

    def get(self, hashes: np.ndarray, score) -> np.ndarray:
        """[word, language] for ascending hashes; ``score(missing)`` makes the rows of those not kept."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), self.logs.shape[1]))
        out[known] = self.logs[at[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            out[missing] = score(missing)
            new = missing[: KEPT - len(self.hashes)]
            if len(new):
                every = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(every, kind="stable")
                self.hashes, self.logs = every[order], np.concatenate([self.logs, out[new]])[order]
        return out


def score_texts(pieces: Pieces, chances: np.ndarray, texts: list[str], kept: Scores | None = None) -> tuple[np.ndarray, np.ndarray]:
    """([text, language] log probabilities, whether a text has a letter)."""
    kept = Scores(chances.shape[1]) if kept is None else kept
    lowered = [t.lower() for t in texts]
    points = codes("\n".join(lowered) + "\n")
    ends = np.cumsum([len(t) + 1 for t in lowered])
    solid = _is_letter()[points]
    edge = np.diff(np.concatenate([[False], solid]).astype(np.int8))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    total = np.zeros((len(texts), chances.shape[1]))
    if not len(start):
        return total, np.zeros(len(texts), bool)
    prefix = prefix_hash(mixed(points.astype(np.uint64) + np.uint64(1)), _MULTIPLIER)
    hashes, first, inverse = np.unique(code_hashes(points, start, end, prefix), return_index=True, return_inverse=True)

    def score(missing: np.ndarray) -> np.ndarray:
        # each with the mark of a word's begin before it: its own place or a blank one
        begin, size = start[first[missing]], (end - start)[first[missing]] + 1
        to = np.cumsum(size)
        own = np.full(int(to[-1]), ord(BEGIN), np.uint32)
        inside = np.ones(len(own), bool)
        inside[to - size] = False
        own[inside] = points[np.repeat(begin, size - 1) + np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)]
        return log_chances(pieces, own, to - size, to, chances)

    logs = kept.get(hashes, score)
    doc = np.searchsorted(ends, start, "right")
    for lang in range(chances.shape[1]):
        total[:, lang] = np.bincount(doc, logs[inverse, lang], len(texts))
    return total, np.bincount(doc, minlength=len(texts)) > 0


def identify(docs: DataFrame, langs: list[str], chances: np.ndarray, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; score: the language's share of the summed probabilities.

    A null text, one without letters, or any text where nothing was learned, is ``und`` with
    score 0. Rows are judged alone on their text only: repeats, ties and null ids (not held
    out) need no care. A long text is scored whole. An empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast((langs, chances))

    def run(batches):
        kept = Scores(len(langs))
        for batch in batches:
            yield one(batch, kept)

    def one(batch, kept):
        langs, chances = shared.value
        names, scores = [], []
        texts = batch.column("text").to_pylist()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size < 4 * SLICE or last == first):
                size += len(texts[last])
                last += 1
            if not langs:
                names += [UNDECIDED] * (last - first)
                scores += [0.0] * (last - first)
            else:
                total, any_ = score_texts(vocabulary(path), chances, texts[first:last], kept)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names += [langs[b] if x else UNDECIDED for b, x in zip(best.tolist(), any_.tolist(), strict=True)]
                scores += np.where(any_, share, 0.0).tolist()
            first = last
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    return in_arrow(rows, run, SCHEMA)


def op7_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return identify(docs, *learn(docs))
