"""Substring deduplication by seed and extend, over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, covered, find_words, mixed, ready, span_hashes, table, word_prefix, word_spans
from .repeats import Group, Symbols, marked, marks
from .suffixes import longest_shared

LENGTH = 50
#: Words of a seed. Each window of LENGTH words holds one.
GRAM = 8

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def maximal_repeats(length: int = LENGTH):
    """For settle(): seeds extended both ways, and the maximal repeats of ``length`` words at least.

    A context is a seed with the words around it. For each number of words to its left, the
    contexts of the seed that share those words are put in the order of what follows from the
    seed on; of the contexts of documents with a smaller id, the nearest before or after then
    shares the longest extension to the right. An extension is maximal if none that goes
    further left reaches as far right. Words are compared one by one, to the context's ends,
    beyond which neighbouring seeds go on.
    """

    def covered_runs(found: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"\n".join(found.payloads), np.uint8)
        cuts = np.cumsum([0, *(len(p) + 1 for p in found.payloads)])
        start, end, first = find_words(buf, np.minimum(cuts, len(buf)))
        hashes = span_hashes(buf, start, end)
        _, word = np.unique(hashes, return_inverse=True)
        seed = first[:-1] + found.reach
        size = first[1:] - seed
        # what follows from the seed on, a row a context, 0 beyond its end
        place = seed[:, None] + np.arange(length)
        right = np.where(np.arange(length) < size[:, None], word[np.minimum(place, len(word) - 1)] + 1, 0)
        rank = np.empty(len(seed), np.int64)
        rank[np.lexsort(right.T[::-1])] = np.arange(len(seed))
        # a row for each context and number of words to the left
        row = np.repeat(np.arange(len(seed)), found.stretches)
        step = np.arange(len(row)) - np.repeat(np.cumsum(found.stretches) - found.stretches, found.stretches)
        left = found.reach[row] - step
        prefix = word_prefix(hashes)
        own = mixed(word_spans(prefix, seed[row] - left, seed[row]) ^ mixed(found.key[row].astype(np.uint64) * np.uint64(length) + left.astype(np.uint64)))
        order = np.lexsort((rank[row], own))
        r = row[order]
        shared = np.zeros(len(r), np.int64)
        for a in range(1, len(r), 1 << 16):
            b = min(len(r), a + (1 << 16))
            differs = right[r[a:b]] != right[r[a - 1 : b - 1]]
            until = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
            until = np.minimum(until, np.minimum(size[r[a:b]], size[r[a - 1 : b - 1]]))
            shared[a:b] = np.where(own[order[a:b]] == own[order[a - 1 : b - 1]], until, 0)
        longest = np.empty(len(r), np.int64)
        longest[order] = longest_shared(found.doc[r], shared)
        # of a context's extensions, in the order of their begins: those that reach further than all before
        reach = np.where(left + longest >= length, longest, 0)
        top = np.maximum.accumulate(reach + row * (length + 1)) - row * (length + 1)
        before = np.where(step > 0, np.concatenate([[0], top[:-1]]), 0)
        at = np.flatnonzero(reach > before)
        return row[at], step[at], (left + longest)[at]

    return covered_runs


def drop_repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, fold: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the kept words, if asked for) of every row.

    A word goes if a window of ``length`` words over it also starts in a document with a
    smaller id. Repeats within a document, or among rows of one id, stay. A null text has no
    words; a null id stands before all others. Windows are judged on the input. An empty
    table gives no rows; other columns are not read. ``fold`` is that of ``marked``.
    """
    kind = Symbols("words", length, gram, True)
    rows = marked(docs, kind, maximal_repeats(length), id_col, text_col, fold)

    def one(batch):
        out = []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            words = text.as_py().split()  # cuts bytes at the six ASCII characters
            start, end = marks(batch, i)
            n = len(words)
            if len(start):
                words = [w for w, gone in zip(words, covered(start, end, n).tolist(), strict=True) if not gone]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else [])]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["kept"] * keep_text
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return by_batch(rows, one, SCHEMA + ", kept string" * keep_text)


def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_windows(table(ready(spark), sf_dir, "documents"))
