"""Suffix-array deduplication: longest previous factors from the order of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, covered, ready, table
from .repeats import Group, Symbols, marked, marks

LENGTH = 100
#: Bytes of an anchor. Each string of LENGTH bytes holds one; longer anchors repeat less by chance and are denser.
GRAM = 24

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, cut after ``length`` bytes, and what each shares with the one before it.

    Suffixes of another group share nothing. Equal ones stay in the order of their places.
    """
    words = -(-length // 8)
    wide = np.zeros((len(starts), 8 * words), np.uint8)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    wide[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[starts]
    columns = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], group))
    sorted_ = columns[order]
    differs = sorted_[1:] != sorted_[:-1]
    word = np.where(differs.any(axis=1), differs.argmax(axis=1), words)
    rows = np.arange(1, len(order))
    bytes_ = wide[order].reshape(len(order), words, 8)
    inside = np.minimum(word, words - 1)
    unequal = bytes_[rows, inside] != bytes_[rows - 1, inside]
    shared = np.where(word == words, length, np.minimum(8 * word + unequal.argmax(axis=1), length))
    shared[group[order][1:] != group[order][:-1]] = 0
    return order, np.concatenate([[0], shared])


def _smaller_before(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each suffix shares with the nearest one before it, in suffix order, that has a smaller place; else 0."""
    n = len(place)
    at = np.arange(n) - 1
    least = shared.copy()
    todo = np.flatnonzero(at >= 0)
    todo = todo[place[at[todo]] >= place[todo]]
    while len(todo):  # skip, with the places in between, to where that one points
        over = at[todo]
        least[todo] = np.minimum(least[todo], least[over])
        at[todo] = at[over]
        todo = todo[at[todo] >= 0]
        todo = todo[place[at[todo]] >= place[todo]]
    return np.where(at >= 0, least, 0)


def longest_shared(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For suffixes in their order: the most that each shares with one of a smaller place.

    ``shared`` is what each shares with the one before it. The nearest of smaller place before
    and after share the most.
    """
    before = _smaller_before(place, shared)
    # the same from the other end: what a suffix shares with the next is what the next shares with it
    after = _smaller_before(place[::-1].copy(), np.concatenate([[0], shared[1:][::-1]]))[::-1]
    return np.maximum(before, after)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, the longest prefix, of ``length`` at most, that an earlier suffix of its group has too."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order, shared = suffix_order(data, starts, group, length)
    out = np.empty(len(starts), np.int64)
    out[order] = longest_shared(order, shared)
    return out


def earlier_strings(length: int = LENGTH):
    """For settle(): runs of strings whose longest previous factor is the whole string."""

    def covered_runs(found: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = found.stretches
        data = np.frombuffer(b"".join(found.payloads), np.uint8)
        begin = np.cumsum([0, *map(len, found.payloads[:-1])])
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.flatnonzero(longest_previous_factors(data, begin[row] + step, found.key[row], length) >= length)
        if not len(at):
            return at, at, at
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)]))
        last = np.concatenate([new[1:] - 1, [len(at) - 1]])
        return row[at[new]], step[at[new]], at[last] - at[new] + length

    return covered_runs


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, fold: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary, if asked for) of every row.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document of
    smaller id, or before in the same one. The first copy stays. A null text is empty; a null
    id stands before all others. Rows with one id and one text are one document and get the
    same result; rows with one id and different texts come in the order of their checksums.
    Strings are judged on the input. Matches are cut at bytes, so kept bytes may not be UTF-8.
    An empty table gives no rows; other columns are not read. ``fold`` is that of ``marked``.
    """
    kind = Symbols("bytes", length, gram, False)
    rows = marked(docs, kind, earlier_strings(length), id_col, text_col, fold)

    def one(batch):
        out = []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            raw = text.as_py()
            start, end = marks(batch, i)
            if len(start):
                gone = covered(start, end, len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            else:
                kept, runs = raw, 0
            out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else [])]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["kept"] * keep_text
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return by_batch(rows, one, SCHEMA + ", kept binary" * keep_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_strings(table(ready(spark), sf_dir, "documents"))
