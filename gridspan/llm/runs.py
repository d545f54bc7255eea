"""Periodic runs of words: every stretch that repeats a shorter one several times over, as long as it can be.

Kolpakov and Kucherov's way: the text is cut into factors, each the longest stretch that also
starts earlier, found with a suffix automaton. A run that begins before a factor and ends in it
is found by Main's algorithm around the factor's first word; one that lies within a factor is
copied from the factor's earlier occurrence.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, by_batch, covered, doc_rows, find_words, groups_of, per_doc, ready, table, utf8

#: A run has at least so many words, and its period at least so often.
WORDS, TIMES = 6, 4
#: Rounds of leaving out words that are too rare for a run; more would leave out little.
ROUNDS = 6
#: Bytes of text whose words are looked at together.
SLICE = 4 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


# -- one sequence -----------------------------------------------------------------------------


class Automaton:
    """The suffix automaton of a sequence of numbers; ``first`` is where a state's stretches first end.

    Most states have one transition, which is kept in flat arrays; those of the others are in dicts.
    """

    def __init__(self, numbers: list[int]):
        self.longest, self.link, self.first = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.letter, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for place, x in enumerate(numbers):
            last = self._extend(last, place, x)

    def step(self, state: int, x: int) -> int:
        if self.letter[state] == x:
            return self.to[state]
        others = self.more.get(state)
        return others.get(x, -1) if others else -1

    def _lead(self, state: int, x: int, to: int) -> None:
        if self.letter[state] in (-1, x):
            self.letter[state], self.to[state] = x, to
        else:
            self.more.setdefault(state, {})[x] = to

    def _state(self, longest: int, link: int, first: int, letter: int = -1, to: int = -1) -> int:
        for column, value in ((self.longest, longest), (self.link, link), (self.first, first), (self.letter, letter), (self.to, to)):
            column.append(value)
        return len(self.longest) - 1

    def _extend(self, last: int, place: int, x: int) -> int:
        new = self._state(self.longest[last] + 1, 0, place)
        at = last
        while at >= 0 and (there := self.step(at, x)) < 0:
            self._lead(at, x, new)
            at = self.link[at]
        if at >= 0:
            if self.longest[there] == self.longest[at] + 1:
                self.link[new] = there
            else:
                part = self._state(self.longest[at] + 1, self.link[there], self.first[there], self.letter[there], self.to[there])
                if there in self.more:
                    self.more[part] = self.more[there].copy()
                while at >= 0 and self.step(at, x) == there:
                    self._lead(at, x, part)
                    at = self.link[at]
                self.link[there] = self.link[new] = part
        return new


def factors(numbers: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of each factor; the last is -1 for a number that is new."""
    tool, out, start = Automaton(numbers), [], 0
    while start < len(numbers):
        state, end = 0, start
        while end < len(numbers):
            to = tool.step(state, numbers[end])
            if tool.first[to] == end:
                break
            state, end = to, end + 1
        earlier = tool.first[state] - (end - start) + 1 if end > start else -1
        out.append((start, max(end, start + 1), earlier))
        start = out[-1][1]
    return out


def common_prefixes(seq: list[int]) -> list[int]:
    """How far the sequence agrees with itself from each place on: the Z function."""
    n = len(seq)
    out, left, right = [0] * n, 0, 0
    out[0] = n
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and seq[k] == seq[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(numbers: list[int], low: int, start: int, end: int, most: int, times: int):
    """Runs of period up to ``most`` that begin at or before ``start`` and end from there to ``end``: Main's algorithm.

    What goes on beyond ``end`` is found at a later factor, what comes from before ``low`` was found at an earlier one.
    """
    t, x = numbers[low:start], numbers[start:end]
    a, b = len(t), len(x)
    ahead = common_prefixes([*x, -1, *t, *x])
    back = common_prefixes([*t[::-1], -1, *x[::-1], *t[::-1]])
    for period in range(1, most + 1):
        spans = []
        if period <= b:  # a whole period lies after the start
            spans.append((start - back[a + 1 + b - period], start + period + (ahead[period] if period < b else 0)))
        if period <= a:  # or before it
            spans.append((start - period - (back[period] if period < a else 0), start + ahead[b + 1 + a - period]))
        for i, j in spans:
            if j - i < times * period:
                continue
            goes_on = j == end < len(numbers) and numbers[j] == numbers[j - period]
            comes_from_before = i == low > 0 and numbers[i - 1] == numbers[i - 1 + period]
            if not goes_on and not comes_from_before:
                yield i, j, period


def runs_of(numbers: list[int], times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every maximal stretch that has a period ``times`` times, in order.

    A run that ends in a factor and begins before it reaches back less than one period beyond
    the factor before, for that one would be longer otherwise. So its period is below the
    length of both factors by ``times`` - 1, and only so much text is looked at.
    """
    found: dict[int, dict[int, int]] = {}
    starts: list[int] = []

    def add(i: int, j: int, period: int) -> None:
        if i not in found:
            found[i] = {}
            insort(starts, i)
        found[i][j] = min(period, found[i].get(j, period))

    before = 0
    for start, end, earlier in [*factors(numbers), (len(numbers), len(numbers), -1)]:
        size = end - start
        most = (before + size - 1) // (times - 1)
        if most > 0:
            for i, j, period in crossing(numbers, max(0, start - before - most), start, end, most, times):
                add(i, j, period)
        if earlier >= 0:
            at = bisect_right(starts, earlier)
            while at < len(starts) and starts[at] < earlier + size:  # copies are added further on, where the two overlap
                i = starts[at]
                for j, period in list(found[i].items()):
                    if j < earlier + size:
                        add(i + start - earlier, j + start - earlier, period)
                at += 1
        before = size
    return [(i, j, period) for i in starts for j, period in sorted(found[i].items())]


# -- a batch ----------------------------------------------------------------------------------


def stretches(words: np.ndarray, docs: np.ndarray, times: int = TIMES, least: int = WORDS) -> list[tuple[int, int]]:
    """The stretches (first, last) of a batch in which runs can be at all; every run lies within one.

    Each word of a run is in it ``times`` times. So a word that a document has less often parts
    its text, a word that is rarer than that in a part parts it again, and so on.
    """
    place, part, word = np.arange(len(words)), docs.astype(np.int64), words.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(place):
            return []
        _, key, count = np.unique(part * (int(words.max()) + 1) + word, return_inverse=True, return_counts=True)
        keep = count[key] >= times
        done = bool(keep.all())
        place, part, word = place[keep], part[keep], word[keep]
        part = np.cumsum(np.concatenate([[0], (np.diff(place) > 1) | (np.diff(part) != 0)]))[: len(place)]
        keep = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
        place, part, word = place[keep], part[keep], word[keep]
        if done:
            break
    if not len(place):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
    return list(zip(place[first].tolist(), (place[np.concatenate([first[1:], [len(place)]]) - 1] + 1).tolist(), strict=True))


def runs_of_texts(buf: np.ndarray, offsets: np.ndarray, times: int, least: int):
    """(n words, runs, offsets of runs by text, collapsed texts) of some texts together."""
    n = len(offsets) - 1
    start, end, first = find_words(buf, offsets)
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = start, end, len(buf)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(edges), pa.py_buffer(buf)])
    words = spans.take(pa.array(np.arange(0, 2 * len(start), 2)))
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    found = []
    for low, high in stretches(numbers, np.repeat(np.arange(n), np.diff(first)), times, least):
        found += [(low + i, low + j, q) for i, j, q in runs_of(numbers[low:high].tolist(), times) if j - i >= max(least, times * q)]
    runs = np.array(found, np.int64).reshape(-1, 3)
    doc = np.searchsorted(first, runs[:, 0], "right") - 1
    by_text = np.searchsorted(doc, np.arange(n + 1))
    keep = ~covered(runs[:, 0] + runs[:, 2], runs[:, 1], len(start))
    places = np.concatenate([[0], np.cumsum(per_doc(keep, first))])
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(places, pa.int64()), words.filter(pa.array(keep))), pa.scalar(b" ", pa.large_binary()))
    return np.diff(first), np.column_stack([runs[:, 0] - first[doc], runs[:, 1] - runs[:, 0], runs[:, 2]]), by_text, collapsed


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each document.

    ``runs`` are all maximal stretches of words with a smallest period p, of max(``least``,
    ``times`` * p) words or more, by start and period; they may overlap. ``collapsed`` has the
    words that no run holds after its first period, joined by one space. A null or empty
    text has no words, no runs and collapses to an empty one; a text is never looked at in parts.
    Repeated rows and ids stay; an empty table gives no rows; other columns are not
    looked at. Nothing is shuffled.
    """
    if times < 2:
        raise ValueError("a run has its period twice at least")
    ready(docs.sparkSession)

    def one(batch):
        buf, offsets = utf8(batch.column("text"))
        n, runs, at, texts = [], [], [np.zeros(1, np.int64)], []
        for low, high in groups_of(offsets, SLICE):
            own = offsets[low : high + 1]
            some = runs_of_texts(buf[own[0] : own[-1]], own - own[0], times, least)
            n.append(some[0])
            runs.append(some[1])
            at.append(some[2][1:] + at[-1][-1])
            texts.append(some[3])
        if not n:
            return None
        column = np.concatenate(runs)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(at), pa.int32()), pa.StructArray.from_arrays([pa.array(column[:, k]) for k in range(3)], names=["start", "length", "period"]))
        collapsed = pa.concat_arrays(texts).cast(pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n)), listed, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return by_batch(doc_rows(docs, id_col, text_col), one, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which one document in ten, by the crc32 of its id, repeats its words from some place on.

    With h that number, g = floor(h / 10) and n words, word i from a = g % n on becomes word
    a + (i - a) % (1 + floor((n - a) / (3 + g % 8))). A null id counts as an empty one.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), 1))
    listed = doc_rows(docs).withColumns({"words": words, "g": g}).withColumn("a", F.when(F.size("words") > 0, (F.col("g") % F.size("words")).cast("int")))
    period = (1 + F.floor((F.size("words") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    shifted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return listed.withColumn("p", period).select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(shifted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    shown = rows.withColumn("longest", longest)
    start, length, period = (-F.col("longest.start")), F.col("longest.length"), (-F.col("longest.period"))
    return shown.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
