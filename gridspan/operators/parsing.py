"""Text tables whose layout is sequential: parsed line by line, a document at a time.

A document is one row and its parser a small generator; Spark deals the documents out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lanes import BARE, LABEL, LANES, NUMBERED, SIGNED, WRITTEN
from ..session import importable

LANE = re.compile(LABEL)
NUMBERED_LANE = re.compile(r"(?<![A-Z0-9])(?:(?:LANE|PAY\s*SCALE|LEVEL)\s*([0-9]+)|[(]?([IVX]+)[)]?)(?![A-Z0-9])")
MARKER = re.compile(r"^\d{1,2}(?:[-/]\d{1,2})?$")
AMOUNT = re.compile(r"^\$?\d[\d,]*(?:\.\d{1,2})?$")
#: What a header has beside lanes.
NO_LANE = re.compile(r"^(?:STEPS?|YEARS?|DEGREE|[^A-Z0-9]+)$")
LEAST, MOST = 20000, 200000
#: Data rows of a pasted grid that are looked at for the number of its columns.
LOOKED_AT = 10

PARSED = "doc_id long, lane string, step int, salary double, pos int"


def lanes_in(line: str) -> list[str]:
    """The lanes that a line names, in order: ``B+15``."""
    return [x for x in _columns(line) if not x.startswith("?")]


def _columns(line: str) -> list[str]:
    """The columns of a header line: lanes, and ``?`` with its text for a word that names none."""
    line = line.upper().replace("’", "'")
    marks = [(m.start(), m.end(), _named(m)) for m in LANE.finditer(line)]
    marks += [(m.start(), m.end(), x) for m in NUMBERED_LANE.finditer(line) if (x := _numbered(m)) and not any(a < m.end() and m.start() < b for a, b, _ in marks)]
    out, at = [], 0
    for start, end, lane in [*sorted(marks), (len(line), len(line), None)]:
        out += [f"?{w}" for w in line[at:start].split() if not NO_LANE.match(w)]
        out += [lane] if lane else []
        at = max(at, end)
    return out


def _named(found: re.Match) -> str:
    letter, own = LANES[next(name for k, name in enumerate(WRITTEN) if found[k + 1])]
    credits = (found[SIGNED] or found[BARE] or "").translate(str.maketrans("LI", "11"))
    return f"{letter}+{int(credits) if credits else own}"


def _numbered(found: re.Match) -> str | None:
    """The lane of a number behind LANE or the like, or of a roman one."""
    value = {"I": 1, "V": 5, "X": 10}
    digits = [value[c] for c in found[2] or ""]
    n = int(found[1]) if found[1] else sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0], strict=True))
    if not 1 <= n <= len(NUMBERED):
        return None
    return "{}+{}".format(*NUMBERED[n - 1])


def amount(token: str) -> float | None:
    """A salary in range, else None; a point read for a comma is repaired."""
    token = re.sub(r"\.(\d{3})\.", r"\1.", token)
    if not AMOUNT.match(token):
        return None
    value = float(token.replace("$", "").replace(",", ""))
    return value if LEAST <= value <= MOST else None


def _row(lanes: list[str], step: int | None, values: list[float]) -> Iterator[tuple[str, int, float]]:
    """The records of a row; fewer values than lanes stand at the right, as sparse grids are set."""
    if step is not None:
        for lane, value in zip(lanes[max(0, len(lanes) - len(values)) :], values, strict=False):
            if not lane.startswith("?"):
                yield lane, step, value


def rows_of(text: str) -> Iterator[tuple[str, int, float]]:
    """Tables in rows: a header line of lanes, then lines of a step and a salary for each lane.

    Lines without a step continue the row before them. A new header begins a new table.
    """
    lanes: list[str] = []
    step, values = None, []
    for line in (text or "").split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        found = [a for a in map(amount, tokens) if a is not None]
        if not found and (labels := lanes_in(line)):
            yield from _row(lanes, step, values)
            lanes, step, values = labels, None, []
        elif MARKER.match(tokens[0]) and found:
            yield from _row(lanes, step, values)
            step, values = int(re.match(r"\d+", tokens[0])[0]), found
        elif found and step is not None and len(values) < len(lanes):
            values = values + found
    yield from _row(lanes, step, values)


def columns_of(text: str) -> Iterator[tuple[str, int, float]]:
    """Tables in columns: a run of steps, then for each lane its label and a run of salaries; a new run of steps restarts."""
    steps: list[int] = []
    lane, at, fresh = None, 0, True
    for token in (text or "").split():
        if MARKER.match(token):
            if not fresh:
                steps, lane, at, fresh = [], None, 0, True
            steps.append(int(re.match(r"\d+", token)[0]))
        elif (value := amount(token)) is not None:
            fresh = False
            if lane is not None and at < len(steps):
                yield lane, steps[at], value
                at += 1
        elif labels := lanes_in(token):
            lane, at = labels[0], 0


def _step_and_values(line: str) -> tuple[int | None, list[float]]:
    """The step that a data line begins with, ``3`` or ``Step 3``, if any, and its numbers."""
    tokens = line.split()
    if tokens and tokens[0].upper() == "STEP":
        tokens = tokens[1:]
    step = int(tokens[0]) if tokens and tokens[0].isdigit() and len(tokens[0]) <= 2 else None
    return step, [float(t.replace("$", "").replace(",", "")) for t in tokens[0 if step is None else 1 :] if AMOUNT.match(t)]


def grid_of(text: str) -> Iterator[tuple[str, int, float]]:
    """A pasted grid: header lines, then rows of a step and its numbers.

    All lines before the first step are header. The first data rows say how many columns there
    are; labels may be of several words (``Bachelors Masters + 30``), and a word that names no
    lane is a column of its own if columns are left, so that others keep their place. A short
    row stands at the right; lines without a step go on with the row before.
    """
    lines = [x for x in (text or "").split("\n") if x.strip()]
    first = next((i for i, x in enumerate(lines) if _step_and_values(x)[0] is not None), None)
    if not first:
        return
    data = [_step_and_values(x) for x in lines[first:]]
    width = max((len(v) for s, v in data[:LOOKED_AT] if s is not None), default=0)
    lanes = _columns(" ".join(lines[:first]))
    unknown = [i for i, x in enumerate(lanes) if x.startswith("?")]
    while unknown and len(lanes) > width:  # titles and notes, which stand before the labels
        lanes.pop(unknown.pop(0))
        unknown = [i for i, x in enumerate(lanes) if x.startswith("?")]
    lanes += [f"?{i}" for i in range(len(lanes), width)]
    step, values = None, []
    for own, more in data:
        if own is None:
            values = values + more if len(values) < len(lanes) else values
            continue
        yield from _row(lanes, step, values)
        step, values = own, more
    yield from _row(lanes, step, values)


def parse_tables(docs: DataFrame, parser: Callable[[str], Iterator[tuple[str, int, float]]] = rows_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records of every document's text, in order. Null texts have none."""
    return parse_each(docs, parser, id_col, text_col).filter("error IS NULL AND lane IS NOT NULL").drop("error")


def parse_each(docs: DataFrame, parser: Callable[[str], Iterator[tuple[str, int, float]]] = rows_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Records of a batch of documents, each on its own: one that the parser fails on has one row, with ``error``, and no records.

    A document without records has one row too, without lane, so that a summary can count it.
    """

    def own(doc, text) -> list[tuple]:
        try:
            found = list(parser(text))
        except Exception as e:  # noqa: BLE001  the error is data: it belongs to this document only
            return [(doc, None, None, None, None, f"{type(e).__name__}: {e}")]
        return [(doc, lane, step, salary, pos, None) for pos, (lane, step, salary) in enumerate(found)] or [(doc, None, None, None, None, None)]

    def run(frames):
        for frame in frames:
            out = [row for doc, text in zip(frame[id_col], frame[text_col], strict=True) for row in own(doc, text)]
            made = pd.DataFrame(out, columns=["doc_id", "lane", "step", "salary", "pos", "error"])
            yield made.astype({"step": "Int32", "pos": "Int32", "salary": "Float64"})

    importable(docs.sparkSession)
    return docs.select(id_col, text_col).mapInPandas(run, PARSED + ", error string")


def batch_results(parsed: DataFrame) -> DataFrame:
    """A row per document of a batch: ``doc_id, records, success, error``."""
    return parsed.groupBy("doc_id").agg(F.count("lane").alias("records"), F.max("error").alias("error")).select("doc_id", "records", (F.col("error").isNull() & (F.col("records") > 0)).alias("success"), "error")


# -- in SQL -----------------------------------------------------------------------------------


class _TableFunction:
    """One text to its records, for a lateral join; a text that the parser fails on gives one row with ``error``, one without records none."""

    parser: Callable[[str], Iterator[tuple[str, int, float]]]

    def eval(self, text: str) -> Iterator[tuple]:
        pos = -1
        try:
            for pos, (lane, step, salary) in enumerate(type(self).parser(text)):
                yield lane, step, salary, pos, None
        except Exception as e:  # noqa: BLE001  the error is data: it belongs to this document only
            yield None, None, None, pos + 1, f"{type(e).__name__}: {e}"


def table_function(parser: Callable[[str], Iterator[tuple[str, int, float]]]):
    """A parser as a table function of one text: ``lane, step, salary, pos, error``."""
    made = type("Records", (_TableFunction,), {"parser": staticmethod(parser)})
    return F.udtf(made, returnType="lane string, step int, salary double, pos int, error string")


def register_functions(spark: SparkSession, **more: Callable[[str], Iterator[tuple[str, int, float]]]) -> None:
    """``table_in_rows(text)``, ``table_in_columns(text)`` and ``pasted_grid(text)`` in SQL, and what else is named."""
    importable(spark)
    for name, parser in {"table_in_rows": rows_of, "table_in_columns": columns_of, "pasted_grid": grid_of, **more}.items():
        spark.udtf.register(name, table_function(parser))
