"""Line-first cleaning with quality rules."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, by_batch, by_place, doc_rows, find_words, groups_of, in_arrow, merged, mixed, per_doc, ready, span_hashes, table, utf8

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

# Rules of lines: parameters of this operator.
CLOSING = ".!?:;,\"')]}…”»"
SHORT_LINE = 4
NAV_MARKS, NAV_LEAST = "|>»•", 3
SHOUTS = 3
SYMBOL_PERCENT = 10
#: Furniture of pages, by language: en, de, fr, es.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "click here", "sign up for", "log in to", "share on facebook", "follow us on", "lorem ipsum", "back to top",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "newsletter abonnieren", "klicken sie hier", "auf facebook teilen", "folgen sie uns", "nach oben",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "activer javascript", "abonnez-vous à", "cliquez ici", "partager sur facebook", "suivez-nous sur", "haut de page",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "aviso legal", "términos de uso", "active javascript", "suscríbete a", "haga clic aquí", "compartir en facebook", "síguenos en", "volver arriba",
)
LOST_PERCENT = 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long, failed_lines long, cleaned_sha256 string"

_SYMBOLS = SYMBOLS.decode()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with words is furniture: navigation, boilerplate, shouting, symbols, or a stub without closing punctuation."""
    body = line.strip(" \t\v\f\r")
    if n_words < SHORT_LINE and body[-1:] not in CLOSING:
        return True
    if sum(map(body.count, NAV_MARKS)) >= NAV_LEAST or body.count("!!") >= SHOUTS:
        return True
    if 100 * sum(map(body.count, _SYMBOLS)) > SYMBOL_PERCENT * len(body):
        return True
    low = body.lower()
    return any(p in low for p in BOILERPLATE)


def _sorted_twins(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (doc, hash) side by side, and whether each, in that order, equals the one before."""
    key = hashes ^ mixed(doc.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(key), bool)
    twin[1:] = key[order][1:] == key[order][:-1]
    return order, twin


def _measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n_docs = len(off) - 1
    start, end, first = find_words(buf, off)
    n_words = np.diff(first)
    word_chars = ((buf & 0xC0) != 0x80) & ~IS_SPACE[buf]
    doc_of_word = np.repeat(np.arange(n_docs), n_words)

    # lines: each document is cut at its newlines
    cuts = np.flatnonzero(buf == 10)
    doc_of_line = np.concatenate([np.arange(n_docs), np.searchsorted(off[1:], cuts, "right")])
    line_start, line_end = np.concatenate([off[:-1], cuts + 1]), np.concatenate([off[1:], cuts])
    by_end = np.lexsort((line_end, doc_of_line))
    by_start = np.lexsort((line_start, doc_of_line))
    line_start, line_end, doc_of_line = line_start[by_start], line_end[by_end], doc_of_line[by_start]
    words_before = np.searchsorted(start, line_end) - np.searchsorted(start, line_start)
    has = words_before > 0
    line_start, line_end, doc_of_line, line_words = line_start[has], line_end[has], doc_of_line[has], words_before[has]
    order, twin = _sorted_twins(doc_of_line, span_hashes(buf, line_start, line_end))
    dup_lines = np.bincount(doc_of_line[order][twin], minlength=n_docs)

    # windows of words
    w = REPEAT_WINDOW
    repeat = np.zeros(n_docs, np.int64)
    if len(start) >= w:
        hashes = span_hashes(buf, start, end)
        window = np.zeros(len(start) - w + 1, np.uint64)
        for i in range(w):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(window)]
        at = np.flatnonzero(doc_of_word[: len(window)] == doc_of_word[w - 1 :])
        if len(at):
            order, twin = _sorted_twins(doc_of_word[at], mixed(window[at]))
            either = twin.copy()
            either[:-1] |= twin[1:]
            s = np.sort(at[order][either])
            a, b = merged(s, s + w)
            marks = np.zeros(len(start) + 1, np.int64)
            marks[a] += 1
            np.add.at(marks, b, -1)
            repeat = per_doc(np.cumsum(marks[:-1]) > 0, first)
    return {"n_words": n_words, "word_chars": per_doc(word_chars, off), "n_symbols": per_doc(_SYMBOL[buf], off), "n_dup_lines": dup_lines, "n_repeat_words": repeat, "lines": (line_start, line_end, doc_of_line, line_words), "chars": word_chars}


def _judge(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[bytes | None]]:
    """The verdicts on a batch, and the cleaned text of each row that loses lines (else None)."""
    buf, off = utf8(batch.column("text"))
    cleaned: list[bytes | None] = []
    parts: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", "failed")}
    for a, b in groups_of(off):
        piece, own = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        m = _measure(piece, own)
        start, end, doc, words = m.pop("lines")
        raw = piece.tobytes()
        bad = np.fromiter((line_fails(raw[s:e].decode(), n) for s, e, n in zip(start.tolist(), end.tolist(), words.tolist(), strict=True)), bool, len(start))
        chars = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(m.pop("chars"), out=chars[1:])
        m["lost"] = np.bincount(doc[bad], weights=(chars[end] - chars[start])[bad], minlength=b - a).astype(np.int64)
        m["failed"] = np.bincount(doc[bad], minlength=b - a)
        cleaned += _without(raw, own, start[bad], doc[bad])
        for k, v in m.items():
            parts[k].append(v)
    c = {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in parts.items()}
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
    kept = ~failed & (100 * c["lost"] <= LOST_PERCENT * c["word_chars"])
    whole = buf.tobytes()
    digests = [hashlib.sha256(whole[off[i] : off[i + 1]] if new is None else new).hexdigest() for i, new in enumerate(cleaned)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], pa.array(failed), pa.array(kept), pa.array(c["lost"]), pa.array(c["failed"]), pa.array(digests, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")]), cleaned


def _without(raw: bytes, off: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> list[bytes | None]:
    """Each document without its lines that begin at ``starts``, the others joined by newlines; None where no line goes."""
    out: list[bytes | None] = [None] * (len(off) - 1)
    begin = np.searchsorted(doc, np.arange(len(off)))
    for d in np.flatnonzero(np.diff(begin)).tolist():
        gone, at, lines = set(starts[begin[d] : begin[d + 1]].tolist()), int(off[d]), []
        for line in raw[off[d] : off[d + 1]].split(b"\n"):
            if at not in gone:
                lines.append(line)
            at += len(line) + 1
        out[d] = b"\n".join(lines)
    return out


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures, the verdict and the cleaned text's digest of every row of ``docs``; one pass, no shuffle.

    A null text is an empty one and fails with 0 words, as does one of white space. Rows are
    judged alone, so ties, repeated rows and null ids change nothing; an empty table gives an
    empty result; only the id and the text are read. A long text takes a few bytes of memory
    for each of its own and no more.
    """
    ready(docs.sparkSession)
    return by_batch(doc_rows(docs, id_col, text_col), lambda batch: _judge(batch)[0], SCHEMA)


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged and with all columns, that pass every rule."""
    ready(docs.sparkSession)
    plain, (own_id, own_text) = by_place(docs, id_col, text_col)
    both = plain.select("*", F.col(own_id).cast("long").alias("id"), F.col(own_text).cast("string").alias("text"))

    def clean(batches):
        for batch in batches:
            verdict, _ = _judge(pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text")], names=["doc_id", "text"]))
            yield batch.filter(verdict.column("kept"))

    return in_arrow(both, clean, both.schema).drop("id", "text").toDF(*docs.columns)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``keep_documents`` without the lines that fail: the others joined by newlines.

    ``length_col``, if given, is set to the new length of changed texts; all else is kept.
    """
    ready(docs.sparkSession)
    wanted = [id_col, text_col] if length_col is None else [id_col, text_col, length_col]
    plain, (own_id, own_text, *own_length) = by_place(docs, *wanted)
    both = plain.select("*", F.col(own_id).cast("long").alias("id"), F.col(own_text).cast("string").alias("text"))

    def clean(batches):
        for batch in batches:
            verdict, cleaned = _judge(pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text")], names=["doc_id", "text"]))
            new = [t.as_py() if c is None else c.decode() for t, c in zip(batch.column("text"), cleaned, strict=True)]
            yield batch.set_column(batch.num_columns - 1, "text", pa.array(new, pa.string())).filter(verdict.column("kept"))

    out = in_arrow(both, clean, both.schema)
    for c in own_length:
        changed = ~F.col("text").eqNullSafe(F.col(own_text).cast("string"))
        out = out.withColumn(c, F.when(changed, F.length("text").cast(out.schema[c].dataType)).otherwise(F.col(c)))
    return out.withColumn(own_text, F.col("text")).drop("id", "text").toDF(*docs.columns)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


_PHRASES = " OR ".join("contains(low, '" + p.replace("'", "''") + "')" for p in BOILERPLATE)
SQL = {
    "op6_line_quality": rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base
), windows AS (
  SELECT row_id, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) >= 8
), keyed AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, array_to_string(w[i:i+7], ' ')) AS c FROM windows
), repeats AS (
  SELECT row_id, count(DISTINCT i + d) AS n FROM keyed, range(0, 8) t(d) WHERE c > 1 GROUP BY row_id
), lines AS (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM base
), worded AS (
  SELECT row_id, line, line_no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM lines
), tested AS (
  SELECT row_id, line, line_no, chars, (n < {SHORT_LINE} AND NOT contains('{CLOSING.replace("'", "''")}', right(body, 1)))
      OR length(regexp_replace(body, '[^{NAV_MARKS}]', '', 'g')) >= {NAV_LEAST}
      OR (length(body) - length(replace(body, '!!', ''))) / 2 >= {SHOUTS}
      OR 100 * length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) > {SYMBOL_PERCENT} * length(body)
      OR {_PHRASES.replace("low", "lower(body)")} AS bad
  FROM worded WHERE n > 0
), by_line AS (
  SELECT row_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost, count_if(bad) AS failed FROM tested GROUP BY row_id
), cleaned AS (
  SELECT l.row_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text FROM lines l LEFT JOIN tested t USING (row_id, line_no) WHERE NOT coalesce(t.bad, FALSE) GROUP BY l.row_id
), counted AS (
  SELECT doc_id, sha256(coalesce(c.text, '')) AS cleaned_sha256, len(w.w) AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS dup, coalesce(r.n, 0) AS rep, coalesce(lost, 0) AS lost, coalesce(failed, 0) AS failed
  FROM words w LEFT JOIN repeats r USING (row_id) LEFT JOIN by_line USING (row_id) LEFT JOIN cleaned c USING (row_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * rep > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * rep > 30 * n_words) AND 100 * lost <= {LOST_PERCENT} * word_chars AS kept,
  CAST(lost AS BIGINT) AS lost_chars, CAST(failed AS BIGINT) AS failed_lines, cleaned_sha256
FROM counted
"""
}
