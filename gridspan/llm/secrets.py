"""Secret scans: known forms, and strings that a primed zstandard dictionary can't foretell."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, by_place, doc_rows, in_arrow, ready, table

# Fixed values of the base scan: letters of the key words in either case, all else as it is.
ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

# Parameters of the novelty scan.
#: A candidate is a run of these characters, of this length, and has a digit and a letter.
SHORTEST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Longer runs are measured in parts of so many characters, for in a long text random letters get codes of their own and look less novel.
PART = re.compile(r"[A-Za-z0-9+/_=-]{1,128}")
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "access key", "private key", "credential", "auth", "bearer", "signature")
#: Characters before and after a candidate that it is measured against: a sensitive word in any of them is its context.
BEFORE, AFTER = 256, 128
WORDS = re.compile("|".join(map(re.escape, SENSITIVE)))
RUN = re.compile(r"[A-Za-z0-9+/_=-]+\Z")
#: Compressed bytes a character that count as incompressible: random letters, digits or hex digits need 0.8 to 1.2, identifiers and paths made of words 0.4 to 0.75.
LEAST_RATE = 0.77
#: The same for the parts of a run after the first, which may be longer.
MORE_RATE = 0.7
IDENTIFIERS = (
    "public private protected static final class function return const let var import export default async await def self None True False null true false "
    "string String integer boolean object Object value values key keys name names id ids index item items list array map config configuration settings options params "
    "request response header headers body content type length size count total result results error errors message status code data user users account client server "
    "session cookie url uri path file files directory host port database query table column row rows insert update delete select from where order group by limit "
    "password passwd secret token access refresh api apikey client credentials authorization bearer signature private public "
    "https www example com http localhost application json text html utf Content Type Authorization Bearer"
).split()
PROSE = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their "
    "said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its "
    "who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good "
    "new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take "
    "why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own "
    "under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world"
).split()
#: Identifiers and words that stand before all surroundings, for short ones to be compressed as a part of longer ones are.
PRIMER = " ".join([*IDENTIFIERS, *PROSE, *(w.capitalize() for w in PROSE)]).encode()
LEVEL, DICTIONARY_BYTES, SAMPLES = 9, 16384, 6000

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms, in code points, by start and then kind.

    Each form is matched leftmost and without overlap first; matches that are too short are
    dropped afterwards, so that what they consumed is not searched again.
    """
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    """Primed with a dictionary trained on made-up identifiers, code and prose, always the same.

    Besides strings to refer to, such a dictionary has codes for letters, without which short
    texts aren't compressed at all.
    """
    rng = random.Random(1)
    samples = []
    for _ in range(SAMPLES):
        words = rng.choices(rng.choice((IDENTIFIERS, PROSE)), k=rng.randint(2, 5))
        joined_by = ("_".join(words), "".join(w.capitalize() for w in words), "-".join(words), "/".join(words), " ".join(words) + ". ", ".".join(words) + str(rng.randint(0, 2030)))
        samples.append(rng.choice(joined_by).encode())
    primed = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes a character that the candidate adds to its surroundings, or to the identifiers alone if that is less, under the primed dictionary."""
    tool, c = _compressor(), candidate.encode()
    added = min(len(tool.compress(b + c + a)) - len(tool.compress(b + a)) for b, a in ((PRIMER + before.encode(), after.encode()), (PRIMER, b"")))
    return added / max(1, len(candidate))


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible strings in a sensitive context that no known form covers."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; then only ASCII is folded
        low = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text)
    if not WORDS.search(low):
        return []
    starts, ends = [a for a, _, _ in known], list(accumulate((b for _, b, _ in known), max))
    found, looked = [], 0
    for at, to in _contexts(low):
        for m in CANDIDATE.finditer(text, _run_start(text, at, looked)):
            if m.start() >= to:
                break
            looked, s = m.end(), m.start()
            while s < min(looked, to):  # part by part, until one is new
                part = PART.match(text, s).end()
                before = bisect_left(starts, part)
                e = novel_until(text, s) if part > at and looked - s >= SHORTEST and not (before and ends[before - 1] > s) else s
                if e > s:
                    found.append((s, e, "novel"))
                s = max(e, part)
    return found


def _contexts(low: str) -> list[tuple[int, int]]:
    """Where candidates of a sensitive context lie: from AFTER before such a word to BEFORE behind it, in disjoint stretches."""
    out: list[list[int]] = []
    for m in WORDS.finditer(low):
        at, to = max(0, m.start() - AFTER), m.end() + BEFORE
        if out and at <= out[-1][1]:
            out[-1][1] = to
        else:
            out.append([at, to])
    return [(a, b) for a, b in out]


def _run_start(text: str, at: int, least: int) -> int:
    """Where the run of candidate characters around a place begins, not before ``least``."""
    back = 64
    while at > least:
        first = max(least, at - back)
        tail = RUN.search(text, first, at)
        if tail is None:
            return at
        if tail.start() > first or first == least:
            return tail.start()
        back *= 2
    return max(at, least)


def novel_until(text: str, start: int) -> int:
    """Where the incompressible run from ``start`` ends, whatever its length; ``start`` if there is none."""
    at = start
    while part := PART.match(text, at):
        body, end = part[0], part.end()
        if at > start and len(body) < SHORTEST:  # what is left over of a longer run
            return end
        if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
            break
        if novelty(body, text[max(0, at - BEFORE) : at], text[end : end + AFTER]) < (MORE_RATE if at > start else LEAST_RATE):
            break
        at = end
    return at


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each in order."""
    base = base_spans(text)
    more = novel_spans(text, base)
    return base, sorted(base + more, key=_place) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of spans replaced by a mark of its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every row of ``docs``: counts by known form, their digest, and all spans.

    One pass over whole texts, no shuffle. A null text is an empty one; rows are scanned
    alone, so ties, repeats and null ids change nothing; an empty table gives no rows; other
    columns are not read.
    """
    ready(docs.sparkSession)

    def one(batch):
        rows = []
        for text in batch.column("text"):
            base, every = scan(text.as_py())
            kinds = [k for _, _, k in base]
            rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return by_batch(doc_rows(docs, id_col, text_col), one, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with secrets in the text replaced by marks; null texts stay null.

    ``length_col``, if given, is set to the new length of changed texts; all else is kept.
    """
    ready(docs.sparkSession)
    wanted = [text_col] if length_col is None else [text_col, length_col]
    plain, (own_text, *own_length) = by_place(docs, *wanted)
    one = plain.withColumn("text", F.col(own_text).cast("string"))

    def run(batches):
        for batch in batches:
            new = []
            for text in batch.column("text"):
                text = text.as_py()
                spans = scan(text)[1] if text else []
                new.append(redacted(text, spans) if spans else text)
            yield batch.set_column(batch.num_columns - 1, "text", pa.array(new, pa.string()))

    out = in_arrow(one, run, one.schema)
    for c in own_length:
        changed = ~F.col("text").eqNullSafe(F.col(own_text))
        out = out.withColumn(c, F.when(changed, F.length("text").cast(out.schema[c].dataType)).otherwise(F.col(c)))
    return out.withColumn(own_text, F.col("text")).drop("text").toDF(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
