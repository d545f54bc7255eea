"""Fill-in-middle: texts cut at unit boundaries and put in another order, a whole Arrow batch at a time.

A unit is a word with the white space before it; white space at the end of a text is one more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import IS_SPACE, by_batch, doc_rows, ready, table, utf8

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Per cent of the texts that are cut, and of those per cent with the suffix first.
CUT, SUFFIX_FIRST = 50, 80

#: What a byte is: white space, the first byte of any other code point, or one that continues a code point.
SPACE, LEAD, CONTINUES = 0, 1, 2
CLASS = np.full(256, LEAD, np.uint8)
CLASS[0x80:0xC0] = CONTINUES
CLASS[IS_SPACE] = SPACE

CUT_TEXTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a unit: solid ones before white space, and the last of a document."""
    solid = CLASS[buf] != SPACE
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return ends


def running(flags: np.ndarray) -> np.ndarray:
    """Running counts over the batch, with a leading 0; a difference of two places is a count of its document alone."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 2**31 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def mark_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each mark, and its document; what lies across two documents is none."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = (buf[:-2] == ord("<")) & (buf[2:] == ord(">")) & np.isin(buf[1:-1], [ord(m[1]) for m in MARKS])
    at = np.flatnonzero(found)
    doc = np.searchsorted(offsets, at, "right") - 1
    whole = at + 2 < offsets[doc + 1]
    return at[whole], doc[whole]


def pieces(buf: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The spans between neighbouring edges as an Arrow array over the same bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(buf)])


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p.encode(), pa.large_binary()) if isinstance(p, str) else p for p in parts], pa.scalar(b"", pa.large_binary()))


def _text(array: pa.Array) -> pa.Array:
    return array.cast(pa.binary()).view(pa.string())


def cut_batch(doc: pa.Array, text: pa.Array, draws: list[np.ndarray], cut: int, suffix_first: int) -> pa.RecordBatch:
    """All rows of a batch together: units, cuts, forms and outputs."""
    buf, offsets = utf8(text)
    first, last = offsets[:-1], offsets[1:]
    units = running(unit_ends(buf, offsets))
    n = (units[last] - units[first]).astype(np.int64)
    a, b = draws[0] % (n + 1), draws[1] % (n + 1)
    # the byte after unit k is where the running count first reaches the count before the document and k
    cuts = [np.where(k > 0, np.searchsorted(units, units[first] + k), first) for k in (np.minimum(a, b), np.maximum(a, b))]
    chars = running(CLASS[buf] != CONTINUES)
    marked = np.zeros(len(first), bool)
    marked[mark_places(buf, offsets)[1]] = True
    plain = (first == last) | marked | (draws[2] % 100 >= cut)
    spm = draws[3] % 100 < suffix_first
    edges = np.empty(3 * len(first) + 1, np.int64)
    edges[0:-1:3], edges[1::3], edges[2::3], edges[-1] = first, cuts[0], cuts[1], len(buf)
    three = pieces(buf, edges)
    prefix, middle, suffix = (three.take(pa.array(np.arange(k, 3 * len(first), 3))) for k in range(3))
    whole = pieces(buf, offsets)
    output = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), _joined(MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle), _joined(MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    sizes = [pa.array((chars[y] - chars[x]).astype(np.int64), mask=plain) for x, y in ((first, cuts[0]), (cuts[0], cuts[1]))]
    return pa.RecordBatch.from_arrays([doc, pa.array(n), pa.array(form, pa.string()), *sizes, _text(output)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each document.

    Two units drawn by the hash of seed and id bound the middle. A text is ``plain``, as it is, if
    it is empty, holds a mark, or is not among the ``cut`` per cent; else ``spm`` or ``psm``
    says in which order the parts stand. A null text is empty; a null id is hashed as an empty
    one. Repeated rows and texts of one id draw alike. An empty table gives no rows; other
    columns are not looked at. Nothing is shuffled, and a worker holds one batch.
    """
    ready(docs.sparkSession)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = doc_rows(docs, id_col, text_col).select("doc_id", "text", *[F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])

    def one(batch):
        return cut_batch(batch.column("doc_id"), batch.column("text"), [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(1, 5)], cut, suffix_first)

    return by_batch(rows, one, CUT_TEXTS)


def restored_texts(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs were made from. ValueError where a cut text hasn't its three marks in order."""
    buf, offsets = utf8(output)
    spm, psm = (pc.equal(form, f).to_numpy(zero_copy_only=False).astype(bool) for f in ("spm", "psm"))
    cut = spm | psm
    whole = pieces(buf, offsets)
    at, doc = mark_places(buf, offsets)
    at, doc = at[cut[doc]], doc[cut[doc]]
    rows = np.flatnonzero(cut)
    if not np.array_equal(doc, np.repeat(rows, 3)):
        raise ValueError("a text that was cut has three marks")
    at = at.reshape(-1, 3)
    order = np.where(spm[rows][:, None], *(np.array([[ord(MARKS[k][1]) for k in ks]], np.uint8) for ks in ((1, 0, 2), (0, 1, 2))))
    if not (np.array_equal(buf[at + 1], order) and np.array_equal(at[:, 0], offsets[rows])):
        raise ValueError("marks are not in the order of the form")
    edges = np.column_stack([at[:, 0], at[:, 0] + 3, at[:, 1], at[:, 1] + 3, at[:, 2], at[:, 2] + 3, offsets[rows + 1]])
    held = pieces(buf, np.concatenate([edges.ravel(), [len(buf)]]))
    one, two, middle = (held.take(pa.array(np.arange(k, 7 * len(rows), 7))) for k in (1, 3, 5))
    swapped = pa.array(spm[rows])
    built = _joined(pc.if_else(swapped, two, one), middle, pc.if_else(swapped, one, two))
    place = np.cumsum(cut) - 1
    return _text(pc.if_else(pa.array(cut), built.take(pa.array(place, mask=~cut)), whole))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made from; a null output counts as empty."""
    ready(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def one(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, restored_texts(batch.column(output_col), batch.column(form_col))], names=[*batch.schema.names, name])

    return by_batch(rows, one, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = {
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), x AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
}
