"""Pages and tables of made PDF files, whole and damaged."""

import zlib

import pytest
from pyspark.sql import functions as F

from gridspan.functions import pdf
from gridspan.operators import parsing, tables
from gridspan.sources import pdf as source

HELVETICA = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/FirstChar 32/Widths[" + b" ".join([b"500"] * 96) + b"]>>"


def made(pages, flate=True, packed=False, font=HELVETICA, more=(), show=lambda t: b"(" + t.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj"):
    """A file with a page for each list of (x, y, text)."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 3: font, **dict(more)}
    kids, streams = [], {}
    for k, texts in enumerate(pages):
        page, content = 10 + 2 * k, 11 + 2 * k
        kids.append(b"%d 0 R" % page)
        objects[page] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % content
        body = b"q 1 0 0 1 0 0 cm BT /F1 10 Tf\n" + b"\n".join(b"1 0 0 1 %g %g Tm " % (x, y) + show(t) for x, y, t in texts) + b"\nET Q"
        streams[content] = body
    objects[2] = b"<</Type/Pages/Count %d/Kids[" % len(pages) + b" ".join(kids) + b"]/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>>>"
    out = b"%PDF-1.5\n"
    if packed:
        numbers, bodies = sorted(objects), b""
        head = b""
        for n in numbers:
            head += b"%d %d " % (n, len(bodies))
            bodies += objects[n] + b" "
        raw = zlib.compress(head + bodies)
        out += b"90 0 obj <</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(numbers), len(head), len(raw)) + raw + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items())
    for n, body in streams.items():
        raw = zlib.compress(body) if flate else body
        out += b"%d 0 obj <<%s/Length %d>>\nstream\r\n" % (n, b"/Filter/FlateDecode" if flate else b"", len(raw)) + raw + b"\nendstream\nendobj\n"
    return out + b"trailer <</Root 1 0 R>>\n%%EOF"


def grid(rows, top, left=50):
    return [(left + 120 * k, top - 14 * i, t) for i, row in enumerate(rows) for k, t in enumerate(row) if t]


ONE = [["STEP", "BA", "MA+30"], ["1", "$40,000", "$50,000"], ["2", "$41,000", "$51,000"], ["3", "", "$52,000"]]
TWO = [["Step", "DOC"], ["1", "61,000"], ["2", "62,000"]]


@pytest.mark.parametrize("flate, packed", [(True, False), (False, False), (True, True)])
def test_tables_are_the_cells_that_made_them(flate, packed):
    content = made([[(50, 760, "Salary (2022-2023)"), *grid(ONE, 700), (50, 600, "and then"), *grid(TWO, 560)], [(50, 700, "last page")]], flate, packed)
    (n, width, height, text, found), last = pdf.pages_of(content)
    assert (n, width, height) == (1, 612, 792) and found == [ONE, TWO]
    assert text.split("\n")[:3] == ["Salary (2022-2023)", "STEP  BA  MA+30", "1  $40,000  $50,000"]
    assert last == (2, 612, 792, "last page", [])


def test_places_of_text():
    """Words shown one after another, kerned apart, moved by lines, escaped and in hexadecimal."""
    show = b"BT /F1 10 Tf 14 TL 50 700 Td (One) Tj ( two) Tj T* [(th) -20 (ree) -400 (four)] TJ (five) ' 0 -20 TD <536978> Tj (\\(s\\145ven\\)) Tj ET BI /W 1 ID \x00( EI (x) 3 0 0 R"
    content = made([[]], flate=False).replace(b"q 1 0 0 1 0 0 cm BT /F1 10 Tf\n\nET Q", show).replace(b"/Length 38", b"/Length 1")
    ((_, _, _, text, _),) = pdf.pages_of(content)
    assert text == "One two\nthree four\nfive\nSix(seven)"


def test_codes_of_fonts():
    """Two-byte codes are read by the font's own map."""
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00e9> <0002> <6f225b57> endbfchar 1 beginbfrange <0041> <005a> <0061> endbfrange endcmap"
    more = {4: b"<</Length %d>>\nstream\n" % len(cmap) + cmap + b"\nendstream"}
    content = made([[(50, 700, "x")]], font=b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>", more=more.items(), show=lambda t: b"<000100020041005A> Tj")
    assert [p[3] for p in pdf.pages_of(content)] == ["é漢字az"]


WHOLE = made([grid(ONE, 700)])
DAMAGED = {
    "text": b"hello",
    "cut": WHOLE[: WHOLE.index(b"stream") + 20],
    "zlib": WHOLE.replace(b"stream\r\nx", b"stream\r\ny"),
    "locked": WHOLE.replace(b"trailer <<", b"trailer <</Encrypt 5 0 R "),
    "filter": WHOLE.replace(b"FlateDecode", b"JPXDecode"),
    "deep": made([[]], flate=False, more={5: b"[" * 500}.items()),
    "string": made([[]], flate=False, more={5: b"(no end"}.items()).replace(b"endobj", b""),
}


def test_files_on_spark(spark, tmp_path):
    """Pages by the table function, from SQL and from a folder; each damaged file is one row that says why."""
    for name, content in {**DAMAGED, "good": WHOLE, "two": made([grid(ONE, 700), grid(TWO, 700)])}.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)
    rows = {}
    for r in source.read_folder(spark, str(tmp_path)).collect():
        rows.setdefault(r.path.split("/")[-1][:-4], []).append(r)
    assert sorted(rows) == sorted([*DAMAGED, "good", "two"])
    for name in DAMAGED:
        assert len(rows[name]) == 1 and rows[name][0].problem and rows[name][0].tables is None, name
    assert [r.page_no for r in rows["two"]] == [1, 2] and [r.tables for r in rows["good"]] == [[ONE]]
    source.register_functions(spark)
    spark.createDataFrame([(1, WHOLE), (2, b""), (3, None)], "id int, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT id, page_no, problem IS NULL AS fine FROM some_files, LATERAL pdf_pages(content)").collect()
    assert sorted(map(tuple, got)) == [(1, 1, True), (2, 1, False), (3, 1, False)]


def test_records_from_bytes(spark):
    """From the bytes of files to records: the tables of pages, and their text by the parsers."""
    files = spark.createDataFrame([("a.pdf", made([grid(ONE, 700), grid(TWO, 700)])), ("b.pdf", b"junk")], "path string, content binary")
    pages = source.pages(files)
    found = tables.to_records(tables.split_on_steps(source.tables(pages).select(F.concat_ws("#", "path", "page_no", "table_no").alias("doc_id"), "rows")))
    want = {("a.pdf#1#0", "B", 0, 1, 40000.0), ("a.pdf#1#0", "B", 0, 2, 41000.0), ("a.pdf#1#0", "M", 30, 1, 50000.0), ("a.pdf#1#0", "M", 30, 2, 51000.0), ("a.pdf#1#0", "M", 30, 3, 52000.0), ("a.pdf#2#0", "D", 0, 1, 61000.0), ("a.pdf#2#0", "D", 0, 2, 62000.0)}
    assert {(r.doc_id, r.education, r.credits, r.step, float(r.salary)) for r in found.collect()} == want
    texts = pages.filter("problem IS NULL").select(F.col("page_no").cast("long").alias("doc_id"), "text")
    assert {(r.doc_id, r.lane, r.step, r.salary) for r in parsing.parse_tables(texts).collect()} == {(int(d.split("#")[1]), f"{e}+{c}", s, v) for d, e, c, s, v in want}


def test_texts_at_their_places_are_read_at_once(monkeypatch):
    """Plainly placed texts take no value by value reading, and others are read as before."""
    from gridspan.functions import pdf as reader

    plain = b"BT /F1 10 Tf\n" + b"".join(b"1 0 0 1 %d %d Tm (%d) Tj\n" % (40 + 80 * k, 700, k) for k in range(50)) + b"1 0 0 1 40 600 Tm (a\\)b) Tj 7 1 0 0 1 40 500 Tm (c) Tj ET"
    seen, value = [], reader.Reader.value
    monkeypatch.setattr(reader.Reader, "value", lambda self, depth=0: seen.append(1) or value(self, depth))
    spans = list(reader._shown(reader.Reader(plain), {}))
    assert [s.text for s in spans] == [*map(str, range(50)), "a)b", "c"]
    assert [(s.x, s.y) for s in spans[:2]] == [(40.0, 700.0), (120.0, 700.0)] and spans[-1].y == 600.0
    assert len(seen) < 40
