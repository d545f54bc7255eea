"""Fill-in-middle, periodic runs and addressable codes against plain versions."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspan.llm import codes, middle, packing, runs
from tests.llm import brute
from tests.llm.test_operators import SF, frame

AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "  one\r\ntwo  "), (6, "é 漢字 \x85  x y 🙂🙂 z"), (7, "a <P> b"), (8, "a <S> b"), (9, "<M>"), (10, "<P <S <M> M> S> P>"), (11, "< P> <p> <Q>"), (None, "no id here"), (None, None), (-7, "a b c d e f"), (5, "  one\r\ntwo  "), (12, "<"), (13, "P>tail"), (2**62, "far away id"), (14, "<P"), (15, "> S> x")]


# -- fill-in-middle ---------------------------------------------------------------------------


def test_cut_texts_equal_plain_version(spark):
    rng = random.Random(3)
    rows = AWKWARD + [(100 + i, "".join(rng.choice(["a", "é", " ", "\n", "<", "P", "S", ">", "漢", "  ", "x\x0b"]) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(600, "wörd " * 40_000)]
    made = middle.restore(middle.fill_in_middle(frame(spark, rows)))
    got = sorted(made.collect(), key=repr)
    want = sorted([(d, *brute.middle(d, t), t or "") for d, t in rows], key=lambda r: repr(r))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("cut, suffix_first", [(0, 80), (100, 0), (100, 100)])
def test_shares_of_forms(spark, cut, suffix_first):
    made = middle.restore(middle.fill_in_middle(frame(spark, AWKWARD), seed=7, cut=cut, suffix_first=suffix_first))
    assert sorted(repr(tuple(r)) for r in made.collect()) == sorted(repr((d, *brute.middle(d, t, 7, cut, suffix_first), t or "")) for d, t in AWKWARD)


def test_batches_are_independent(spark):
    """A batch that begins within an Arrow buffer gives the same rows, and marks do not join across documents."""
    text = pa.array(["skip <P> me", "<", "P>", "a <", "S> b", "x y z"])
    draws = [np.arange(5) + k for k in range(4)]
    whole = middle.cut_batch(pa.array(range(5)), text.slice(1), draws, 100, 5)
    single = [middle.cut_batch(pa.array([i]), text.slice(i + 1, 1), [d[i : i + 1] for d in draws], 100, 5) for i in range(5)]
    assert whole.to_pylist() == [r for b in single for r in b.to_pylist()]
    assert set(whole.column("form").to_pylist()) == {"spm", "psm"}


def test_damaged_outputs_are_refused():
    for output, form in (("<S>a<P>b", "spm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>", "psm")):
        with pytest.raises(ValueError):
            middle.restored_texts(pa.array([output]), pa.array([form]))
    assert middle.restored_texts(pa.array(["<P>a<S>c<M>b", "<P>", "<S>c<P>a<M>b"]), pa.array(["psm", "plain", "spm"])).to_pylist() == ["abc", "<P>", "abc"]


def test_fill_in_middle_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = middle.op11_fill_in_middle(spark, SF)
    want = con.sql(middle.SQL["op11_fill_in_middle"])
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


# -- periodic runs ----------------------------------------------------------------------------


def plain(found):
    return [(i, j - i, q) for i, j, q in found]


@pytest.mark.parametrize("times, letters", [(2, 2), (2, 3), (3, 2), (4, 1), (4, 2), (4, 3)])
def test_runs_of_random_sequences(times, letters):
    rng = random.Random(letters * 10 + times)
    for _ in range(1500):
        numbers = []
        while len(numbers) < rng.randint(1, 60):
            block = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
            numbers += block * rng.randint(1, 6)
        assert plain(runs.runs_of(numbers, times)) == brute.runs(numbers, times, 0), numbers


def test_runs_of_words_that_repeat_at_all_scales():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    assert plain(runs.runs_of(b[:300], 2)) == brute.runs(b[:300], 2, 0)
    nested = ([1, 1, 1, 1, 1, 1, 2] * 5 + [3]) * 6 + [1] * 9
    assert plain(runs.runs_of(nested, 4)) == brute.runs(nested, 4, 0)


def test_factors_are_the_longest_that_start_earlier():
    rng = random.Random(1)
    for _ in range(300):
        numbers = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for start, end, earlier in runs.factors(numbers):
            fits = lambda n: any(numbers[k : k + n] == numbers[start : start + n] for k in range(start))
            assert start == at and (earlier < 0 and end == start + 1 and not fits(1) or fits(end - start) and numbers[earlier : earlier + end - start] == numbers[start:end] and 0 <= earlier < start)
            assert end == len(numbers) or earlier < 0 or not fits(end - start + 1)
            at = end
        assert at == len(numbers)


def test_every_run_lies_in_a_stretch():
    rng = random.Random(2)
    for _ in range(200):
        docs = [[rng.randrange(rng.choice([2, 6, 30])) for _ in range(rng.randint(0, 60))] for _ in range(4)]
        words = np.array([w for d in docs for w in d], np.int64)
        spans = runs.stretches(words, np.repeat(np.arange(4), [len(d) for d in docs])) if len(words) else []
        base = 0
        for d in docs:
            assert all(any(low <= base + i and base + i + n <= high for low, high in spans) for i, n, _ in brute.runs(d))
            base += len(d)


PERIODIC = AWKWARD + [(50, "ha " * 6), (51, "ha " * 5), (52, "ab\ncd  " * 4 + "ab"), (53, "x " + "ab cd " * 4 + "y " + "ab cd " * 4), (54, ("a a a a a a b " * 6) * 2), (55, "same " * 3000), (56, "one two three " * 2000 + "end " + "one two three " * 4), (57, "a a a\x85a " * 12)]


def test_periodic_runs_equal_plain_version(spark):
    rng = random.Random(4)
    rows = PERIODIC + [(1000 + i, " ".join(" ".join(rng.choice(["a", "b", "é", "d"][: rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))) + (" " + "v w ") * rng.randint(0, 6) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(2000 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300)))) for i in range(200)]
    found = {}
    for r in runs.periodic_runs(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.n_words))
    for d, t in rows:
        assert (brute.runs(brute.WORDS.findall(t or "")), len(brute.WORDS.findall(t or ""))) in found[d], d


def test_periodic_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(6)
    rows = PERIODIC + [(3000 + i, " ".join(rng.choice(["the", "of", "a", "x"]) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(repr(tuple(r)) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted(repr((d, *brute.periodic(d, t))) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 20


def test_periodic_query_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(d, t) for d, t in rows if len((t or "").split()) < 1500]
    got = {r.doc_id: tuple(r)[1:] for r in runs.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[d] == brute.periodic(d, t) for d, t in short) and len(short) > 100


def test_a_long_run_is_found_in_linear_time():
    assert runs.runs_of([0, 1, 2] * 60_000, 4) == [(0, 180_000, 3)]


# -- addressable codes ------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 255, 256, 257, 49_408, 1 << 24, 1 << 32])
def test_files_give_back_their_ids(top):
    rng = np.random.default_rng(top % 1000)
    lengths = np.array([3, 0, 5000, 1, 700, 0, 12])
    ids = (rng.random(lengths.sum()) ** 3 * top).astype(np.uint32)
    read = codes.Codes(codes.encode_file([5, None, -1, 7, 7, 8, 9], lengths, ids))
    assert read.doc_ids.to_pylist() == [5, None, -1, 7, 7, 8, 9] and read.ends.tolist() == np.cumsum(lengths).tolist()
    starts = np.cumsum(lengths) - lengths
    for s, n in zip(starts.tolist(), lengths.tolist()):
        assert np.array_equal(read.span(s, s + n), ids[s : s + n])
    places = rng.integers(0, len(ids), 9000)
    assert np.array_equal(read.tokens_at(places), ids[places])
    assert np.array_equal(read.tokens_at(np.arange(len(ids))), ids)


def test_ranks_of_all_places():
    bits = np.random.default_rng(0).random(3 * codes.BLOCK + 5) < 0.4
    ids = np.where(bits, 300, 7).astype(np.uint32)
    level = codes.Codes(codes.encode_file([1], np.array([len(ids)]), ids)).levels[0]
    assert np.array_equal(level.rank(np.arange(len(bits) + 1)), np.concatenate([[0], np.cumsum(bits)]))


def test_damaged_files_are_refused():
    content = codes.encode_file([1, 2], np.array([2, 3]), np.array([1, 2, 70_000, 4, 5]))
    assert codes.Codes(content).span(2, 3).tolist() == [70_000]
    for bad in (b"", content[:-1], content[:10], b"X" + content[1:], content[:30] + b"\xff" + content[31:]):
        with pytest.raises(ValueError):
            codes.Codes(bad)


def tokenized(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tool.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_documents_come_back_in_order(spark):
    rng = random.Random(8)
    rows = [r for r in AWKWARD if r[0] is None or r[0] < 2**60] + [(i, " ".join(rng.choice(["Hello", "wörld", "123", "x=1;", "漢字"]) for _ in range(rng.randint(0, 50)))) for i in range(200, 400)] + [(9, "again " * k) for k in range(40)]
    files = codes.token_files(frame(spark, rows).repartition(5), file_ids=500).cache()
    assert files.count() > 3
    got = sorted(codes.read_documents(files).collect(), key=lambda r: r.start)
    ids = tokenized([t for _, t in rows])
    want = sorted(((d, tuple(x)) for (d, _), x in zip(rows, ids)), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((repr(r.doc_id), tuple(r.ids)) for r in got) == sorted((repr(d), x) for d, x in want)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.problem is None
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    flat = [x for r in got for x in r.ids]
    places = [(rng.randrange(-5, at + 50),) for _ in range(300)]
    looked = {r.place: r.token for r in codes.tokens_at(files, spark.createDataFrame(places + places, "place int")).collect()}
    assert looked == {p: flat[p] for (p,) in places if 0 <= p < at}
    files.unpersist()


def test_codes_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    at, want = 0, []
    for (d, _), x in zip(rows, tokenized([t for _, t in rows])):
        want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, codes.op13_addressable_codes(spark, SF).collect())) == sorted(want)


def test_a_damaged_file_is_a_row(spark):
    files = spark.createDataFrame([(0, 0, 1, 2, bytes(codes.encode_file([4], np.array([2]), np.array([9, 2]))))], codes.FILES).union(spark.createDataFrame([(0, 1, 1, 1, b"junk"), (1, 0, 0, 0, None)], codes.FILES))
    rows = {(r.part, r.seq): (r.doc_id, r.ids, r.problem) for r in codes.read_texts(files).collect()}
    assert rows[0, 0] == (4, [9, 2], None) and rows[0, 1][2] == rows[1, 0][2] == "no file of codes"


def test_new_operators_on_empty_tables(spark):
    docs = frame(spark, [])
    files = codes.token_files(docs)
    for made in (middle.restore(middle.fill_in_middle(docs)), runs.periodic_runs(docs), runs.with_planted_runs(docs), codes.read_documents(files), codes.tokens_at(files, docs.select(F.col("doc_id").alias("place")))):
        assert made.count() == 0


def test_encoder_of_awkward_texts():
    import public_tokenizers

    tool = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for (_, t), want in zip(AWKWARD, tokenized([t for _, t in AWKWARD])):
        assert np.frombuffer(tool.encode((t or "").encode()), "<u4").tolist() == want[:-1], t
