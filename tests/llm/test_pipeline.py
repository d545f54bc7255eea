"""run() against a plain version of its stages."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspan.llm import mixing, packing, quality, secrets
from tests.llm import brute
from tests.llm.test_operators import SF, check_packing, frame, texts  # noqa: F401


def near(rows):
    """One document of each class, comparing only pairs that share a run of five words."""
    words = {d: brute.WORDS.findall(t) for d, t in rows}
    by_run, root = {}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for d, w in words.items():
        for run in {tuple(w[i : i + 5]) for i in range(len(w) - 4)}:
            for other in by_run.setdefault(run, []):
                pairs.add((other, d))
            by_run[run].append(d)
    from gridspan.llm.minhash import alignment_similarity

    for a, b in pairs:
        if alignment_similarity(words[a], words[b], 0.8):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, t) for d, t in rows if find(d) == d]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    source = {r.doc_id: r.source for r in docs}
    clean = [(r.doc_id, r.text) for r in docs if not brute.quality(r.text)[5]]

    def lost(text):
        bad = [x for x in text.split("\n") if brute.WORDS.search(x) and quality.line_fails(x, len(brute.WORDS.findall(x)))]
        chars = lambda t: sum(map(len, brute.WORDS.findall(t)))
        return 100 * sum(map(chars, bad)) > 50 * chars(text)

    def cleaned(text):
        return "\n".join(x for x in text.split("\n") if not brute.WORDS.search(x) or not quality.line_fails(x, len(brute.WORDS.findall(x))))

    assert any(cleaned(t) != t for _, t in clean if not lost(t))
    kept = near([(d, cleaned(t)) for d, t in clean if not lost(t)])
    redacted = [(d, secrets.redacted(t, secrets.scan(t)[1])) for d, t in kept]
    table = spark.createDataFrame([(d, t, source[d]) for d, t in redacted], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(table).collect()}
    tool = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for d, t in redacted:
        n = len(tool.encode(t, add_special_tokens=False).ids) + 1
        want += [(d, k // 2048, min(2048, n - k)) for k in range(0, n, 2048)] * copies[d]
    got = corpus_pipeline.run(spark, SF).collect()
    check_packing(got)
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_odd_tables(spark, tmp_path, texts):
    """Nulls in every column, repeated rows and a column of a clashing name; then no rows at all."""
    docs = frame(spark, [*texts, (1, texts[0][1]), (None, None), (None, texts[10][1]), (400, texts[10][1])]).withColumn("digest", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    check_packing(rows)
    ids = {r.doc_id for r in rows}
    assert len(ids & {1, 7, 8}) == 1 and not ids & {2, 3, 4, 9, 10}
    # a text of a null id comes before its copies
    assert not ids & {11, 400}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
