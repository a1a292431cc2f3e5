"""The pipeline, stage by stage, against brute force."""

import hashlib
import random
from array import array

import pytest
from test_copies import best, brute_lines
from test_similar import brute_similar
from test_windows import brute_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    r = random.Random(11)
    license_line = "All rights are reserved, under the usual terms."
    items = [(k, " ".join(f"q{r.randrange(10**5)}" for _ in range(15))) for k in range(5)]
    rows = []
    for i in range(80):
        words = [f"{r.choice('abcd')}{r.randrange(3000)}" for _ in range(r.randrange(12, 90))]
        rows.append([i, " ".join(words)])
        if i % 9 == 0:
            rows[-1][1] += "\n" + license_line
        if i % 13 == 5:
            rows[-1][1] += " " + items[i % 5][1]
    rows += [[100, rows[3][1]], [101, rows[4][1] + " more"], [102, "too short"], [103, None], [104, "a b c d e " * 40]]
    return [tuple(r) for r in rows], items


def test_pipeline(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = [(i, t) for i, t in rows if not brute_rules(t)[-1]]
    now = [(i, kept) for i, _, _, kept in brute_lines(now)]
    root = brute_similar(now)
    now = [x for k, x in enumerate(now) if root[k] == k]
    now = [(i, t) for i, t in now if all(best(p, " ".join(t.lower().split())) > len(p) // 20 for _, p in items)]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for i, t in now:
        ids = encode(t)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    gone = {i for i, _ in rows} - {i for i, _ in now}
    assert {102, 103, 104, 5, 18} <= gone and len(now) > 60
    assert [t for i, t in now if i == 100] == [""]  # its only line stays with its first holder


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", None, "s", 1, 2.0)], "doc_id long, text string, lang string, source string, n_chars long, kept double").limit(0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0
