"""Batches that go through kept passages answer as an index does; tokenising and block forming stay cheap."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import index, retrieve, segments
from recollect.plans import tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_direct_search_equals_the_index(spark, tmp_path):
    r = random.Random(3)
    text = lambda: " ".join(r.choices([f"w{i}" for i in range(50)], weights=[1 / (i + 1) for i in range(50)], k=r.randrange(0, 30)))
    rows = [(f"{i:04d}", str(i // 3), "src0", "body", text()) for i in range(300)]
    index.tokenised(spark.createDataFrame(rows, "chunk_id string, item_id string, source string, kind string, text string")).write.parquet(f"{tmp_path}/held")
    chunks = spark.read.parquet(f"{tmp_path}/held")
    vectors = index.hashed(chunks, 64, ("chunk_id",))
    asked = spark.createDataFrame([(q, text()) for q in range(20)], "qid long, text string")
    qv = index.hashed(asked.withColumn("tokens", index.tokenize(F.col("text"))), 64, ("qid",))
    direct, kept = index.Index.direct(chunks, vectors), index.Index.write(chunks, vectors, f"{tmp_path}/index")
    assert (direct.n_chunks, direct.max_df) == (kept.n_chunks, kept.max_df) and math.isclose(direct.avg_len, kept.avg_len)
    one, other = (sorted(map(str, retrieve.search_items(x, asked, qv).collect())) for x in (direct, kept))
    assert one == other and one
    terms = index.query_terms(asked)
    for words in (retrieve.WORDS, 3):  # more words than tasks are told to look for
        was, retrieve.WORDS = retrieve.WORDS, words
        try:
            got = sorted(map(tuple, retrieve.lexical_topk(direct, terms, 7).collect()))
        finally:
            retrieve.WORDS = was
        assert got == sorted(map(tuple, retrieve.lexical_topk(kept, terms, 7).collect())) and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_one_batch_inverts_nothing(spark):
    import __spark_entry__ as entry

    tables._BUILT.clear()
    assert entry.queries()["idf_weights"](spark, SF).count() and entry.queries()["dense_topk_sqlhash"](spark, SF).count()
    assert not tables._BUILT


def test_rows_of_one_id_take_blocks(spark, tmp_path):
    rows = [(1, "thermals lift gliders", "en", "src0", 21), (1, "gliders\nridge", "en", "src0", 13), (2, "ridge lift", "en", "src0", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert tables.searched(spark, str(tmp_path), tables.whole_documents).blocks is not None
    assert tables.searched(spark, str(tmp_path)).blocks is not None


def test_whole_documents_are_not_kept(spark, tmp_path):
    spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = tables.whole_documents(spark, str(tmp_path))
    assert "parquet" in plan_of(df) and [r.tokens for r in df.collect()] == [["b"]]


def test_changing_characters_are_those_that_are_not_steady(spark):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, "é" + chr(c)) for c in points], "i int, t string")
    wrong = df.where(F.col("t").rlike(T.CHANGING) != F.col("t").rlike(f"[^{T.STEADY}]")).count()
    assert not wrong


def test_words_fold_as_texts_do(spark):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"Xy{chr(c)}Bc-D{chr(c)}.E",) for c in points], "t string")
    plain = F.regexp_extract_all(T.normalize(F.col("t")), F.lit(f"[{T.CJK}]+|{T.words.WORD}"), F.lit(0))
    got = df.select("t", T.tokenize(F.col("t"), False).alias("got"), plain.alias("found")).collect()

    def of(w):
        w = w.strip("-_.")
        parts = [p for p in re.split("[-_.]+", w)]
        return [] if not w else [w] if len(parts) == 1 else [w, *[p for p in parts if len(p) > 1], "".join(parts)]

    runs = lambda w: [*w, *[w[i : i + 2] for i in range(len(w) - 1)]]
    assert not [r for r in got if r.got != [t for w in r.found for t in (of(w) if ord(w[0]) < 128 else runs(w))]][:5]


def test_blocks_are_formed_once_and_in_pieces(spark, monkeypatch):
    chunks = index.tokenised(spark.createDataFrame([(i, "thermals lift gliders") for i in range(50)], "chunk_id long, text string"))
    assert segments.blocks_of(chunks, 3)._jdf.queryExecution().executedPlan().toString().count("rangepartitioning(") == 1
    b = pa.RecordBatch.from_arrays([pa.array(range(90)), pa.array([2] * 90), pa.array([["a", f"t{i % 7}"] for i in range(90)]), pa.array(np.arange(90) // 10)], names=["chunk_id", "doc_len", "tokens", "zone"])
    whole = [r for x in segments.zone_blocks([b]) for r in x.to_pylist()]
    monkeypatch.setattr(segments, "AT_ONCE", 30)
    pieces = list(segments.zone_blocks([b]))
    key = lambda r: (r["token"], r["zone"])
    assert len(pieces) > 3 and sorted((r for x in pieces for r in x.to_pylist()), key=key) == sorted(whole, key=key)


def test_vectors_come_from_small_slices(spark):
    r = random.Random(1)
    rows = [(i, [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(0, 12))] if i % 9 else None) for i in range(200)]
    got = {x.chunk_id: dict(zip(x.idx, x.val, strict=True)) for x in index.hashed(spark.createDataFrame(rows, "chunk_id long, tokens array<string>"), 16, ("chunk_id",)).collect()}
    import hashlib

    for i, tokens in rows:
        cells = {}
        for t in dict.fromkeys(tokens or ()):
            d = hashlib.sha1(t.encode()).digest()
            w = (1 + math.log(tokens.count(t))) * (1 + 0.35 * min(len(t), 4)) * (1 if d[4] >= 128 else -1)
            cells[int.from_bytes(d[:4], "big") % 16] = cells.get(int.from_bytes(d[:4], "big") % 16, 0.0) + w
        norm = max(1e-9, math.sqrt(sum(x * x for x in cells.values())))
        assert got[i].keys() == cells.keys() and all(math.isclose(got[i][k], x / norm, abs_tol=1e-12) for k, x in cells.items())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_passages_come_without_an_index(spark):
    import __spark_entry__ as entry

    tables._BUILT.clear()
    assert entry.queries()["reindex"](spark, SF).count() and entry.queries()["federate"](spark, SF).count()
    assert not tables._BUILT


def test_python_steps_take_small_slices(spark, monkeypatch):
    from recollect.functions import extract
    from recollect.operators import chunking

    steps = []
    monkeypatch.setattr(spark.range(0).__class__, "mapInArrow", lambda df, f, schema: steps.append(f) or (_ for _ in ()).throw(InterruptedError()))
    segments = "array(named_struct('text', 'thermals lift gliders', 'start', 0D, 'end', 0D))"
    items = spark.range(1).selectExpr("'i' item_id", "'' title", "'' author", "'' description", "'' folder", "array('a') tags", "'post' media_kind", f"{segments} segments", "cast(array() as array<struct<text:string,replies:array<string>>>) comments")
    pages = spark.range(1).selectExpr("id page_id", "'u' url", "'<p>x</p>' html")
    for make in (lambda: chunking.chunk_items(items), lambda: extract.extract_pages(pages)):
        with pytest.raises(InterruptedError):
            make()
    item = [pa.array(["i"] * 600), pa.array(["head"] * 600), pa.array([["some words here"]] * 600), pa.array([None] * 600, pa.list_(pa.struct([("text", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))), pa.array([[]] * 600, pa.list_(pa.string())), pa.array(["body"] * 600), pa.array([{"_": 0}] * 600)]
    got = list(steps[0](iter([pa.RecordBatch.from_arrays(item, names=list("abcdefg"))])))
    assert len(got) == 3 and sum(b.num_rows for b in got) == 1200
    got = list(steps[1](iter([pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["<p>x</p>"] * 600)], names=["page_id", "html"])])))
    assert len(got) == 3 and sum(b.num_rows for b in got) == 600
