"""Changing indexes: searches of segments against an index built anew, pruned searches against whole ones, what a change writes."""

import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recollect.config import Settings
from recollect.operators import index, retrieve, segments
from recollect.operators.manifest import Conflict, Manifest

WORDS = [f"w{i}" for i in range(300)]


def passages(spark, rows):
    df = spark.createDataFrame([(f"{i}:{v}", str(i), "body", t) for i, (v, t) in rows.items()], "chunk_id string, item_id string, kind string, text string")
    return index.tokenised(df)


def vectors(chunks):
    return index.blake2b_vectors(chunks, 64, ("chunk_id",))


def text(r):
    return " ".join(r.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=r.randrange(5, 60)))


CFG = Settings(dimensions=64)


def answers(idx, queries, k=12, cfg=CFG):
    terms = retrieve.query_terms(retrieve.asked_of(queries))
    qv = index.blake2b_vectors(queries.withColumn("tokens", index.tokenize(F.col("text"))), 64, ("qid",))
    lexical = sorted((x.qid, x["rank"], x.chunk_id, x.score) for x in retrieve.lexical_topk(idx, terms, k, cfg).collect())
    dense = sorted((x.qid, x["rank"], x.chunk_id, x.score) for x in index.dense_topk(idx.packs, qv, k, 64).collect())
    items = sorted(map(tuple, retrieve.search_items(idx, queries, qv, cfg=cfg, min_score=0.0).collect()), key=str)
    return lexical, dense, items


def test_changes_give_what_a_new_index_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PACK", 30)
    monkeypatch.setattr(segments, "PACK", 30)
    monkeypatch.setattr(segments, "ZONE_BITS", 3)
    r = random.Random(1)
    queries = spark.createDataFrame([(q, text(r)) for q in range(6)], "qid long, text string")
    now = {i: (0, text(r)) for i in range(200)}
    own = segments.Segmented(spark, str(tmp_path / "index"), CFG)
    first = passages(spark, now)
    own.change(first, vectors(first))
    for step in range(1, 9):
        old = r.sample(sorted(now), 40)
        gone, changed = old[:10], old[10:]
        removed = passages(spark, {i: now[i] for i in old})
        for i in gone:
            del now[i]
        # half of what is changed keeps its passage's id
        new = {i: (now[i][0] if k % 2 else step, text(r)) for k, i in enumerate(changed)} | {1000 * step + k: (step, text(r)) for k in range(15)}
        now |= new
        chunks = passages(spark, new)
        own.change(chunks, vectors(chunks), removed)
        if step in (1, 4, 8):
            whole = passages(spark, now)
            fresh = index.Index.of(whole, vectors(whole), CFG)
            idx = own.index()
            assert (idx.n_chunks, round(idx.avg_len, 9), idx.max_df) == (fresh.n_chunks, round(fresh.avg_len, 9), fresh.max_df)
            assert sorted(map(tuple, idx.terms.select("token", "df").collect())) == sorted(map(tuple, fresh.terms.select("token", "df").collect()))
            assert sorted(map(tuple, idx.postings.collect())) == sorted(map(tuple, fresh.postings.select("token", "chunk_id", "tf", "doc_len").collect()))
            assert sorted(x.chunk_id for x in idx.chunks.collect()) == sorted(f"{i}:{v}" for i, (v, _) in now.items())
            want = answers(fresh, queries)
            assert answers(idx, queries, cfg=replace(CFG, prune_from=10**9)) == want
            assert answers(idx, queries, cfg=replace(CFG, prune_from=0)) == want
    # merging kept the segments few, and what it replaced is gone but for what the last commit made dead
    version, held = own.segments()
    assert len(held) < 6
    folders = set(os.listdir(tmp_path / "index" / "segments"))
    dead = {p.split("/")[1] for p in own.manifest.read()[1]["dead"]}
    assert folders == {s.path.split("/")[1] for s in held} | dead


def test_a_small_change_writes_little(spark, tmp_path):
    r = random.Random(2)
    now = {i: (0, text(r)) for i in range(4000)}
    own = segments.Segmented(spark, str(tmp_path), CFG)
    first = passages(spark, now)
    own.change(first, vectors(first))

    def files():
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "segments") for f in names if f.endswith(".parquet")}

    before = files()
    few = r.sample(sorted(now), 40)
    chunks = passages(spark, {i: (1, text(r)) for i in few})
    own.change(chunks, vectors(chunks), passages(spark, {i: now[i] for i in few}))
    after = files()
    assert before.items() <= after.items()
    assert sum(v for p, v in after.items() if p not in before) < 0.05 * sum(before.values())


def test_zones_that_cannot_matter_are_not_read(spark, tmp_path):
    """Passages come in topics; of a common term's postings a search reads those of few zones."""
    r = random.Random(3)
    rows = {}
    for i in range(3000):
        topic = i // 100
        rows[f"{i:06d}"] = (0, " ".join(["common"] * (1 + (topic == 7) * 3) + [f"t{topic}x{r.randrange(20)}" for _ in range(12)] + ["filler" if i % 4 else "rare"]))
    chunks = passages(spark, rows)
    idx = index.Index.write(chunks, vectors(chunks), str(tmp_path), replace(CFG, max_df_ratio=1.0))
    queries = spark.createDataFrame([(1, "common filler t7x3 t7x5"), (2, "common t9x1 rare")], "qid long, text string")
    terms = retrieve.query_terms(retrieve.asked_of(queries))
    part = idx.of_tokens(terms)
    weighted = retrieve.weighted_terms(idx, part, terms)
    zones = retrieve.zone_bounds(part, weighted, CFG)
    wanted = retrieve.matching_zones(part, weighted, zones, 10, CFG)
    assert wanted.count() < zones.count() / 3
    read = lambda z: part.blocks.join(weighted.select("qid", "token"), "token").join(z.select("qid", "seq", "zone"), ["qid", "seq", "zone"]).agg(F.sum("n")).first()[0]
    assert read(wanted) < read(zones) / 3
    one, two = (retrieve.lexical_topk(idx, terms, 10, replace(CFG, prune_from=p)) for p in (0, 10**9))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_empty_and_conflicting_changes(spark, tmp_path):
    own = segments.Segmented(spark, str(tmp_path / "a"), CFG)
    none = index.tokenised(spark.createDataFrame([], "chunk_id string, item_id string, kind string, text string"))
    own.change(none, vectors(none))
    assert own.index().n_chunks == 0 and own.index().avg_len == 1.0
    queries = spark.createDataFrame([(1, "w1")], "qid long, text string")
    assert answers(own.index(), queries) == ([], [], [])
    one = passages(spark, {1: (0, "w1 w2 w3")})
    own.change(one, vectors(one))
    own.change(none, None, one)
    assert own.index().n_chunks == 0 and answers(own.index(), queries) == ([], [], [])
    with pytest.raises(ValueError):
        index.Index.write(one, vectors(one), str(tmp_path / "a"))
    m = Manifest(spark, str(tmp_path / "m"))
    assert m.read() == (0, {}) and m.commit(0, {"x": 1}, ["gone"]) == 1
    (tmp_path / "m" / "gone").mkdir()
    with pytest.raises(Conflict):
        m.commit(0, {"x": 2})
    assert m.read()[1]["x"] == 1 and (tmp_path / "m" / "gone").exists()
    assert m.commit(1, {"x": 3}) == 2 and not (tmp_path / "m" / "gone").exists()
    assert m.read(1)[1]["x"] == 1 and m.commit(2, {}) == 3 and m.versions() == [2, 3]


def test_what_is_due():
    s = lambda rows, dead=0: segments.Segment(0, "", rows, 0, rows, 1, dead)
    assert segments.due([s(10**6), s(500), s(500), s(500)]) is None
    assert segments.due([s(10**6), s(500), s(500), s(500), s(900)]) == (1, 5)
    assert segments.due([s(10**6), s(10, 500_000)]) == (0, 2)
    assert segments.due([s(10**6)] * 4 + [s(10)]) == (0, 5)
    assert segments.due([]) is None
