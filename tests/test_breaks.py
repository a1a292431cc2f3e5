"""Passages of segments in blocks against the plain fold, also where one item fills many blocks."""

import random
from dataclasses import replace

import pytest

from recollect.config import Settings
from recollect.operators import breaks, chunking

SEGS = "item_id string, seq long, text string, start double, end double"


def folded(rows, cfg):
    """{item: [(text, start, end)]} by the fold over each item's segments in order."""
    items = {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        items.setdefault(r[0], []).append(r[2:])
    out = {k: list(chunking.packed(v, cfg.chunk_chars, cfg.overlap_chars, cfg.max_seconds, cfg.min_passage)) for k, v in items.items()}
    return {k: v for k, v in out.items() if v}


def made(spark, rows, cfg, block):
    got = {}
    for r in chunking.chunk_segments(spark.createDataFrame(rows, SEGS), cfg, block).orderBy("item_id", "ordinal").collect():
        own = got.setdefault(r.item_id, [])
        assert r.ordinal == len(own)
        own.append((r.text, r.start, r.end))
    return got


def segments(rng, item, n, longest=12, ordered=True):
    """n segments: words of one character upwards, now and then none, now and then longer than a passage."""
    rows, at = [], 0.0
    for k in range(n):
        size = rng.choice([1, 2, rng.randint(1, longest), rng.randint(1, longest), rng.randint(50, 90) if rng.random() < 0.05 else 3])
        text = rng.choice([None, "", " ​ "]) if rng.random() < 0.05 else "".join(rng.choice("abcdé ﬁ") for _ in range(size))
        at = at + rng.choice([0.0, 1.0, 2.5]) if ordered else rng.uniform(0, 200)
        rows.append((item, k, text, None if rng.random() < 0.05 else at, rng.choice([None, 0.0, at + 2])))
    return rows


@pytest.mark.parametrize("overlap,seconds,ordered", [(8, 20.0, True), (0, 20.0, True), (60, 1e9, True), (8, 30.0, False)])
def test_as_the_fold(spark, overlap, seconds, ordered):
    """One item with most of the rows, over some twenty blocks, between short ones."""
    rng = random.Random(overlap + ordered)
    cfg = replace(Settings(), chunk_chars=40, overlap_chars=overlap, max_seconds=seconds, min_passage=4)
    rows = segments(rng, "m", 900, ordered=ordered) + [r for k in range(60) for r in segments(rng, f"{k % 2 and 'a' or 'z'}{k}", rng.randint(0, 9), ordered=ordered)]
    rows += segments(rng, None, 70, ordered=ordered)
    rng.shuffle(rows)
    want = folded(rows, cfg)
    assert made(spark, rows, cfg, 41) == want and made(spark, rows, cfg, 16_384) == want
    assert len(want["m"]) > 60


def test_states_that_never_meet(spark):
    """Segments of one length: passages begun at different segments stay apart, so that every block keeps all its states."""
    cfg = replace(Settings(), chunk_chars=40, overlap_chars=7, max_seconds=1e9, min_passage=1)
    rows = [("a", k, "wxyz", float(k), float(k + 1)) for k in range(1500)]
    run = breaks.Run([4] * 200, [0.0] * 200, [0.0] * 200, 40, 7, 1e9)
    assert len(set(run.leaves(run.entries(50), 150).values())) > 4
    assert made(spark, rows, cfg, 41) == folded(rows, cfg)


def test_order_and_bounds(spark):
    """Equal seq go by start; nothing gives nothing; a block that a passage may outgrow is refused."""
    cfg = replace(Settings(), chunk_chars=9, overlap_chars=0, min_passage=1)
    assert made(spark, [("a", 1, "second", 2.0, 3.0), ("a", 1, "first", 1.0, 2.0)], cfg, 64) == {"a": [("first", 1.0, 2.0), ("second", 2.0, 3.0)]}
    assert made(spark, [], cfg, 64) == {} and made(spark, [("a", 1, None, None, None)], cfg, 64) == {}
    with pytest.raises(ValueError):
        made(spark, [], cfg, 9)


def test_blocks_are_even(spark):
    """An item of nearly all rows fills its blocks like any other rows: none holds more than a block and its surroundings."""
    rows = spark.range(5000).selectExpr("if(id < 4800, 'hot', cast(id as string)) item_id", "id seq", "'ab' text", "0.0D start", "0.0D end", "2 size")
    sizes = breaks.in_blocks(breaks.numbered(rows), 500, 8, 41).groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) <= 500 + 8 + 41 and len(sizes) >= 10
    assert breaks.numbered(rows).selectExpr("count(distinct pos) n", "min(pos) a", "max(pos) z").first()[:] == (5000, 0, 4999)
