"""Cover trees and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import covertree, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, x string"
DIVISIBLE = "vec_id % 100 = 0"


def brute(rows, step=100, k=5, m=10):
    own = [(i, l, [math.floor(256 * c) for c in v]) for i, v, l in rows if l is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (i, l, v) in enumerate(own):
        if i is None or i % step:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), last(j), j, g) for b, (j, g, w) in enumerate(own) if b != a]
        scored.sort(key=lambda x: x[:2])
        for p, _, j, _ in [x for x in scored if x[3] == l][:k]:
            fit = [x for x in scored if x[3] != l and 30 * -p <= 100 * -x[0] <= 90 * -p][:m]
            out += [(i, j, r, x[2], -p, -x[0]) for r, x in enumerate(fit, 1)]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, l, 7, "x") for i, v, l in rows], SCHEMA).repartition(parts)


def clustered(seed, n=700, d=6, labels=4, spread=0.3):
    r = random.Random(seed)
    homes = [[r.gauss(0, 1) for _ in range(d)] for _ in range(labels * 2)]
    rows = []
    for i in range(n):
        h = r.randrange(len(homes))
        rows.append((i, [c + r.gauss(0, spread) for c in homes[h]], h % labels))
    return rows


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("pack, sample", [(2048, 2048), (50, 20)])
def test_against_brute_force(spark, monkeypatch, pack, sample):
    monkeypatch.setattr(negatives, "PACK", pack)
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    for spread in (0.3, 2.0):
        rows = clustered(3, spread=spread)
        want = brute(rows)
        assert len(want) > 100
        same(negatives.hard_negatives(frame(spark, rows), DIVISIBLE), want)


def test_odd_rows(spark):
    """Ties, copies, rows that take no part, null ids, labels with one row, and a vector that a third of the rows share."""
    r = random.Random(4)
    rows = [(i, [1.0, 2.0, 0.5], i % 3) for i in range(100)]
    rows += [(100 + i, [r.gauss(0, 1) for _ in range(3)], r.randrange(3)) for i in range(201)]
    rows += [(0, [1.0, 2.0, 0.5], 0), (200, [0.1, 0.2, 0.3], 77), (None, [1.0, 1.9, 0.4], 1), (None, [3.0, 1.0, 1.0], None)]
    rows += [(300, None, 1), (400, [1.0, None, 2.0], 1), (500, [1.0, float("nan"), 2.0], 1), (600, [1.0, float("inf"), 2.0], 1), (700, [], 1), (800, [0.0, 0.0, 0.0], 1)]
    same(negatives.hard_negatives(frame(spark, rows), DIVISIBLE), brute(rows))
    empty = negatives.hard_negatives(frame(spark, [], 1), DIVISIBLE)
    assert empty.collect() == [] and len(empty.columns) == 6
    assert negatives.hard_negatives(frame(spark, [(0, [1.0], 1)]), DIVISIBLE).collect() == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(frame(spark, [(0, [1.0], 1), (1, [1.0, 2.0], 1)]), DIVISIBLE)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(3 * i), 1.0], i % 2) for i in range(0, 120)]
    same(negatives.hard_negatives(frame(spark, rows), DIVISIBLE), brute(rows))


def test_queries_beyond_the_broadcast(spark):
    rows = clustered(5, n=300)
    own = negatives.vectors(frame(spark, rows))
    trees = negatives.forest(own)
    asked = own.where(DIVISIBLE).withColumn("scores", F.array().cast("array<long>"))
    seek = lambda row, label, _: covertree.Positives(row, label, 5)
    a, b = (negatives.best(negatives.searched(trees, asked, seek, 6, True, block=1, most_broadcast=m), 5) for m in (0, 100))
    same(a, list(map(tuple, b.collect())))


def test_balls_hold_what_they_cover():
    r = np.random.default_rng(1)
    for n, d in ((1, 3), (15, 2), (900, 3), (900, 40)):
        x = np.floor(r.normal(size=(n, d)) * r.uniform(1, 300, (n, 1))).astype(np.int64)
        x[n // 2 :] = x[: n - n // 2] if n % 2 == 0 else x[n // 2 :]  # copies
        t = covertree.build(x, np.arange(n), np.arange(n), np.arange(n) % 3)
        w = covertree.augmented(t.x)
        assert sorted(t.ids.tolist()) == list(range(n)) and (x[t.ids] == t.x).all()

        def below(k):
            out = list(range(t.own[k], t.own[k + 1]))
            for c in range(t.child[k], t.child[k + 1]):
                out += below(c)
            return out

        for k in range(len(t.centre)):
            mine = below(k)
            assert t.centre[k] in mine
            assert np.sqrt(((w[mine] - w[t.centre[k]]) ** 2).sum(axis=1)).max() <= t.radius[k]
            apart = t.centre[t.child[k] : t.child[k + 1]]
            for c in apart:
                others = apart[apart != c]
                assert not len(others) or np.sqrt(((w[others] - w[c]) ** 2).sum(axis=1)).min() > t.radius[k] / 2 * (1 - 1e-6) - 1e-6
        assert sorted(below(0)) == list(range(n))


def test_windows_skip_nodes():
    """In data with structure, far fewer points are met than there are."""
    r = np.random.default_rng(2)
    homes = r.normal(size=(40, 8)) * 300
    x = np.floor(np.repeat(homes, 50, axis=0) + r.normal(size=(2000, 8)) * 10).astype(np.float64)
    labels = np.repeat(np.arange(40), 50)
    t = covertree.build(x, np.arange(2000), np.arange(2000), labels)
    met = 0
    for a in range(0, 2000, 100):
        q = x[a]
        s = np.sort(x[labels == labels[a]] @ q)[::-1]
        met += covertree.descend(t, q, float(np.sqrt(q @ q)) * (1 + 1e-9), covertree.Negatives(labels[a], [(int(s[1] * 0.3), int(s[1] * 0.9))], 10))
    assert met < 20 * 2000 * 0.25
