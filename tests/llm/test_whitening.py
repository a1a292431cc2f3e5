"""Whitening against numpy's full eigendecomposition, exact sums and odd rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from recollect.llm import whitening as H

SCHEMA = "vec_id long, embedding array<double>, label int, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 7) for i, v in rows], SCHEMA).repartition(parts)


def check(got, rows, k):
    own = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(own), len(own[0][1])
    sums = [sum(v[j] for _, v in own) for j in range(d)]
    far = sorted((i, sum((n * a - b) ** 2 for a, b in zip(v, sums))) for i, v in own)
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, sums)] for _, v in own])
    e, q = np.linalg.eigh(x.T @ x / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    out = got.collect()
    assert len(out) == n * k and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, k + 1))
    assert sorted((r.vec_id, int(r.deviation)) for r in out if r.component == 1) == far
    errors = {r.identity_error for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-8
    w = x @ q[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        assert {round(r.explained / (e[c] / e.sum()), 9) for r in out if r.component == c + 1} == {1.0}
        mine = sorted((r.vec_id, r.whitened) for r in out if r.component == c + 1)
        want = sorted((i, v) for (i, _), v in zip(own, w[:, c]))
        a, b = np.array([v for _, v in mine]), np.array([v for _, v in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


@pytest.mark.parametrize("width, k", [(40, 12), (6, 32), (64, 32)])
def test_against_numpy(spark, monkeypatch, width, k):
    monkeypatch.setattr(H, "PACK", 100)
    r = np.random.default_rng(width)
    x = r.normal(size=(900, width)) * np.linspace(3, 1, width) @ np.linalg.qr(r.normal(size=(width, width)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(H.whiten(frame(spark, rows), k), rows, k)


def test_one_direction_far_above_the_others(spark):
    """As where a third of the rows are near copies."""
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 48)) * 0.1
    x[:200] = r.normal(size=48) * 20 + r.normal(size=(200, 48)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(H.whiten(frame(spark, rows), 16), rows, 16)


def test_leading_finds_clusters_and_low_ranks():
    r = np.random.default_rng(4)
    for values in (np.linspace(1, 2, 60), np.r_[1e6, np.linspace(1, 1.001, 59)], np.r_[np.geomspace(1e9, 1, 20), np.zeros(40)], np.r_[np.ones(60)]):
        q = np.linalg.qr(r.normal(size=(60, 60)))[0]
        v = q * values @ q.T
        e, u = H.leading(lambda y, v=v: v @ y, 60, 10)
        want = np.sort(values)[::-1][:10]
        assert np.abs(e - want).max() < 1e-11 * want[0] and np.abs(u.T @ u - np.eye(10)).max() < 1e-12
        assert np.abs(v @ u - u * e).max() < 1e-10 * want[0]


def test_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [rows[0], rows[0]] + [(200 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(30)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [1.0, float("nan"), 1.0, 1.0]), (103, [float("-inf"), 1.0, 1.0, 1.0]), (104, [])]
    check(H.whiten(frame(spark, rows)), rows, 32)
    assert H.whiten(frame(spark, [], 1)).collect() == []
    assert H.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = [(i, [float(i), 3.0, 2.0 * i]) for i in range(20)]
    check(H.whiten(frame(spark, flat)), flat, 32)  # one direction alone has variance
    none = H.whiten(frame(spark, [(None, [1.0, 2.0]), (2, [3.0, 2.5])])).collect()
    assert {x.vec_id for x in none} == {None, 2}
    with pytest.raises(Exception, match="components"):
        H.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0])])).collect()


def test_sums_beyond_64_bits():
    x = np.array([[2**62, -(2**61)], [2**62, 5]])
    assert H.total(x) == [2**63, 5 - 2**61]
    assert H.squares(np.array([[2**40, 1]])) == [2**80 + 1]
    assert H.numerators(np.array([[2**50, 1]]), 2**20, [1, 2]).tolist() == [[2**70 - 1, 2**20 - 2]]
