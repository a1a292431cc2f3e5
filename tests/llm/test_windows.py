"""Substring dedup, quality rules and the classifier."""

import random
from collections import Counter

import numpy as np
import pytest
from cases import ODD
from pyspark.sql import functions as F
from test_copies import SPACE, words

from recollect.llm import quality, rules, windows
from recollect.llm.windows import FingerprintIndex, covered, stretches, substring_dedup
from recollect.operators.manifest import Conflict


def brute_windows(rows, w, key=None):
    texts = [words(t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = {k for j in range(len(t) - w + 1) if seen[tuple(t[j : j + w])] > 1 for k in range(j, j + w)}
        out.append((i, len(t), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone)))
    return sorted(out, key=key)


def passages(seed, n, w, shared=5):
    r = random.Random(seed)
    common = [[f"c{r.randrange(300)}" for _ in range(r.randrange(w - 3, 2 * w))] for _ in range(shared)]
    rows = []
    for i in range(n):
        t = [f"u{r.randrange(50)}" for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = r.choice(common)
        if r.random() < 0.1:
            t = t + ["rep"] * r.randrange(60)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(t)))
    return rows


@pytest.mark.parametrize("rows", [[r for r in ODD if r[0] != 5], ODD, [], passages(1, 150, 35)])
def test_windows(table, rows):
    assert sorted(map(tuple, substring_dedup(table(rows)).collect())) == brute_windows(rows, 35)


@pytest.mark.parametrize("batches", [1, 3])
def test_small_windows(table, batches):
    rows = passages(2, 200, 6)
    got = substring_dedup(table(rows), window=6, gram=3, batches=batches, most_log2_bits=17)
    assert sorted(map(tuple, got.collect())) == brute_windows(rows, 6)


def test_batches_meet_history(spark, table):
    """Each batch loses what it shares with itself and with all batches before it; in the end the index knows what one batch would show."""
    rows = passages(3, 120, 35) + [(200, " ".join(f"h{i}" for i in range(60)))]
    index = FingerprintIndex(spark, most_runs=2)
    for k in range(4):
        past, now = [r for j in range(k) for r in rows[j::4]], rows[k::4]
        got = substring_dedup(table(now), batches=1, index=index)
        ids = [i for i, _ in now]
        assert sorted(map(tuple, got.collect())) == [r for r in brute_windows(past + now, 35) if r[0] in ids]
    whole = {(r.hash, r.stretch): r.n for r in stretches(table(rows)).groupBy("hash", "stretch").agg(F.sum("n").alias("n")).collect()}
    assert {(r.hash, r.stretch): r.n for r in index.merged().collect()} == whole
    assert len(index.runs) == 1 and len(index.marks) == 1
    # nothing but history: all that windows cover goes, and so it does in another session
    again = FingerprintIndex(spark, index.root, index.corpus)
    got = substring_dedup(table([(900, rows[-1][1]), (901, "h1 h2 h3")]), index=again).collect()
    assert sorted(map(tuple, got)) == [(900, 60, 60, ""), (901, 3, 0, "h1 h2 h3")]


def test_runs_are_sorted_merged_and_removed(spark, table):
    import os

    index = FingerprintIndex(spark, window=6, gram=3)
    rows = passages(5, 60, 6)
    for k in range(3):
        index.add(table(rows[k::3]))
    plan = index.met(index.runs[-1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    root, old = index.root.removeprefix("file:"), list(index.runs)
    assert all(os.path.isdir(f"{root}/{r}") for r in old)
    index.compact()
    # what the commit before holds stays until the next one
    assert not set(old) & set(index.runs) and len(index.runs) == len(index.marks) == 1 and set(old) < set(os.listdir(root))
    index.add(table(rows[:5]))
    assert sorted(n for n in os.listdir(root) if n[0] != "_") == sorted(index.runs + index.marks)
    index.drop()
    assert not os.path.exists(root)


def test_reopening(spark, table, tmp_path):
    """Another number of partitions changes nothing; what doesn't fit, or can't be verified, raises; a run that dies leaves an index."""
    rows = passages(6, 60, 35)
    root, source = str(tmp_path / "index"), str(tmp_path / "docs")
    table(rows).write.parquet(source)
    first = FingerprintIndex(spark, root, buckets=8)
    first.add(spark.read.parquet(source), source)
    first._forget(first.runs)  # as in a new session
    copies = [(500 + i, t) for i, t in rows]
    want = [r for r in brute_windows(rows + copies, 35) if r[0] >= 500]
    again = FingerprintIndex(spark, root)
    assert again.buckets == 8
    assert sorted(map(tuple, substring_dedup(table(copies), index=again).collect())) == want
    for wrong in ({"buckets": 4}, {"window": 30}, {"gram": 9}):
        with pytest.raises(ValueError):
            FingerprintIndex(spark, root, **wrong)
    with pytest.raises(ValueError):
        FingerprintIndex(spark, root)  # the copies have no source
    with pytest.raises(Conflict):
        first.add(table(rows[:2]))  # another writer came first

    whole = table(rows + copies)
    index = FingerprintIndex(spark, root, whole)
    index.add(table([(900, "one more")]))
    held = index.manifest.read()

    def dies(*_):
        raise RuntimeError("the driver is gone")

    index._commit = dies
    with pytest.raises(RuntimeError):
        index.compact()  # merged, but not committed
    index = FingerprintIndex(spark, root, whole)
    assert (index.version, index.runs) == (held[0], held[1]["runs"])
    assert [tuple(r)[1:3] for r in substring_dedup(table([(901, rows[-1][1])]), batches=1, index=index).collect()] == [(n := len(words(rows[-1][1])), n if n >= 35 else 0)]
    assert index.manifest.orphans(set(index.runs + index.marks))  # what the run that died has left


def test_masses_of_one_text_and_of_one_passage(table):
    common = " ".join(f"m{i}" for i in range(60))
    rows = [(i, common) for i in range(60)] + [(100 + i, f"a{i} b{i} {common} c{i} d{i}") for i in range(60)] + [(300, " ".join(f"o{i}" for i in range(50)))]
    rows += [(None, common), (None, "x " * 40), (7, "y " + common)]
    assert sorted(map(str, map(tuple, substring_dedup(table(rows)).collect()))) == sorted(map(str, brute_windows(rows, 35, key=str)))


def test_word_hashes_and_least_places(monkeypatch):
    """Equal words, and only they, hash alike wherever they stand, also across blocks; the least place is the first of the least."""
    r = random.Random(12)
    texts = ["".join(r.choice(["a", "b", "ab", "é", "漢", " ", "\n", "\x0b", "\xa0", "\x85", "z" * 90]) for _ in range(r.randrange(200))).encode() for _ in range(200)] + [b"", b" ", b"x"]
    want: dict = {}
    for block in (1 << 20, 64):
        monkeypatch.setattr(windows, "BLOCK", block)
        hasher = windows.Hasher(35, 8)
        for t in texts:
            got = hasher.hashes(t).tolist()
            assert len(got) == len(t.split())
            for w, h in zip(t.split(), got, strict=True):
                if len(w) <= 64:  # a word of more than a block has another hash
                    assert want.setdefault(w, h) == h
    assert len(set(want.values())) == len(want)
    for n in (28, 29, 200):
        x = np.array([r.randrange(9) for _ in range(n)], np.uint64)
        for width in (1, 2, 7, 28):
            at = windows.Hasher(35, 8).least(x, width)
            assert at.tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(n - width + 1)]


def test_spans_cover():
    spans = [{"a": 2, "n": 3, "mask": -1}, {"a": 9, "n": 4, "mask": 0b1011}]
    want = {k for a in (2, 3, 4, 9, 10, 12) for k in range(a, a + 5)}
    assert set(np.flatnonzero(covered(spans, 30, 5)).tolist()) == want


def brute_rules(t):
    w = words(t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def test_rules(table):
    r = random.Random(6)
    rows = ODD + [(100 + i, r.choice([" ", "\n", "\t "]).join(r.choice(["a", "b", "é|", "##", "x"]) for _ in range(r.randrange(40)))) for i in range(200)]
    rows += [(400, "SHOUT!! " * 3 + "LOUD!! NOISE!! EVERY!! WHERE!! MORE!! AND!! AGAIN!! END!!"), (401, " ".join(f"word{i}" for i in range(60)))]
    got = rules.quality_rules(table(rows)).collect()
    assert sorted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == sorted((i, *brute_rules(t)) for i, t in rows)
    assert all(x.kept == (x.rejected_by is None) and not (x.base_failed and x.kept) for x in got)
    by = {x.doc_id: x for x in got}
    assert not by[400].kept and by[401].kept and not by[5].kept
    assert rules.quality_rules(table([])).count() == 0


def test_order_never_changes_verdicts(table, monkeypatch):
    docs = table(ODD)
    want = {(x.doc_id, x.kept) for x in rules.quality_rules(docs).collect()}
    assert {(x.doc_id, True) for x in rules.quality_rules(docs, counts=False).where("kept").collect()} == {x for x in want if x[1]}
    monkeypatch.setattr(rules, "ordered", lambda docs, rules, n: rules[::-1])
    assert {(x.doc_id, x.kept) for x in rules.quality_rules(docs).collect()} == want


def test_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] < -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for k in range(20):  # one row, one tree at a time
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(x[k, f[at]] > c[at])
            total += leaf[at - len(f)]
        assert abs(model.scores(x[k : k + 1])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert model.scores(x[:0]).shape == (0,)


def test_quality(spark, table):
    import zlib

    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(80)) if i % 2 else "buy!! " * r.randrange(20, 90)) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table(rows), labels, trees=10).collect()
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(x.predicted == x.doc_id % 2 for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    odd = quality.quality_scores(table(ODD), labels, trees=5).collect()
    assert sorted(x.doc_id for x in odd) == sorted(i for i, _ in ODD)
    assert quality.quality_scores(table([]), labels, trees=2).count() == 0
    assert quality.quality_scores(table(ODD), labels.limit(0), trees=2).count() == len(ODD)
