"""Nulls, clashing names, extreme ids and long texts that an operator has to take."""

import random
import re
import time

import numpy as np
import pytest
from cases import LINE, ODD
from pyspark.sql import functions as F
from test_copies import brute_lines

from recollect.llm import decontam, pii, quality, rules, secrets, simhash
from recollect.llm.lines import line_dedup
from recollect.llm.sharding import balanced_shards

LEAST = -(2**63)


def test_lines_of_null_and_extreme_ids(table):
    """A null doc_id comes before all others, also before the least of them; rows without one count as one document."""
    rows = [(None, LINE), (None, f"{LINE}\nmine alone, of the null"), (LEAST, f"{LINE}\nonly here, but twice over"), (0, "only here, but twice over\nend"), (3, LINE)]
    got = sorted((str(r.doc_id), r.kept) for r in line_dedup(table(rows), carry=("key", "n")).collect())
    want = [("None", LINE), ("None", f"{LINE}\nmine alone, of the null"), (str(LEAST), "only here, but twice over"), ("0", "end"), ("3", "")]
    assert got == sorted(want)


def test_lines_only_losing_texts_move(table):
    rows = ODD + [(1000 + i, f"text {i} of its own, with a line\n" + (LINE if i % 3 else "")) for i in range(60)]
    got = line_dedup(table(rows), most_log2_bits=17)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows)


@pytest.mark.parametrize("name", ["found", "carried", "row", "verdict", "gone", "rejected_by_", "at", "_j"])
def test_clashing_carried_columns(spark, name):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon " * 3, "mine"), (None, None, None)], f"doc_id long, text string, `{name}` string")
    items = spark.createDataFrame([(9, "beta gamma delta")], "item_id long, text string")
    outs = [rules.quality_rules(docs, carry=(name,), sample_rows=10), line_dedup(docs, carry=(name,)), decontam.decontaminate(docs, items, carry=(name, "text")), decontam.decontaminate(docs, items.union(items), block_chars=5, carry=(name,))]
    for out in outs:
        assert {(r["doc_id"], r[name]) for r in out.collect()} == {(1, "mine"), (None, None)}


def test_null_ids_elsewhere(table):
    rows = [(None, "one two three four"), (None, "one two three four"), (4, "one two three four"), (5, "else entirely, and so on")]
    shards = balanced_shards(table(rows), 2).collect()
    assert len(shards) == 4 and [r.doc_id for r in sorted(shards, key=lambda r: (r.shard, r.slot))][:2] == [None, None]
    near = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(table(rows)).collect())
    assert near == [("4", 4), ("5", 5), ("None", 4), ("None", 4)]
    alone = simhash.near_duplicates(table([(None, "a b c"), (None, "a b c")])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)] * 2
    scored = quality.quality_scores(table(rows), table([]).select("doc_id", F.lit(1).alias("quality")), trees=2).collect()
    assert sum(r.doc_id is None and r.held_out is False for r in scored) == 2


def test_blocks_of_items_agree(spark, table):
    r = random.Random(5)
    items = [(k, " ".join(f"q{r.randrange(99)}" for _ in range(12))) for k in range(12)]
    rows = ODD + [(100 + i, f"start {items[i % 12][1]} end" if i % 2 else f"w{i} " * 20) for i in range(40)] + [(None, items[3][1] + " " + items[4][1])]
    bench = spark.createDataFrame(items + [(50, None), (51, " ")], "item_id long, text string")
    one, many = (sorted((str(r.doc_id), r.item_ids, r.distances) for r in decontam.decontaminate(table(rows), bench, block_chars=b).collect()) for b in (10**6, 60))
    assert one == many and sum(bool(x[1]) for x in one) == 21
    nodes = decontam.decontaminate(table(rows), bench, block_chars=60)._jdf.queryExecution().executedPlan().toString()
    assert nodes.count("MapInArrow") <= 3  # no chain of automata


# --- spans -------------------------------------------------------------------------------------------------------------


def test_long_schemes_and_cues_in_any_case():
    text = "microsoft-edge-holographic://a.b/c, 7x://d.e 7://f +a+1.b-2://g/h. aCCouNT No: 12345678, PassPort X1234567"
    spans = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find(text, pii.automaton()) if k > 3]
    assert spans == [("url", "microsoft-edge-holographic://a.b/c"), ("url", "x://d.e"), ("url", "a+1.b-2://g/h"), ("account", "12345678"), ("account", "X1234567")]


URL = re.compile(r"""([A-Za-z][A-Za-z0-9+.-]*)://[^\x00-\x20"'<>\\^`{|}]+""")


def test_urls_by_brute_force():
    """Each URL is what a plain pattern finds, without the marks at its end."""
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice(["http", "a+b", "://", "x.y/", "?q=1", " ", ".", "é", ")", "7", '"', "ftp://h"]) for _ in range(r.randrange(14)))
        want, at = [], 0
        while m := URL.search(text, at):
            end = m.start() + len(m[0].rstrip(".,;:!?)]"))
            if end > m.end(1) + 3:
                want.append((m.start(), end))
                at = end
            else:
                at = m.end(1) + 3
        assert [(s, e) for s, k, e in pii.find(text, pii.automaton()) if k == 4] == want, text


def test_secrets_take_time_in_proportion(spark):
    """Many matches in one text: eight times as many take about eight times as long."""

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"{i:016x}" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.secret_scan(docs).select(F.size("base").alias("n"), F.element_at("base", -1)["end"].alias("end")).first()
        assert (row.n, row.end) == (n, 17 * n - 1)
        return time.perf_counter() - began

    seconds(100)
    few = seconds(5_000)
    assert seconds(40_000) < 16 * few + 5


def test_before(spark):
    for n in (0, 1, 255, 256, 257, 1000, 70_000):
        sizes = np.random.default_rng(n).integers(0, 9, n).tolist()
        got = spark.createDataFrame([(sizes,)], "x array<int>").select(secrets.before(F.col("x")).alias("b")).first().b
        assert got == (np.cumsum(sizes) - sizes).tolist()


def tokens(r, n, kind, size):
    alphabet = {"hex": secrets.HEX_DIGITS, "base32": secrets.BASE32, "base64": secrets.BASE64}[kind]
    return ["".join(r.choice(alphabet) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hex", "base32", "base64"])
def test_p_values_are_calibrated(spark, kind):
    """Random tokens of any length: p-values lie as uniform ones would, and next to all tokens are tested."""
    r = random.Random(9)
    for size in (20, 32, 64, 200):
        rows = [(t,) for t in tokens(r, 1500, kind, size)]
        p = [x.p for x in spark.createDataFrame(rows, "v string").select(secrets.randomness(F.col("v"))["p"].alias("p")).collect()]
        assert sum(x is None for x in p) <= 0.005 * len(p)
        p = np.array([x for x in p if x is not None])
        for level in (0.05, 0.25, 0.5):
            assert abs((p < level).mean() - level) < 0.3 * level + 0.02, (size, level, (p < level).mean())


NATURAL = ["release", "notes", "Version", "page2", "intro", "chapter1", "the", "Index", "photo", "img", "2024", "summer", "final", "draft3", "Report"]


@pytest.mark.parametrize("n", [10, 300, 4000])
def test_false_discoveries_and_power(spark, n):
    """Of planted random tokens most are found, in small tables as in large ones, and few natural ones pass for random."""
    r = random.Random(n)
    hidden = [(i, "key " + t) for i, t in enumerate(tokens(r, n, "base64", 40) if n < 20 else tokens(r, n // 2, "base64", 40) + tokens(r, n // 2, "hex", 40))]
    natural = [(10**6 + i, "see " + "-".join(r.choice(NATURAL) for _ in range(7))[:40].rstrip("-")) for i in range(4 * n)]
    docs = spark.createDataFrame(hidden + natural, "doc_id long, text string")
    found = {x.doc_id for x in secrets.secret_scan(docs).where(F.exists("spans", lambda s: s["kind"] == 3)).select("doc_id").collect()}
    real = sum(i < 10**6 for i in found)
    assert real >= 0.85 * len(hidden)
    assert len(found) - real <= max(1, 0.1 * len(found))


def test_thresholds_move_by_degrees():
    """No step at any number of tokens: one more token never moves a threshold by more than a bin or two."""
    last = None
    for n in range(0, 2000, 7):
        now = secrets.thresholds({(3, 0): 4 * n + 1, (3, 1): n, **{(3, k): n // 20 for k in range(2, secrets.BINS)}}, 0.05)[3]
        assert now <= 0.5 and (last is None or abs(now - last) <= 2 / secrets.BINS)
        last = now
    assert secrets.thresholds({(3, 5): 1}, 0.05)[3] == 0.05


# --- classifier and rules ------------------------------------------------------------------------------------------------


def test_features_by_plain_counting():
    """Each statistic counted once more, byte by byte and word by word."""
    import math
    from collections import Counter

    for text in ["", "a", "One two, two THREE!\n\nfour | 5 #\nOne two, two THREE!", "naïve 漢字 café " * 3, "x " * 500]:
        raw = text.encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n, size = len(words), max(1, len(raw))
        share = lambda test: sum(map(test, raw)) / size  # noqa: E731, B023
        mean = sum(map(len, words)) / n if n else 0.0  # noqa: B023
        pairs = list(zip(words, words[1:], strict=False))
        want = {
            "bytes": math.log(1 + len(raw)), "words": math.log(1 + n), "mean_word": mean, "spread_word": math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n) if n else 0.0,
            "distinct_words": len(set(words)) / max(1, n), "upper": share(lambda c: 65 <= c <= 90), "digits": share(lambda c: 48 <= c <= 57), "stops": share(lambda c: chr(c) in ".,;:"),
            "symbols": share(lambda c: chr(c) in "#*$%&<>"), "bangs": share(lambda c: chr(c) in "!?"), "bars": share(lambda c: chr(c) == "|"), "other_ascii": share(lambda c: chr(c) in "\"'()+-/=@[\\]^_`{}~"),
            "beyond_ascii": share(lambda c: c > 127), "spaces": share(lambda c: chr(c) in " \t\n\x0b\x0c\r"), "lines": len(lines) / max(1, n), "duplicate_lines": 1 - len(set(lines)) / max(1, len(lines)),
            "top_word": max(Counter(words).values(), default=0) / max(1, n), "same_neighbours": sum(a == b for a, b in pairs) / max(1, n), "distinct_pairs": len(set(pairs)) / max(1, n - 1),
            "entropy": -sum(k / size * math.log2(k / size) for k in Counter(raw).values()), "longest_word": math.log(1 + max(map(len, words), default=0)),
        }
        assert list(want) == list(quality.FEATURES)
        assert quality.features(raw) == pytest.approx(list(want.values()), abs=1e-12)


def test_fit_takes_the_best_split():
    """One tree of depth one: no other feature and cut would lower the loss more."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 4] + 0.3 * r.normal(size=300) > 0.4).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    p = np.clip(y.mean(), 0.01, 0.99)
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda right: sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (right, ~right))
    cuts = [(j, c) for j in range(x.shape[1]) for c in np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])]
    best = max(cuts, key=lambda jc: gain(x[:, jc[0]] > jc[1]))
    assert model.feature[0, 0] == best[0] and model.cut[0, 0] == pytest.approx(best[1])
    right = x[:, best[0]] > best[1]
    for leaf, m in zip(model.leaf[0], (~right, right), strict=True):
        assert leaf == pytest.approx(0.1 * g[m].sum() / (h[m].sum() + 1.0))


def test_the_sample_is_even_and_order_follows_worth(table):
    rows = [(i, "plain words that read well enough, all told, and go on for a while " + f"n{i}") for i in range(400)] + [(1000 + i, "#" * 60 + f" a{i}") for i in range(100)]
    docs = table(rows)
    sample = [r.text for r in rules.sampled(docs, 100).collect()]
    assert len(sample) == 100 and 5 <= sum("#" in t for t in sample) <= 40
    names = [r.name for r in rules.ordered(docs, rules.BASE_RULES + rules.MORE_RULES, 200, clear=0.02)]
    assert set(names[:2]) & {"few_words", "symbols"} and len(names) == 8
