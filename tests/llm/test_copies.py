"""Sharding, line dedup, SimHash, components, decontamination against brute force."""

import random
import zlib

import numpy as np
import pytest
from cases import ODD

from recollect.llm import decontam, simhash
from recollect.llm.components import components
from recollect.llm.lines import line_dedup
from recollect.llm.sharding import balanced_shards

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    for c in SPACE:
        s = s.replace(c, " ")
    return [w for w in s.split(" ") if w]


@pytest.mark.parametrize("rows", [ODD, [], [(5, "hot")] * 300 + [(6, "cold")]])
def test_shards(table, rows):
    got = balanced_shards(table(rows), 4).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    total, start, want = sum(len((t or "").encode()) + 8 for _, t in rows), 0, []
    from collections import Counter

    shards = Counter()
    for size, crc in [(r.size, r.text_crc32) for r in sorted(got, key=lambda r: (r.shard, r.slot))]:
        shard = min(3, (2 * start + size) * 4 // (2 * total))
        want.append((shard, shards[shard], size, crc))
        shards[shard] += 1
        start += size
    assert sorted((r.shard, r.slot, r.size, r.text_crc32) for r in got) == want
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    in_order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def brute_lines(rows):
    from collections import defaultdict

    key = lambda x: lower(x.strip(SPACE))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) > 1 and i > min(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("rows", [ODD, [], [(i, f"a line all share\nown line {i}\nten chars!\nnine char") for i in range(200)], [(1, "exactly 10"), (2, "EXACTLY 10\x0b"), (3, "9 chars__"), (4, "9 chars__"), (5, "ééééééééé"), (6, "ééééééééé"), (7, "éééééééééé"), (8, "éééééééééé")]])
@pytest.mark.parametrize("keys", [None, 1])
def test_lines(table, rows, keys):
    got = line_dedup(table(rows), keys_expected=keys, most_log2_bits=17).collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


def brute_fingerprint(text, n):
    import xxhash

    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_near(rows, n, d):
    fp = [brute_fingerprint(t, n) for _, t in rows]
    root = roots(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= d])
    low = {}
    for i, r in root.items():
        low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], fp[i], low[root[i]]) for i in root)


def edited(seed, n):
    """Documents of a few families, each with words changed here and there."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = random.Random(r.randrange(6))
        w = [f"w{base.randrange(500)}" for _ in range(base.randrange(20, 200))]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("rows", [ODD, [], edited(3, 160)])
def test_near(table, rows):
    got = simhash.near_duplicates(table(rows)).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == brute_near(rows, 3, 3)


def test_links_in_chunks(spark):
    """A hot block that is cut into chunks loses no link."""
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << r.randrange(30) for _ in range(r.randrange(6))) for b in base for _ in range(120)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    for chunk in (7, 4096):
        edges = simhash.links(df, 3, chunk)
        root = {x.node: x.root for x in components(edges).collect()}
        assert {n: root.get(n, n) for n in signed} == want


def test_masks():
    for n in (1, 10**5, 10**10):
        ms = simhash.masks(n, 3)
        r = random.Random(n)
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not d & m & (2**64 - 1) for m in ms)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    want = roots({x for e in edges for x in e}, edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in want.items() if n != m}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars():
    from recollect.llm.components import stars

    r = random.Random(1)
    for n in (1, 5, 60):
        a, b = (np.array([r.randrange(-40, 40) for _ in range(n)], np.int64) for _ in range(2))
        up = {k: k for k in {*a.tolist(), *b.tolist()}}
        for _ in range(100):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[x] = up[y] = min(up[x], up[y])
        got = dict(zip(*(x.tolist() for x in stars(a, b)), strict=True))
        assert got == {k: v for k, v in up.items() if k != v}


def best(p, t):
    """The least edit distance of p to any substring of t: the whole table, one row for each character of p."""
    codes, steps = np.array(list(map(ord, t)), np.int64), np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, a in enumerate(p, 1):
        here = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(a)))
        row = np.minimum.accumulate(np.concatenate(([i], here)) - steps) + steps
    return int(row.min())


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randrange(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randrange(0, 120)))
        for most in (0, 3, 100):
            assert decontam.myers(p, t, most) == min(best(p, t), most + 1)


def test_decontaminate(spark, table):
    r = random.Random(4)
    items = [(k, " ".join(f"{r.choice('bcdfg')}{r.randrange(900)}{r.choice('aeiou')}" for _ in range(20))) for k in range(30)] + [(98, None), (99, "  "), (100, "x")]
    rows = list(ODD)
    for i in range(100, 180):
        text = [f"filler{r.randrange(10**6)}" for _ in range(30)]
        item = list(items[r.randrange(30)][1])
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice(["", "Z", "qq"])
        text.insert(r.randrange(30), "".join(item).replace(" ", r.choice([" ", "\n", "  "])).upper())
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        n = decontam.normal(t or "")
        own = [(k, best(decontam.normal(x or ""), n)) for k, x in items if x and x.strip()]
        own = [(k, d) for k, d in own if d <= int(0.05 * len(decontam.normal(dict(items)[k])))]
        want.append((i, [k for k, _ in own], [d for _, d in own], bool(own)))
    for block in (2_000_000, 500):
        got = decontam.decontaminate(table(rows), bench, block_chars=block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert decontam.decontaminate(table([]), bench).count() == 0
    assert not decontam.decontaminate(table(rows), bench.limit(0)).where("contaminated").count()
