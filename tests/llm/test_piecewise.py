"""Piecewise fingerprints against a byte-by-byte version, and likeness against plain dynamic programming."""

import hashlib
import random

import numpy as np
import pytest
from cases import ODD

from recollect.llm import piecewise as P


def mixed(x):
    return int(P.mix(np.array([x % 2**64], np.uint64))[0])


def brute_print(text: bytes) -> str:
    if not text:
        return "0" + ":" * P.LEVELS
    letter = [mixed((b + 1) * P.BASE) for b in range(256)]
    zeros = []
    for i in range(len(text)):
        h = mixed(sum(letter[text[j]] * pow(P.BASE, j - i, 2**64) for j in range(max(0, i - P.SPAN + 1), i + 1)))
        zeros.append(64 if not h else (h & -h).bit_length() - 1)
    level = next(k for k in range(66) if sum(z >= k for z in zeros) < P.PIECES)
    digits = bytes(P.DIGITS).decode()
    out = [str(level)]
    for k in range(level, level + P.LEVELS):
        symbols, start = "", 0
        for i, z in enumerate(zeros):
            if z >= k or i == len(text) - 1:
                h = mixed(sum(letter[text[j]] * pow(P.BASE, j - start, 2**64) for j in range(start, i + 1))) >> 52
                symbols += digits[h >> 6] + digits[h & 63]
                start = i + 1
        out.append(symbols)
    return ":".join(out)


def brute_common(a, b):
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    if not x or not y:
        return float(x == y)
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(new[-1], row[j + 1]))
        row = new
    return 2 * row[-1] / (len(x) + len(y))


def texts():
    r = random.Random(5)
    out = [b"", b"a", b"abc", b"a" * 500, b"ab" * 300, bytes(range(256)) * 2, "naïve 漢字 🙂 ".encode() * 30]
    return out + [bytes(r.randrange(97, 110) for _ in range(r.randrange(1, 900))) for _ in range(25)]


@pytest.mark.parametrize("block", [1 << 18, 64, 7])
def test_fingerprints_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    own = P.Pieces()
    for t in texts():
        assert own.fingerprint(t) == brute_print(t)
        assert all(len(s) <= 2 * P.PIECES for s in own.fingerprint(t).split(":")[1:])


def test_common_against_brute_force():
    r = random.Random(6)
    for _ in range(200):
        a, b = ("".join(r.choice(["AA", "AB", "zz", "90"]) for _ in range(r.randrange(0, 30))) for _ in range(2))
        assert P.common(a, b) == pytest.approx(brute_common(a, b))


def test_likeness_follows_what_is_shared():
    r = random.Random(7)
    own = P.Pieces()
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    for n in (40, 400, 9000):
        a, b = (" ".join(word() for _ in range(n)) for _ in range(2))
        one = a[: len(a) // 2] + "X" + a[len(a) // 2 :]
        half = a[: len(a) // 2] + b[: len(a) // 2]
        p = own.fingerprint(a.encode())
        assert P.likeness(p, p) == 1
        assert P.likeness(p, own.fingerprint(one.encode())) > 0.85
        assert 0.3 < P.likeness(p, own.fingerprint(half.encode())) < 0.7
        assert P.likeness(p, own.fingerprint(b.encode())) < 0.1
        assert P.likeness(p, own.fingerprint((a + b).encode())) > 0.4
        assert P.likeness(p, own.fingerprint(b"")) == 0
    assert P.likeness(own.fingerprint(b""), own.fingerprint(b"")) == 1


def brute_rows(rows):
    """Rows (doc_id, text) in the order of the operator, then each against the next."""
    own = P.Pieces()
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        f, g, h = (own.fingerprint(x.encode()) for x in (t, e, n))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, P.likeness(f, g), P.likeness(f, h)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edited_fingerprints(table, parts):
    r = random.Random(8)
    rows = [(i, t) for i, t in dict(ODD).items()] + [(100 + i, " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randrange(80)))) for i in range(30)] + [(None, "no number")]
    want = brute_rows(sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0))))
    got = P.edited_fingerprints(table(rows), parts)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(x.doc_id, x.fingerprint) for x in P.fingerprints(table(rows)).collect()} == {(x[0], x[3]) for x in want}


def test_few_rows_and_repeated_ones(table):
    assert P.edited_fingerprints(table([])).collect() == []
    one = P.edited_fingerprints(table([(4, "alone")])).collect()
    assert [(x.doc_id, x.edited_sha256, x.near_next) for x in one] == [(4, hashlib.sha256(b"alo" + b"al").hexdigest(), 1.0)]
    got = P.edited_fingerprints(table([(4, "same"), (4, "same"), (4, "same"), (None, None), (None, None)])).collect()
    assert len(got) == 5 and len({x.fingerprint for x in got}) == 2
