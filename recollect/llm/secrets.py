"""Secret scan: keyed assignments, access keys and hex runs, and a randomness test battery, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .rules import let

#: Base kinds in their order; the method's own kind comes after them.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run of [0-9a-f]+ is as long as it can be, so asking for 16 finds the same spans as dropping shorter ones; likewise 4 + 14.
HEX = r"[0-9a-f]{16,}"
ACCESS = r"AKIA[A-Z0-9]{14,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by inferred encoding; symbols count by their place here.
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BINS = 40
SPAN = "array<struct<start:int,kind:int,end:int>>"


def before(sizes: Column, block: int = 256) -> Column:
    """For each of the sizes the sum of those before it. In blocks, so that the work stays near linear: an array that grows in
    aggregate() is copied at each step."""
    none = F.array().cast("array<int>")
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    scan = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, F.lit(block)))

    def blocks(xs: Column) -> Column:
        return let(cut(xs), lambda own: let(scan(F.transform(own, total), F.lit(0)), lambda at: F.flatten(F.transform(own, lambda x, i: scan(x, F.get(at, i))))))

    return let(sizes, lambda xs: F.when(F.size(xs) <= block, scan(xs, F.lit(0))).otherwise(blocks(xs)))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>>: the leftmost non-overlapping matches, in code points (end exclusive).

    What lies between matches comes from split(), so the places are sums of lengths."""
    matches, gaps, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.arrays_zip(gaps.alias("g"), matches.alias("m"), values.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), x["v"].alias("v")))

    def place(p: Column) -> Column:
        at = before(F.transform(p, lambda x: x["g"] + x["m"]))
        placed = F.transform(F.arrays_zip(p.alias("p"), at.alias("at")), lambda x: F.struct((x["at"] + x["p"]["g"]).alias("start"), (x["at"] + x["p"]["g"] + x["p"]["m"]).alias("end"), x["p"]["v"].alias("value")))
        return F.filter(placed, lambda x: x["end"] > x["start"])

    return let(parts, place)


def guarded(test: Column, value: Column, kind: str) -> Column:
    return F.when(test, value).otherwise(F.array().cast(kind))


def tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, by a logistic approximation (within 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def gamma_tail(x: Column, mean: Column, variance: Column) -> Column:
    """P(X > x) of a gamma variable of that mean and variance, by the Wilson-Hilferty cube root: it keeps the skewness that a normal
    approximation lacks where few symbols fall in each cell."""
    ninth = variance / (9 * mean * mean)
    return tail((F.pow(F.greatest(x, F.lit(0.0)) / mean, F.lit(1 / 3)) - (1 - ninth)) / F.sqrt(ninth))


def randomness(value: Column) -> Column:
    """struct<n, p>: the token's symbols and the p-value of its being random over its inferred alphabet; p null
    where no encoding fits (digits alone, letters of one case alone but for base-32's, fewer than 16 symbols).

    Chi-squared against uniform symbols (its exact mean and variance, as a gamma variable), a runs test about the alphabet's middle
    and the lag-one serial correlation; the three p-values combine by the Cauchy rule, which holds for dependent tests; none counts for more than
    0.99, so that no test that a token passes too well makes up for one that it fails."""
    body = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")
    hexa = F.lower(body).rlike("^[0-9a-f]+$") & (body.rlike("^[0-9a-f]+$") | body.rlike("^[0-9A-F]+$"))
    alphabet = F.when(hexa, HEX_DIGITS).when(body.rlike("^[A-Z2-7]+$"), BASE32).otherwise(BASE64)
    body = F.when(hexa, F.lower(body)).otherwise(body)

    def tests(t: Column) -> Column:
        codes, a = t["codes"], t["a"].cast("double")
        n = F.size(codes).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = squares * a / n - n
        p_chi = gamma_tail(chi, a - 1, 2 * (a - 1) * (n - 1) / n)
        high = F.size(F.filter(codes, lambda x: x * 2 >= a)).cast("double")
        low = n - high
        steps = F.sequence(F.lit(1), F.size(codes) - 1)
        runs = 1 + F.size(F.filter(steps, lambda i: (F.get(codes, i) * 2 >= a) != (F.get(codes, i - 1) * 2 >= a))).cast("double")
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var > 0, 2 * tail(F.abs(runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
        center = (a - 1) / 2
        lagged = F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.get(codes, i) - center) * (F.get(codes, i - 1) - center))
        p_serial = 2 * tail(F.abs(lagged / ((a * a - 1) / 12)) / F.sqrt(n - 1))
        ps = [F.least(F.greatest(p, F.lit(1e-9)), F.lit(0.99)) for p in (p_chi, p_runs, p_serial)]
        cauchy = sum((F.tan((F.lit(0.5) - p) * math.pi) for p in ps), F.lit(0.0)) / len(ps)
        return F.struct(F.size(codes).alias("n"), (F.lit(0.5) - F.atan(cauchy) / math.pi).alias("p"))

    coded = let(F.struct(body.alias("s"), alphabet.alias("al")), lambda t: F.struct(F.transform(F.filter(F.split(t["s"], ""), lambda c: c != ""), lambda c: F.position(c, t["al"]) - 1).alias("codes"), F.length(t["al"]).alias("a")))
    fits = ((body.rlike("[0-9]") & body.rlike("[A-Za-z]")) | (body.rlike("[A-Z]") & body.rlike("[a-z]")) | body.rlike("^[A-Z]+$")) & (F.length(body) >= 16)
    return F.when(fits, let(coded, tests))


def band(n: Column) -> Column:
    """Length bands, four to a doubling, all of 1024 and more in one: at most 25."""
    return F.least(F.lit(24), F.floor(F.log2(n / F.lit(16.0)) * 4).cast("int"))


def thresholds(counts: dict[tuple[int, int], int], fdr: float, prior: float = 100.0, reach: float = 0.25) -> dict[int, float]:
    """For each length band the p-value from which tokens pass for random: one rule for any number of tokens.

    A band's histogram is its own counts, those of bands d away at the weight reach**d, and a prior of 2 * prior tokens, half of them random
    and half natural ones that lie below fdr. Random tokens have uniform p-values, natural ones pile up near 0, so the random ones' number is
    read off the upper half; t is the lowest bin edge so that at most fdr of what lies above it exceeds the random tokens' share.
    Few tokens leave t at fdr, more move it by degrees; it is never over 0.5."""
    out = {}
    low = max(1, round(fdr * BINS))
    for b in {b for b, _ in counts}:
        bins = [prior / BINS + (prior / low if k < low else 0.0) for k in range(BINS)]
        for (other, k), n in counts.items():
            bins[k] += n * reach ** abs(b - other)
        random = 2 * sum(bins[BINS // 2 :])
        passing = [k for k in range(BINS // 2 + 1) if 1 - random * (BINS - k) / BINS / sum(bins[k:]) <= fdr]
        out[b] = passing[0] / BINS
    return out


def secret_scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Spans of secrets in every whole text.

    Kinds: assign, access, hex (fixed patterns, leftmost non-overlapping each) and random: runs of 20 or more characters of
    [A-Za-z0-9+/_=-] that no test of the battery tells from chance, at an estimated false-discovery rate of fdr in each length band
    (see thresholds). The bands' histograms of p-values (25 x 40 counts at most) are all that is gathered.

    Returns one row for each row of docs: doc_id, base and spans, arrays of struct<start, kind (a place in KINDS), end> in
    code points, end exclusive, by start, then kind. Null and empty texts have none; repeated rows each get their own; an empty table
    gives no rows; a text may be of any length, and columns other than doc_id and text are ignored."""
    text = F.col("text")
    # lower() also folds letters beyond A-Z; that can only let more texts through to the pattern.
    low = F.lower(text)
    cue = F.lit(False)
    for c in ASSIGN_CUES:
        cue = cue | F.contains(low, F.lit(c))
    kind_of = lambda m, k: F.transform(m, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    assign = guarded(cue, kind_of(F.filter(found(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 12), 0), SPAN)
    access = guarded(F.contains(text, F.lit("AKIA")), kind_of(found(text, ACCESS), 1), SPAN)
    hexes = guarded(text.rlike(r"[0-9a-f]{16}"), kind_of(found(text, HEX), 2), SPAN)
    tokens = guarded(
        text.rlike(r"[A-Za-z0-9+/_=-]{20}"),
        F.filter(F.transform(found(text, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), randomness(x["value"]).alias("r"))), lambda x: x["r"].isNotNull()),
        "array<struct<start:int,end:int,r:struct<n:int,p:double>>>",
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = settle(rows.select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), tokens.alias("tokens")))
    bins = rows.select(F.explode("tokens.r").alias("r")).groupBy(band(F.col("r.n")).alias("band"), F.least(F.lit(BINS - 1), F.floor(F.col("r.p") * BINS).cast("int")).alias("bin")).count()
    limit = thresholds({(r.band, r.bin): r["count"] for r in bins.collect()}, fdr)
    at = F.create_map(*[F.lit(x) for b, t in sorted(limit.items()) for x in (b, t)]) if limit else F.create_map(F.lit(0), F.lit(1.0))
    random = kind_of(F.filter("tokens", lambda x: x["r"]["p"] >= F.coalesce(F.try_element_at(at, band(x["r"]["n"])), F.lit(1.0))), 3)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
