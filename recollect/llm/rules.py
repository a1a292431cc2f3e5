"""Quality rules as a short-circuit cascade, in DataFrame functions alone."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, settle

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+"))


def repeat_words(w: Column, n: int = 5) -> Column:
    """Words inside n-word windows that are found twice or more in w."""

    def covered(grams: Column) -> Column:
        tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(tagged, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)) | F.when(i > 0, F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))).otherwise(False)))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        last = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, last, lambda a, p: F.struct((p + n).alias("end"), (a["n"] + n - F.greatest(a["end"] - p, F.lit(0))).alias("n")), lambda a: a["n"])

    grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.when(F.size(w) < n + 1, F.lit(0).cast("long")).otherwise(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))


class Measures:
    """What rules look at in one document: each is a column, worked out where a rule asks for it, or a field that is at hand."""

    def __init__(self, text: Column, words: Column, known: Column | None = None):
        self.text, self.words, self.known = text, words, known

    def of(self, name: str) -> Column:
        if self.known is not None:
            return self.known[name]
        if name == "n_words":
            return F.size(self.words).cast("long")
        if name == "word_chars":
            return F.length(F.array_join(self.words, "")).cast("long")
        if name == "n_symbols":
            return F.regexp_count(self.text, F.lit(SYMBOLS)).cast("long")
        if name == "n_dup_lines":
            lines = F.filter(F.split(self.text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
            return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        return repeat_words(self.words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Rule:
    """A document is rejected where rejects(measures) holds."""

    name: str
    rejects: Callable[[Measures], Column]


BASE_RULES = [
    Rule("few_words", lambda m: m.of("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m.of("n_repeat_words") > 20 * m.of("n_words")),
]
#: Characters of scripts that write no spaces between words, with their punctuation and wide forms.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"


def too_long(m: Measures) -> Column:
    """Words of over 20 characters on average, unless a fifth of the characters are of scripts without spaces."""
    return (m.of("word_chars") > 20 * m.of("n_words")) & (F.regexp_count(m.text, F.lit(UNSPACED)) * 5 < m.of("word_chars"))


def few_distinct(m: Measures) -> Column:
    """Distinct words are held against the lesser of a tenth of all words and the root of 50 times their number, at every length: vocabulary
    grows about as the root of a text's length, and the bound never rises by more than one word for one word more."""
    d = F.size(F.array_distinct(m.words)).cast("long")
    return let(d, lambda d: (d * 10 < m.of("n_words")) & (d * d < 50 * m.of("n_words")))


#: Signs of boilerplate and noise, for texts of any length and script.
MORE_RULES = [
    Rule("symbols", lambda m: m.of("n_symbols") * 20 > m.of("word_chars")),
    Rule("word_length", lambda m: too_long(m) | (m.of("word_chars") < 2 * m.of("n_words"))),
    Rule("duplicate_lines", lambda m: m.of("n_dup_lines") * 10 > F.size(F.split(m.text, "\n")) * 4),
    Rule("capitals", lambda m: F.regexp_count(m.text, F.lit(r"\p{Lu}")) * 2 > m.of("word_chars")),
    Rule("shouting", lambda m: F.regexp_count(m.text, F.lit("!!")) * 4 > m.of("n_words")),
    Rule("few_distinct_words", few_distinct),
]


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def judged(text: Column, cascade: list[Rule], counts: bool) -> Column:
    """struct<[the counts, base_failed,] rejected_by>. One expression in which each value is bound once, so that a filter on
    any of its fields, pushed down to the scan, evaluates it once.

    Without counts a rule's statistics are worked out when the cascade comes to it."""

    def verdict(m: Measures) -> Column:
        out = None
        for r in cascade:
            out = F.when(r.rejects(m), F.lit(r.name)) if out is None else out.when(r.rejects(m), F.lit(r.name))
        return (F.lit(None).cast("string") if out is None else out).alias("rejected_by")

    def full(t: Column, w: Column, k: Column) -> Column:
        m = Measures(t, w, k)
        failed = F.lit(False)
        for r in BASE_RULES:
            failed = failed | r.rejects(m)
        return F.struct(*[k[c].alias(c) for c in COUNTS], failed.alias("base_failed"), verdict(m))

    def of(t: Column, w: Column) -> Column:
        if not counts:
            return F.struct(verdict(Measures(t, w)))
        m = Measures(t, w)
        return let(F.struct(*[m.of(c).alias(c) for c in COUNTS]), lambda k: full(t, w, k))

    return let(whole(text), lambda t: let(words(t), lambda w: of(t, w)))


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """The rows of the least hashes of doc_id: an even sample of the whole table. No text is hashed; about four times the sample are sorted."""
    hashed = docs.select("text", F.xxhash64("doc_id").alias("hash"))
    share = max(1, docs.count() // (4 * max(1, rows)))
    return settle(hashed.where(F.pmod(F.shiftright("hash", 20), F.lit(share)) == 0).orderBy("hash").limit(rows).select("text"))


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = 400, clear: float = 0.1) -> list[Rule]:
    """The rules by rejections per second, as a sample of sample_rows rows shows them; ties by name.

    A rule's time is that of a job less that of the same job without a rule; the sample is read 16 times as often
    until that is clear seconds at least. The sample decides the order alone, never a verdict: a cascade rejects the same documents in any order."""
    sample = sampled(docs, sample_rows)
    if sample.isEmpty():
        return sorted(rules, key=lambda r: r.name)

    def seconds(cascade: list[Rule], times: int) -> tuple[float, int]:
        rows = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("time"))
        began = time.perf_counter()
        n = rows.select(judged(F.col("text"), cascade, False)["rejected_by"].alias("r")).agg(F.count("r")).first()[0]
        return time.perf_counter() - began, n // times

    idle = min(seconds([], 1) for _ in range(3))[0]
    worth = {}
    for r in rules:
        times = 1
        s, n = min(seconds([r], times) for _ in range(2))  # the first compiles
        while s - idle < clear and times < 256:
            times *= 16
            s, n = seconds([r], times)
        worth[r.name] = n * times / max(s - idle, 1e-9)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 400, counts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge each document by a cascade of rules, the one that rejects most per second first; later rules run
    only on what earlier ones passed.

    Returns one row for each row of docs: doc_id, the five counts and base_failed (fewer than 10 words, or over 20 %
    of the words in repeated 5-word windows), unless counts is false, kept, rejected_by (the first rule in the cascade's
    order that rejects; null if kept) and the columns in carry, whatever their names. Null and empty texts have no words and fail; a null doc_id
    stays null; repeated rows are judged alike; an empty table gives no rows; texts of any length are judged whole, by the same rules.
    Which of several rules that reject a document is named depends on measured times; kept does not."""
    cascade = ordered(docs, BASE_RULES + (MORE_RULES if rules is None else rules), sample_rows)
    more = [c for c in carry if c != "doc_id"]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(F.col("text"), cascade, counts).alias("verdict"), F.struct(F.lit(0).alias("doc_id"), *more).alias("carried"))
    fields = [*COUNTS, "base_failed", "rejected_by"] if counts else ["rejected_by"]
    return out.select("doc_id", *[F.col("verdict")[f].alias(f) for f in fields], F.col("verdict")["rejected_by"].isNull().alias("kept"), *[F.col("carried")[c].alias(c) for c in more])
