"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words

CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in words.CJK_BLOCKS)
#: Characters that NFKC keeps as they are and that never join the one before them: ASCII, Latin, Cyrillic and Greek letters, common
#: punctuation, kana, ideographs, hangul syllables. A text of others may change.
STEADY = r"\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{388}-\x{3CE}\x{400}-\x{482}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{3001}-\x{3015}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
#: One character that STEADY doesn't have. A class of that many ranges costs some 20 calls a character; most characters are told by the first two.
CHANGING = rf"[^\x{{0}}-\x{{9F}}\x{{4E00}}-\x{{9FFF}}](?<=[^{STEADY}])"
STOP = sorted({*words.STOPWORDS, *words.FUNCTION_CHARS, *words.GENRE_WORDS})


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space (of any script) folded to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def clean(text: Column) -> Column:
    """As squeeze(); zero-width spaces are spaces too."""
    return squeeze(F.translate(text, "​", " "))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form (NFKC), by the ICU library that Spark has for its collations; only texts that hold a
    character which it may change go there."""
    icu = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(CHANGING), icu).otherwise(text)


def normalize(text: Column) -> Column:
    """NFKC, white space squeezed, lower case; null becomes empty."""
    return F.lower(squeeze(nfkc(F.coalesce(text, F.lit("")))))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def is_function_token(token: Column) -> Column:
    return token.isin(STOP) | ((F.length(token) == 2) & token.rlike(f"^[{words.FUNCTION_CHARS}]{{2}}$"))


def _of_word(word: Column) -> Column:
    """A word in lower case without outer -_. signs; one with inner ones gives its longer parts and the joined form too."""

    has = lambda w: F.contains(w, F.lit("-")) | F.contains(w, F.lit("_")) | F.contains(w, F.lit("."))

    def parts(w: Column) -> Column:
        split = F.split(w, "[-_.]+")
        return F.when(w == "", F.array().cast("array<string>")).when(~has(w), F.array(w)).otherwise(F.concat(F.array(w), F.filter(split, lambda p: F.length(p) > 1), F.array(F.array_join(split, ""))))

    return F.when(~has(word), F.array(F.lower(word))).otherwise(let(F.btrim(F.lower(word), F.lit("-_.")), parts))


def _of_run(run: Column) -> Column:
    """A run without spaces between words gives its characters, then its neighbouring pairs."""
    n = F.length(run)
    ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(ones, pairs)


def tokenize(text: Column, drop_stopwords: bool = True) -> Column:
    """The retrieval tokens in reading order, repeats included."""
    # no token holds white space, so that it need not be squeezed first; and words are folded one by one: they are ASCII, of which that is cheap. Of all
    # characters that NFKC leaves, the dotted capital I alone has a lower case that begins with an ASCII letter.
    folded = F.replace(nfkc(F.coalesce(text, F.lit(""))), F.lit("\u0130"), F.lit("i\u0307"))
    found = F.regexp_extract_all(folded, F.lit(f"{words.WORD.replace('a-z', 'A-Za-z')}|[{CJK}]+"), F.lit(0))
    tokens = F.flatten(F.transform(found, lambda w: F.when(F.ascii(w) < 0x80, _of_word(w)).otherwise(_of_run(w))))
    return F.filter(tokens, lambda t: ~is_function_token(t)) if drop_stopwords else tokens


def script_of(text: Column) -> Column:
    """cjk, latin or mixed, as the first 240 characters have it."""
    head = F.substring(text, 1, 240)

    def judge(x: Column) -> Column:
        total = x["cjk"] + x["latin"]
        return F.when(total < 4, "mixed").when(x["cjk"] > 0.75 * total, "cjk").when(x["latin"] > 0.75 * total, "latin").otherwise("mixed")

    return let(F.struct(count_of(head, CJK).alias("cjk"), count_of(head, "A-Za-z").alias("latin")), judge)


def sentences(text: Column) -> Column:
    """Pieces that end with a terminator, without white space at the ends."""
    parts = F.split(text, r"(?U)(?<=[。！？!?；;\n])\s*|(?<=[.])\s+")
    return F.filter(F.transform(parts, squeeze_ends), lambda p: p != "")


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def weighted_length(text: Column) -> Column:
    """Length in which a CJK character counts 2.5; truncated."""
    n = count_of(text, CJK)
    return (F.length(text) - n + n * 2.5).cast("int")


def is_mostly_cjk(text: Column) -> Column:
    """Over a fifth of the letters among the first 600 characters are CJK."""
    head = F.substring(text, 1, 600)
    letters = count_of(head, r"\p{L}")
    return F.coalesce(count_of(head, CJK) > 0.2 * letters, F.lit(False)) & (letters > 0)


def snippet(text: Column, tokens: Column, width: int = 160) -> Column:
    """An excerpt around the first of the tokens (two characters or more) that is found.

    The place is that in the normalised text; the excerpt is cut from the text itself."""
    low = normalize(text)
    places = F.filter(F.transform(F.filter(tokens, lambda t: F.length(t) >= 2), lambda t: F.position(t, low)), lambda p: p > 0)

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - 1 - width // 3)
        body = F.trim(F.substring(text, start + 1, F.lit(width)))
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(text), "…").otherwise(""))

    found = let(F.get(places, F.lit(0)), lambda at: F.when(at.isNotNull(), cut(at)).otherwise(F.concat(F.trim(F.substring(text, 1, width)), F.lit("…"))))
    return F.when(F.length(text) <= width, text).otherwise(found)


def percent_encode(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and _.~ (a hyphen is syntax in a text fragment)."""
    out = F.url_encode(text)
    for plain, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("-", "%2D")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def text_fragment(text: Column, limit: int = 48) -> Column:
    """A :~:text= fragment that finds the passage on its page; empty for fewer than 8 characters."""

    def make(t: Column) -> Column:
        head, tail = F.substring(t, 1, limit), F.substring(t, -limit, limit)
        first = F.when(F.length(t) <= limit, t).otherwise(F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head))
        last = F.regexp_replace(tail, "^[^ ]* ", "")
        end = F.when((F.length(t) > 2 * limit) & (last != "") & (last != first), F.concat(F.lit(","), percent_encode(last))).otherwise("")
        return F.when(F.length(t) < 8, "").otherwise(F.concat(F.lit(":~:text="), percent_encode(first), end))

    return let(squeeze(F.coalesce(text, F.lit(""))), make)


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def as_passage(text: Column, replies: Column) -> Column:
    """A comment and its replies, one to a line."""
    own = F.filter(F.transform(replies, squeeze_ends), lambda r: r != "")
    return F.array_join(F.concat(F.array(squeeze_ends(text)), F.transform(own, lambda r: F.concat(F.lit("↳ "), r))), "\n")
