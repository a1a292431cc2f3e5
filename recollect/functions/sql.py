"""The text functions that Spark lacks, under SQL names."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from . import words
from .extract import readable
from .identity import JUNK_PARAMS, JUNK_PREFIXES
from .text import STOP

READABLE = StructType([StructField("title", StringType()), StructField("author", StringType()), StructField("text", StringType()), StructField("ok", BooleanType())])
NFKC = "reflect('com.ibm.icu.text.Normalizer', 'compose', t, true)"


CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in words.CJK_BLOCKS)
FOUND = re.compile(f"[{CJK}]+|{words.WORD}")
BROKEN = re.compile("%(?![0-9A-Fa-f]{2})")
SILENT, FUNCTION = frozenset(STOP), frozenset(words.FUNCTION_CHARS)
ADDRESS = re.compile(r"^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)


def plain_tokens(text: str | None) -> list[str]:
    """What text.tokenize() gives, for one text."""
    out = []
    for w in FOUND.findall(" ".join(unicodedata.normalize("NFKC", text or "").split()).lower()):
        if not w[0].isascii():
            out += [*w, *(w[i : i + 2] for i in range(len(w) - 1))]
        elif w := w.strip("-_."):
            parts = [p for p in re.split("[-_.]+", w) if p]
            out += [w] if len(parts) < 2 else [w, *(p for p in parts if len(p) > 1), "".join(parts)]
    return [t for t in out if t not in SILENT and not (len(t) == 2 and t[0] in FUNCTION and t[1] in FUNCTION)]


def plain_url(url: str | None) -> str:
    """What identity.canonical_url() gives, for one URL."""
    given = (url or "").strip(" ")
    found = ADDRESS.match(given if "://" in given else "https://" + given)
    if not given or not found:
        return "" if not given else "https:///"
    net = found[1].rpartition("@")[2].lower()
    port = re.search(":0*([1-9][0-9]*)$", net)
    host = re.sub(r"^www\.", "", re.sub(":[0-9]*$", "", net))
    decode = lambda t: t if BROKEN.search(t) else unquote_plus(t)
    pairs = [tuple(map(decode, p.partition("=")[::2])) for p in (found[3] or "").split("&") if p]
    kept = [(k, v) for k, v in pairs if k.lower() not in JUNK_PARAMS and not k.lower().startswith(JUNK_PREFIXES)]
    query = "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k, v in kept)
    return f"https://{host}{'' if not port or port[1] in ('80', '443') else ':' + port[1]}{found[2].rstrip('/') or '/'}{'?' + query if query else ''}"


@F.pandas_udf(ArrayType(StringType()))
def tokenize(text):
    return text.map(plain_tokens)


@F.pandas_udf(StringType())
def canonical_url(url):
    return url.map(plain_url)


@F.udtf(returnType="ordinal int, text string, start double, end double")
class ChunkSegments:
    """Passages of one item from its segments: SELECT ... FROM items, LATERAL chunk_segments(segments)."""

    def eval(self, segments: list):
        from ..config import Settings
        from ..operators.chunking import packed

        cfg = Settings()
        rows = ((s["text"], s["start"], s["end"]) for s in segments or ())
        for k, p in enumerate(packed(rows, cfg.chunk_chars, cfg.overlap_chars, cfg.max_seconds, cfg.min_passage)):
            yield k, *p


@F.pandas_udf(READABLE)
def extract_readable(html):
    import pandas as pd

    return pd.DataFrame([readable(h) for h in html], columns=["title", "author", "text", "ok"])


def register(spark: SparkSession) -> None:
    """Make nfkc(text), normalize_text(text), tokenize(text), canonical_url(url), extract_readable(html) and the table function
    chunk_segments(segments) known to SQL for this session. Plans in Python have native columns for all but the last two."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION nfkc(t STRING) RETURNS STRING RETURN CASE WHEN t IS NULL THEN NULL ELSE {NFKC} END")
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN CASE WHEN t IS NULL THEN '' ELSE lower(trim(regexp_replace({NFKC}, r'(?U)[\s\x{{1c}}-\x{{1f}}]+', ' '))) END")
    for name, f in (("extract_readable", extract_readable), ("tokenize", tokenize), ("canonical_url", canonical_url)):
        spark.udf.register(name, f)
    spark.udtf.register("chunk_segments", ChunkSegments)
