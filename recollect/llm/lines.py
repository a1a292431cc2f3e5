"""Line deduplication: two Bloom filters pick suspects, a shuffle of the suspects alone confirms them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import bloom
from .common import SPACES, raw, settle, small

MIN_CHARS = 10


def key_of(line: bytes) -> bytes:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACES.encode()).lower()


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    """The distinct keys of at least min_chars code points."""
    out = {key_of(x) for x in text.split(b"\n")}
    return {k for k in out if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars)}


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, keys_expected: int | None = None, most_log2_bits: int = 26, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key two or more documents hold, but in the document of the smallest doc_id among them.

    A first scan enters each document's keys into a once-seen and a twice-seen Bloom filter (2**most_log2_bits
    bits at most, so what is broadcast is bounded; past that more keys are suspected and the result is the same).
    A second scan sends only keys that the twice-seen filter holds into a shuffle, pre-aggregated to the smallest
    and largest doc_id of each key, which confirms repeats on the key itself. What comes back to a text is the numbers of its lines that go; only
    texts that lose some are sent to meet them. keys_expected sizes the filters; unset, the documents' bytes do.

    Returns one row for each row of docs: doc_id, n_lines, n_dropped, kept (the text that stays) and the columns in carry, whatever their names.
    Null or empty text is one empty line. Rows of one doc_id count as one document, so copies under one doc_id lose nothing to each other;
    null doc_ids count as one document that comes before all others. An empty table gives no rows; texts may be of any length."""
    spark = docs.sparkSession
    source = raw(docs)
    if keys_expected is None:
        n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
        keys_expected = n + size // 100
    log2 = bloom.log2_bits(keys_expected, most=most_log2_bits)

    def fill(batches):
        import xxhash

        once, twice = (np.zeros((1 << log2) // 8, np.uint8) for _ in range(2))
        for b in small(batches):
            for text in b.column(1).to_pylist():
                h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys_of(text, min_chars)), np.uint64)
                bloom.add_twice(once, twice, h, log2)
        yield from bloom.segments(once, twice)

    _, twice = bloom.merge(source.mapInArrow(fill, bloom.SCHEMA), log2)
    sent = spark.sparkContext.broadcast(twice.tobytes())

    def suspects(batches):
        import pyarrow as pa
        import xxhash

        bits = np.frombuffer(sent.value, np.uint8)
        for b in small(batches):
            ids, rows, found, at = [], [], [], []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys = list(keys_of(text, min_chars))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                own = {keys[i]: [] for i in np.flatnonzero(bloom.holds(bits, h, log2)).tolist()}
                if own:
                    for i, line in enumerate(text.split(b"\n")):
                        if (k := key_of(line)) in own:
                            own[k].append(i)
                for k, places in own.items():
                    ids.append(doc)
                    rows.append(row)
                    found.append(k)
                    at.append(places)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(found, pa.binary()), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "row", "key", "at"])

    # a row's key: line numbers are the same in rows of one doc_id and text
    row = F.xxhash64("doc_id", "text").alias("row")
    place = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))  # nulls first
    suspected = settle(source.select("doc_id", row, "text").mapInArrow(suspects, "doc_id long, row long, key binary, at array<int>"))
    # kept apart from its aggregation, so that Spark can split a hot key's rows in the join
    repeated = settle(suspected.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("key", "first"))
    gone = suspected.join(repeated, "key").where(place > F.col("first"))
    drops = settle(gone.groupBy("row").agg(F.flatten(F.collect_set("at")).alias("gone")))

    def rewrite(batches):
        import pyarrow as pa

        for b in small(batches):
            out = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n = len(lines)
                if gone:
                    away = set(gone)
                    lines = [x for i, x in enumerate(lines) if i not in away]
                    text = b"\n".join(lines)
                out.append((n, n - len(lines), text))
            n, dropped, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()), b.column(3)], names=["doc_id", "n_lines", "n_dropped", "kept", "carried"])

    more = [c for c in carry if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(F.lit(0).alias("doc_id"), *more).alias("carried"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select(row, "doc_id", "text", "carried")
    split = bloom.Split(drops.select("row"))
    losing = rows.mapInArrow(split.within, rows.schema).join(drops, "row", "left").select("doc_id", "text", "gone", "carried")

    def whole(batches):
        import pyarrow as pa

        kept = (pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.nulls(b.num_rows), b.column(3)], names=["doc_id", "text", "gone", "carried"]) for b in split.without(batches))
        yield from rewrite(kept)

    schema = StructType([StructField("doc_id", LongType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", BinaryType()), rows.schema["carried"]])
    out = rows.mapInArrow(whole, schema).unionByName(losing.mapInArrow(rewrite, schema))
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"), *[F.col("carried")[c].alias(c) for c in more])
