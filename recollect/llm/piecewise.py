"""Context-triggered piecewise hashing: the text itself says where its pieces end, so an edit changes the symbols around it only.

A rolling hash over the last SPAN bytes ends a piece wherever its lowest bits are zero: level k asks for k zero bits, so pieces grow about
twofold from level to level and every end at one level is an end at all lower ones. A fingerprint is written at the lowest level at which a text
has at most PIECES pieces, and at the LEVELS - 1 levels above it. Two fingerprints are compared at the levels that both have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, mix, settle, small

SPAN = 7
PIECES = 64
LEVELS = 3
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: Base-64 digits; a piece is written as two of them.
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


class Pieces:
    """Fingerprints of texts, by running sums: sums[i] adds letter(byte) * BASE**place up to place i, so that a run's hash is a
    difference, brought back to place 0."""

    def __init__(self):
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * U64(BASE))
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = min(BLOCK, max(1 << 12, 2 * n)) + SPAN
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def fingerprint(self, text: bytes) -> str:
        """level:symbols:symbols:...; of an empty text 0 and no symbols. Held at a time: one block, and at most PIECES ends."""
        raw = np.frombuffer(text, np.uint8)
        ends, zeros, sums, homes = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
        level, total = 0, 0
        last = np.zeros(SPAN, np.uint64)  # the sums at the SPAN places before the block
        up, down = 1, 1  # BASE**place and its inverse, at the block's first place
        for at in range(0, len(raw), BLOCK):
            part = raw[at : at + BLOCK]
            n = len(part)
            self._powers(n)
            s = np.cumsum(self.letters[part] * (self.up[:n] * U64(up)), dtype=np.uint64) + U64(total)
            long = np.concatenate((last, s))
            # a window's first place is SPAN - 1 before its last; those before the text's start count from place 0
            back = self.down[:n] * U64(down)
            h = mix((s - long[:n]) * back)
            tz = np.bitwise_count((h & (~h + U64(1))) - U64(1)).astype(np.int64)
            new = np.flatnonzero(tz >= level)
            ends, zeros, sums, homes = np.concatenate((ends, new + at)), np.concatenate((zeros, tz[new])), np.concatenate((sums, s[new])), np.concatenate((homes, back[new]))
            # the lowest level at which what has been seen so far makes few enough pieces: later blocks can only raise it
            above = np.cumsum(np.bincount(zeros, minlength=66)[::-1])[::-1]
            level = max(level, int(np.flatnonzero(above < PIECES)[0]))
            keep = zeros >= level
            ends, zeros, sums, homes = ends[keep], zeros[keep], sums[keep], homes[keep]
            last, total = long[-SPAN:], int(s[-1])
            up, down = up * pow(BASE, n, 1 << 64) % (1 << 64), down * pow(BASE, -n, 1 << 64) % (1 << 64)
        if len(ends) and ends[-1] == len(raw) - 1:  # the last piece ends with the text, at any level
            zeros[-1] = 64
        else:
            zeros, sums, homes = np.append(zeros, 64), np.append(sums, U64(total)), np.append(homes, U64(0))
        return ":".join([str(level), *(self._symbols(sums[zeros >= k], homes[zeros >= k]) if len(raw) else "" for k in range(level, level + LEVELS))])

    def _symbols(self, sums: np.ndarray, homes: np.ndarray) -> str:
        """The pieces that end where the sums were so, the place brought back by homes (BASE**-place of each end)."""
        before = np.concatenate((np.zeros(1, np.uint64), sums[:-1]))
        back = np.concatenate((np.ones(1, np.uint64), homes[:-1] * U64(pow(BASE, -1, 1 << 64))))
        h = mix((sums - before) * back) >> U64(52)
        return DIGITS[np.stack((h >> U64(6), h & U64(63)), axis=1).ravel().astype(np.int64)].tobytes().decode()


def common(a: str, b: str) -> float:
    """The longest common subsequence of two symbol strings, in symbols, against their mean length: what insertions and
    deletions leave, by one big-integer step for each symbol."""
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    if not x or not y:
        return float(x == y)
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1: the best of the levels that both are written at; 0 where there is none."""
    if a == b:
        return 1.0
    (i, *x), (j, *y) = a.split(":"), b.split(":")
    i, j = int(i), int(j)
    if not x[0] or not y[0]:
        return 0.0
    return max((common(x[k - i], y[k - j]) for k in range(max(i, j), min(i, j) + LEVELS)), default=0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, in place: nothing is shuffled. Null texts are empty; a null doc_id stays null."""

    def run(batches):
        import pyarrow as pa

        own = Pieces()
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text held against the next document's, by descending doc_id, and against an edited text of its own: the last half of
    its code points (rounded down) gives way to as many of the first of the next document, or to all of it. The last document is followed by the first.

    Returns one row for each row of docs: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness() of its fingerprint to the edited text's and to the next document's). Equal texts have equal fingerprints.

    Documents are range-partitioned by doc_id and streamed in that order, so that next documents meet without a join; a task holds two texts at a
    time. Only the first and the last text of each partition travel again, to meet across partitions.

    Null texts are empty; null doc_ids come last, in the order of their text's hash, as do rows of one doc_id, each of them a document; copies of a row are told
    apart by their place in the scan. A single document is its own next one; an empty table gives no rows; very long texts are
    hashed in blocks; columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("copy"), text.alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("tie"), F.col("copy")]

    def run(batches):
        import pyarrow as pa

        own = Pieces()
        before = None  # (doc_id, tie, copy, text, code points, fingerprint)
        for b in small(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = (*row[:3], whole := row[3].decode(), own.fingerprint(row[3]))
                if before is None:
                    out.append((*now[:3], 0, row[3], now[4], None))
                else:
                    out.append((*before[:3], 2, None, None, compared(own, before, whole, now[4])))
                before = now
            yield batch(pa, out)
        if before is not None:
            yield batch(pa, [(*before[:3], 1, before[3].encode(), before[4], None)])

    def meet(batches):
        import pyarrow as pa

        own = Pieces()
        for b in small(batches):
            out = []
            for *key, text, print_, next_text, next_print in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(compared(own, (*key, text.decode(), print_), next_text.decode(), next_print))
            yield pa.RecordBatch.from_pylist(out, schema=kinds(pa))

    # end: 0 the first row of a partition, 1 its last one, 2 a row that has met the next one
    schema = f"doc_id long, tie long, copy long, end int, text binary, print string, met struct<{ROW.replace(' ', ':').replace(',:', ',')}>"
    streamed = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    ends = streamed.where("end < 2")
    # two rows for each partition, without their texts
    line = W.orderBy(*order, "end")
    first = F.first(F.struct("doc_id", "tie", "copy")).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    places = ends.select("doc_id", "tie", "copy", "end").withColumn("next", F.coalesce(F.lead(F.struct("doc_id", "tie", "copy")).over(line), first)).where("end = 1")
    heads = ends.where("end = 0").select(F.struct("doc_id", "tie", "copy").alias("next"), F.col("text").alias("next_text"), F.col("print").alias("next_print"))
    tails = ends.where("end = 1").select("copy", "text", "print")
    pairs = places.drop("end").join(tails, "copy").withColumn("at", F.col("next.copy")).join(heads.withColumn("at", F.col("next.copy")).drop("next"), "at")
    joined = pairs.select("doc_id", "tie", "copy", "text", "print", "next_text", "next_print").mapInArrow(meet, ROW)
    return streamed.where("end = 2").select("met.*").unionByName(joined)


def kinds(pa):
    return pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def batch(pa, rows: list[tuple]):
    """Record batch of what edited_fingerprints() streams."""
    types = [("doc_id", pa.int64()), ("tie", pa.int64()), ("copy", pa.int64()), ("end", pa.int32()), ("text", pa.binary()), ("print", pa.string()), ("met", pa.struct(list(kinds(pa))))]
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def compared(own: Pieces, row: tuple, next_text: str, next_print: str) -> dict:
    """What a document (doc_id, tie, copy, text, fingerprint) returns, once its next one is at hand."""
    import hashlib

    doc_id, _, _, text, print_ = row
    half = len(text) // 2
    edited = (text[: len(text) - half] + next_text[:half]).encode()
    changed = own.fingerprint(edited)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": print_, "edited_fingerprint": changed, "near_edited": likeness(print_, changed), "near_next": likeness(print_, next_print)}
