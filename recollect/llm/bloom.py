"""Bloom filters of bounded size, built where the data is and merged piece by piece.

A filter is a bit array of 2**log2_bits bits, cut into segments of SEGMENT bytes. Each task sends the
segments that it touched; a shuffle by segment merges them, so no task holds more than one task's filter.
Only finished filters, of a size that a parameter bounds, reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, mix, small

SEGMENT = 1 << 14
HASHES = 4


def log2_bits(n: int, per_key: int = 12, most: int = 27) -> int:
    """Bits for n keys as a power of two; at most 2**most (16 MB). Beyond it more keys are suspected, none is lost."""
    return max(17, min(most, int(np.ceil(np.log2(max(1, n) * per_key)))))


def places(h: np.ndarray, log2: int) -> np.ndarray:
    """The HASHES bit numbers of each 64-bit hash, as an (n, HASHES) array."""
    step = mix(h ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=U64)) >> U64(64 - log2)).astype(np.int64)


def holds(bits: np.ndarray, h: np.ndarray, log2: int) -> np.ndarray:
    """Which hashes the filter (an array of bytes) may hold."""
    if not len(h):
        return np.zeros(0, bool)
    p = places(h, log2)
    return ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)


def add(bits: np.ndarray, h: np.ndarray, log2: int) -> None:
    p = places(h, log2).ravel()
    np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))


def add_twice(once: np.ndarray, twice: np.ndarray, h: np.ndarray, log2: int) -> None:
    """Enter distinct hashes: those that once may hold already go to twice."""
    seen = holds(once, h, log2)
    if seen.any():
        add(twice, h[seen], log2)
    add(once, h, log2)


def segments(once: np.ndarray, twice: np.ndarray | None = None):
    """Record batches of the non-empty segments."""
    import pyarrow as pa

    o = once.reshape(-1, SEGMENT) if len(once) >= SEGMENT else once.reshape(1, -1)
    t = np.zeros_like(o) if twice is None else twice.reshape(o.shape)
    at = np.flatnonzero(o.any(axis=1))
    for k in range(0, len(at), 64):
        ids = at[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([o[i].tobytes() for i in ids], pa.binary()), pa.array([t[i].tobytes() for i in ids], pa.binary())], names=["segment", "once", "twice"])


SCHEMA = "segment long, once binary, twice binary"


def merge(parts: DataFrame, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of all parts: (once, twice). A key in two parts has its bits in both once filters, so their
    conjunction joins the twice filter: it never loses a key that two parts hold."""

    def fold(batches):
        import pyarrow as pa

        now, out = None, None
        for b in batches:
            for seg, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
                if seg != now:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([out[0].tobytes()], pa.binary()), pa.array([out[1].tobytes()], pa.binary())], names=["segment", "once", "twice"])
                    now, out = seg, (o.copy(), t.copy())
                else:
                    np.bitwise_or(out[1], t | (out[0] & o), out=out[1])
                    np.bitwise_or(out[0], o, out=out[0])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([out[0].tobytes()], pa.binary()), pa.array([out[1].tobytes()], pa.binary())], names=["segment", "once", "twice"])

    once, twice = np.zeros((1 << log2) // 8, np.uint8), np.zeros((1 << log2) // 8, np.uint8)
    width = min(SEGMENT, len(once))
    for r in parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold, SCHEMA).collect():
        once[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.once, np.uint8)
        twice[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.twice, np.uint8)
    return once, twice


def of(keys: DataFrame, most: int = 27) -> tuple[bytes, int]:
    """A filter of 64-bit keys (the one column), and the logarithm of its bits, 2**most at most."""
    log2 = log2_bits(keys.count(), most=most)

    def fill(batches):
        bits = np.zeros((1 << log2) // 8, np.uint8)
        for b in batches:
            add(bits, b.column(0).to_numpy().view(np.uint64), log2)
        yield from segments(bits)

    return merge(keys.mapInArrow(fill, SCHEMA), log2)[0].tobytes(), log2


class Split:
    """Rows in two: those whose key, a 64-bit number in their first column, is surely not in keys, and the others.

    Only the others need to be sent to meet what belongs to their keys. within() and without() are steps of mapInArrow; the one that keeps
    the most rows is best put in front of what follows in the same step, so that a task needs no second Python worker."""

    def __init__(self, keys: DataFrame, most: int = 27):
        held, self.log2 = of(keys, most)
        self.sent = keys.sparkSession.sparkContext.broadcast(held)

    def _pick(self, batches, yes: bool):
        import pyarrow as pa

        bits = np.frombuffer(self.sent.value, np.uint8)
        for b in small(batches):
            flags = holds(bits, b.column(0).to_numpy().view(np.uint64), self.log2)
            yield b.filter(pa.array(flags if yes else ~flags))

    def within(self, batches):
        yield from self._pick(batches, True)

    def without(self, batches):
        yield from self._pick(batches, False)
