"""Whitening of embeddings: the leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

Nothing but products of the covariance V with a narrow matrix Q is ever needed. Each is one pass over the rows, XᵀXQ on centred rows, summed
on Spark; what reaches the driver is as large as Q. A polynomial that is small on the unwanted part of the spectrum and grows fast above it
is applied by a three-term recurrence of such passes; QR and Rayleigh-Ritz follow, and directions whose residual has come down to rounding are locked."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .negatives import finite

PACK = 4096
PACKED = "ids array<long>, x array<long>"


def integers(rows: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of the rows that remain, packed as rows of up to PACK vectors (ids, x), each task for itself."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    own = rows.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))

    def run(batches):
        import pyarrow as pa

        def pack(held):
            t = pa.Table.from_batches(held)
            lists = [pa.concat_arrays(t.column("vec_id").chunks), pa.concat_arrays([c.flatten() for c in t.column("x").chunks])]
            widths = {len(v) for c in t.column("x").chunks for v in c}
            if len(widths) > 1:
                raise ValueError(f"vectors have {min(widths)} to {max(widths)} components")
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in lists], names=["ids", "x"])

        held, size = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, PACK - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == PACK:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return settle(own.mapInArrow(run, PACKED))


def total(x: np.ndarray) -> list[int]:
    """Column sums, exact: of high and low halves apart, where 64 bits might not do."""
    if not len(x) or int(np.abs(x).max()) < (1 << 62) // len(x):
        return x.sum(axis=0).tolist()
    return [(h << 32) + l for h, l in zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]


def squares(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact, as Python numbers where 64 bits might not do."""
    if not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


class Spectrum:
    """What the passes need of the fit list: packs, the number of rows n and the exact sums of each dimension."""

    def __init__(self, packs: DataFrame):
        self.packs = packs
        self.n, self.sums = self._sums()
        self.width = len(self.sums)
        self.passes = 0
        self.parts = max(1, math.isqrt(packs.rdd.getNumPartitions()))

    def _sums(self) -> tuple[int, list[int]]:
        def run(batches):
            import decimal

            import pyarrow as pa

            n, sums = 0, None
            for b in batches:
                for ids, x in zip(b.column(0), b.column(1), strict=True):
                    n += len(ids)
                    new = total(x.values.to_numpy().reshape(len(ids), -1))
                    if sums is not None and len(sums) != len(new):
                        raise ValueError(f"vectors have {len(sums)} and {len(new)} components")
                    sums = new if sums is None else [p + q for p, q in zip(sums, new, strict=True)]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([decimal.Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"])

        rows = self.packs.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min(F.lit(1))).collect()
        if len({r.n for r in rows}) > 1:
            raise ValueError("vectors have different numbers of components")
        return (rows[0].n if rows else 0), [int(r.s) for r in sorted(rows, key=lambda r: r.i)]

    def centred(self):
        """A function from a pack's integers to centred doubles: the numerators n * x - sum are exact before they are rounded."""
        n, sums = self.n, self.sums

        def centre(x: np.ndarray) -> np.ndarray:
            if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)) < 1 << 62:
                return (n * x - np.array(sums, np.int64)) / n
            return np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x.tolist()]).reshape(x.shape)

        return centre

    def _summed(self, of) -> np.ndarray:
        """The sum over all packs of of(centred pack), a matrix: within tasks, then by rows of the matrix on Spark, in the order of the tasks."""
        centre, width = self.centred(), self.width

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            m = None
            for b in batches:
                for x in b.column(1):
                    new = of(centre(x.values.to_numpy().reshape(-1, width)))
                    m = new if m is None else m + new
            if m is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(np.full(len(m), TaskContext.get().partitionId(), np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["i", "task", "row"])

        def add(batches):
            import pyarrow as pa

            at, row = None, None
            for b in batches:
                for i, r in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                    r = r.values.to_numpy()
                    if i == at:
                        row = row + r
                    else:
                        if at is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([0], pa.int32()), pa.array([row], pa.list_(pa.float64()))], names=["i", "task", "row"])
                        at, row = i, r
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([0], pa.int32()), pa.array([row], pa.list_(pa.float64()))], names=["i", "task", "row"])

        kind = "i int, task int, row array<double>"
        parts = self.packs.select("ids", "x").mapInArrow(run, kind).repartition(self.parts, "i").sortWithinPartitions("i", "task").mapInArrow(add, kind)
        self.passes += 1
        return np.array([r.row for r in sorted(parts.collect(), key=lambda r: r.i)])

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q by one pass."""
        return self._summed(lambda x: x.T @ (x @ q)) / self.n

    def trace(self) -> float:
        """The trace of V, from exact sums of squares."""
        n, sums = self.n, self.sums

        def run(batches):
            import decimal

            import pyarrow as pa

            out = 0
            for b in batches:
                for x in b.column(1):
                    out += sum(squares(numerators(x.values.to_numpy().reshape(-1, len(sums)), n, sums)))
            high, low = divmod(out, 10**30)
            yield pa.RecordBatch.from_arrays([pa.array([decimal.Decimal(v)], pa.decimal128(38, 0)) for v in (high, low)], names=["high", "low"])

        high, low = self.packs.mapInArrow(run, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high"), F.sum("low")).first()
        return (int(high) * 10**30 + int(low)) / self.n**3

    def covariance(self, t: np.ndarray) -> np.ndarray:
        """The covariance of the centred rows times t, centred itself before it is multiplied."""
        mean = self._summed(lambda x: (x @ t).sum(axis=0, keepdims=True)) / self.n

        def of(x):
            w = x @ t - mean
            return w.T @ w

        return self._summed(of) / self.n


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact; Python numbers where 64 bits might not do."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return np.array([[n * v - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()], object).reshape(x.shape)


def lowest(times, width: int, seed: np.random.Generator, steps: int = 10) -> float:
    """A bound below the spectrum of a positive semidefinite matrix: a few Lanczos steps, the least Ritz value less its residual."""
    basis, product, q = [], [], seed.normal(size=width)
    for _ in range(min(steps, width)):
        q = q / np.linalg.norm(q)
        basis.append(q)
        v = times(q[:, None])[:, 0]
        product.append(v)
        q = v
        for _ in range(2):
            for b in basis:
                q = q - (b @ q) * b
        if np.linalg.norm(q) <= 1e-12 * np.linalg.norm(v):
            break
    b, p = np.array(basis).T, np.array(product).T
    e, y = np.linalg.eigh((b.T @ p + p.T @ b) / 2)
    return max(0.0, float(e[0] - np.linalg.norm(p @ y[:, 0] - e[0] * (b @ y[:, 0]))))


def filtered(times, q: np.ndarray, low: float, high: float, degree: int, top: float, keep) -> np.ndarray:
    """The Chebyshev polynomial of that degree of V applied to q, scaled so that what is at top stays as large as it is: [low, high] maps to
    [-1, 1]. keep(y) takes out what is locked, at each step."""
    centre, half = (low + high) / 2, (high - low) / 2
    s = first = half / (top - centre)
    before, now = q, keep((times(q) - centre * q) * (s / half))
    for _ in range(degree - 1):
        after = 1 / (2 / first - s)
        before, now = now, keep((times(now) - centre * now) * (2 * after / half) - s * after * before)
        s = after
    return now


def leading(times, width: int, k: int, most_degree: int = 16, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric positive semidefinite matrix that only
    times(Q) knows.

    The block is half as wide again as what is wanted. A round filters the vectors that are not locked, orthonormalises them (also against locked ones) and
    rotates them to Ritz vectors. Leading ones whose residual is within rounding, 1e-14 of the largest eigenvalue, or has stopped falling below
    1e-11 of it, are locked. Raises if that takes more than rounds."""
    random = np.random.default_rng(seed)
    m = min(width, k + max(8, k // 2))
    locked, values = np.zeros((width, 0)), np.zeros(0)
    low = lowest(times, width, random) if m < width else 0.0

    def keep(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    def rotated(y: np.ndarray):
        """Ritz values (falling), vectors and residuals in the span of y."""
        q = np.linalg.qr(keep(keep(y)))[0]
        q = np.linalg.qr(keep(q))[0]
        v = times(q)
        t = q.T @ v
        e, r = np.linalg.eigh((t + t.T) / 2)
        e, r = e[::-1], r[:, ::-1]
        q, v = q @ r, v @ r
        return e, q, np.linalg.norm(v - q * e, axis=0)

    e, q, residual = rotated(random.normal(size=(width, m)))
    before = np.full(m, np.inf)
    for _ in range(rounds):
        largest = max(e[0], values[0] if len(values) else 0.0, np.finfo(float).tiny)
        sure = (residual <= 1e-14 * largest) | ((residual > before[: len(residual)] / 2) & (residual <= 1e-11 * largest))
        n = int(np.argmin(sure)) if not sure.all() else len(sure)
        if m == width and not len(values):
            n = len(e)  # the block is the whole space
        locked, values = np.column_stack((locked, q[:, :n])), np.append(values, e[:n])
        if len(values) >= k:
            break
        e, q, before = e[n:], q[:, n:], residual[n:]
        high = e[-1]
        if high <= low or e[0] - high <= 1e-13 * largest:
            low = min(low, high) - max(1e-3 * high, np.finfo(float).tiny)
        # so much that the largest doesn't drown the others in rounding
        x = 1 + 2 * (e[0] - high) / max(high - low, np.finfo(float).tiny)
        growth = math.log10(x + math.sqrt(x * x - 1)) if x > 1 else 0.0
        degree = max(1, min(most_degree, int(9 / growth) if growth > 0 else most_degree))
        e, q, residual = rotated(filtered(times, q, low, high, degree, max(e[0], high * (1 + 1e-9)), keep))
    else:
        raise RuntimeError(f"{len(values)} of {k} eigenvectors were certified in {rounds} rounds")
    # one more rotation in all that is locked: those that came to be locked apart are made orthogonal and ordered together
    q = np.linalg.qr(locked)[0]
    v = times(q)
    t = q.T @ v
    e, r = np.linalg.eigh((t + t.T) / 2)
    return e[::-1][:k], (q @ r)[:, ::-1][:, :k]


def whiten(rows: DataFrame, components: int = 32) -> DataFrame:
    """Whitened components of rows (vec_id, embedding): vec_id, component (from 1, by falling eigenvalue), n, deviation (the sum over dimensions of
    (n * x - S)**2 as a decimal, exact), whitened ((x - S / n) on the component's unit eigenvector, over the root of its eigenvalue),
    explained (eigenvalue over the trace of the covariance) and identity_error (the largest entry of the whitened rows' covariance minus the identity).

    x is floor(64 * c) + 1000000; the covariance is over all rows that remain, with divisor n. Rows without a vector or components, or with a null,
    NaN or infinite one, are dropped; a null vec_id stays null; repeated rows count and return as often as they come. There are as many components
    as directions with variance (over 1e-12 of the largest), at most as many as asked for: a table without rows, or of equal rows, gives no rows. Vectors of different lengths,
    and components beyond 64 bits, raise. Other columns are ignored.

    The rows are read some dozens of times, packed, from the shared folder; a task sends a matrix of the vectors' width by half as many columns again as
    asked for, whatever its rows."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    s = Spectrum(integers(rows))
    n, sums, centre = s.n, s.sums, s.centred()
    trace = s.trace() if n else 0.0
    if trace == 0:
        return rows.sparkSession.createDataFrame([], schema)
    e, q = leading(s.times, s.width, min(components, s.width))
    own = e > 1e-12 * e[0]
    e, q = e[own], q[:, own]
    t = q / np.sqrt(e)
    error = float(np.abs(s.covariance(t) - np.eye(len(e))).max())
    explained = e / trace

    def run(batches):
        import decimal

        import pyarrow as pa

        k = len(e)
        for b in batches:
            for ids, x in zip(b.column(0), b.column(1), strict=True):
                ids, x = ids.values, x.values.to_numpy().reshape(len(ids), -1)
                for lo in range(0, len(x), 256):
                    part = x[lo : lo + 256]
                    m = len(part)
                    far = [decimal.Decimal(v) for v in squares(numerators(part, n, sums))]
                    each = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(lo, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(far, pa.decimal128(38, 0)).take(each),
                        pa.array((centre(part) @ t).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return s.packs.mapInArrow(run, schema)
