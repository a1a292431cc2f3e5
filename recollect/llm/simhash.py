"""SimHash near-duplicates: pigeonhole blocks find close fingerprints, components join them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, raw, settle, small
from .components import components

#: Members of one block at most that one task compares with another such chunk.
CHUNK = 4096


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the word shingles; no words: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    h = np.fromiter((digest(whole[i:j], seed) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        counts += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return raw(docs).mapInArrow(run, "doc_id long, fp long")


def masks(n: int, distance: int, per_node: float = 4.0) -> list[int]:
    """Bit masks such that two fingerprints within the distance agree under one of them at least.

    64 bits are cut into b blocks; the distance spoils so many of them at most, and each mask keeps the others.
    b grows with n until fewer than per_node chance partners are expected."""
    for b in range(distance + 2, distance + 7):
        cuts = [64 * k // b for k in range(b + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        out = [sum(c) for c in combinations(blocks, b - distance)]
        if sum(n / 2.0 ** m.bit_count() for m in out) <= per_node:
            break
    return [m - (1 << 64) if m >> 63 else m for m in out]


def forest(x: np.ndarray, distance: int):
    """Edges (from, to) of a spanning forest of the graph that links values within the distance."""
    left = np.ones(len(x), bool)
    for root in range(len(x)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            near = rest[np.bitwise_count(x[rest] ^ x[u]) <= distance]
            left[near] = False
            for v in near.tolist():
                yield u, v
            todo += near.tolist()


def links(fps: DataFrame, distance: int = 3, chunk: int = CHUNK, per_node: float = 4.0, meet=forest) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fps (column fp) that connect what pairs within the distance connect.

    Fingerprints that agree on a mask's blocks meet, and their distance is verified. A meeting gives a spanning
    forest of its links, not all pairs. One with more than chunk members is dealt out as pairs of chunks over
    many tasks, so that no link is lost and no task grows. per_node is what masks() takes; meet(values, distance) gives
    the edges of one meeting."""
    n = fps.count()
    every = masks(n, distance, per_node)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(every)])).alias("x")).select("x.t", "x.k", "fp")
    # kept apart from their aggregation, so that Spark can split a hot key's rows in the join
    sizes = settle(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(sizes, ["t", "k"]).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    met = met.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # chunk c meets every other chunk; alone, it meets itself
    met = met.withColumn("o", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("c")))))
    met = met.select("t", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp")
    keys = ["t", "k", "i", "j"]

    def verify(batches):
        import pyarrow as pa

        for table in groups(batches, keys):
            cols = [table.column(k).to_numpy() for k in keys]
            fp = table.column("fp").to_numpy().view(np.uint64)
            new = np.zeros(len(fp), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.append(np.flatnonzero(new), len(fp))
            a, b = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo == 2:
                    if (int(fp[lo]) ^ int(fp[lo + 1])).bit_count() <= distance:
                        a.append(lo)
                        b.append(lo + 1)
                else:
                    for u, v in meet(fp[lo:hi], distance):
                        a.append(lo + u)
                        b.append(lo + v)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id that links reach, itself included.

    Documents with equal fingerprints, or fingerprints at most distance bits apart, are linked. Copies fold into one
    fingerprint before any pairing. Null, empty and blank texts have fingerprint 0 and link like any other. Null
    doc_ids take part in links but never become a component_id while another doc_id can be it. Repeated rows each get their row;
    an empty table gives no rows; texts of any length count whole; columns other than doc_id and text are ignored."""
    prints = settle(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = settle(rooted)
    low = settle(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    # settled, so that Spark can split the rows of a text that is copied without end
    ids = settle(rooted.join(low, "root").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")
