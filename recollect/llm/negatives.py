"""Hard-negative mining: for each anchor and each of its positives, the best rows of other labels whose score lies in a window below
the positive's. Cover trees over packs of rows are searched by all anchors at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle
from .covertree import Negatives, Positives, Tree, augmented, build, descend, net

#: Rows of one tree, and trees that a task builds at most.
PACK, TREES = 2048, 8
#: Rows that pivots are chosen among, and pivots at most: they decide which rows share a tree, never a result.
SAMPLE, PIVOTS = 2048, 64
NO_ID = int(np.iinfo(np.int64).max)
TREE = "x array<long>, ids array<long>, rows array<long>, labels array<long>, centre array<long>, radius array<double>, child array<long>, own array<long>, uniform array<boolean>"


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """row (a number of its own), vec_id, label and x (the components as integers, floor(scale * c)) of the rows that take part."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    own = rows.where(F.col("label").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    return settle(own.select(F.monotonically_increasing_id().alias("row"), "*"))


def pivots(rows: DataFrame) -> np.ndarray:
    """The top of all trees: a net over a bounded sample, its reach halved while it has few enough centres."""
    x = np.array([r.x for r in rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("x").collect()], np.float64)
    w = augmented(x)
    reach, out = float(np.sqrt(((w - w[0]) ** 2).sum(axis=1)).max()), [np.arange(len(w))]
    while reach > 1e-6 and len(finer := net(w, np.arange(len(w)), reach)) <= PIVOTS:
        out, reach = finer, reach / 2
    return x[[p[0] for p in out]]


def forest(rows: DataFrame) -> DataFrame:
    """Trees over packs of rows. Rows lie in the order of label, nearest pivot and a hash, cut into even ranges, so that a pack mostly has
    one label and one neighbourhood, and a label or a place with any share of the rows parts among packs."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    top, spark = pivots(rows), rows.sparkSession
    parts = max(-(-n // (PACK * TREES)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 512)))

    def near(batches):
        import pyarrow as pa

        half = (top**2).sum(axis=1) / 2
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(-1, width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((half - x @ top.T).argmin(axis=1).astype(np.int32))], names=["row", "vec_id", "label", "x", "pivot"])

    def grow(batches):
        import pyarrow as pa

        def tree(held):
            t = pa.Table.from_batches(held)
            cols = [t.column(c).to_numpy() for c in ("row", "label")]
            ids = t.column("vec_id").fill_null(NO_ID).to_numpy()
            x = np.concatenate([c.flatten().to_numpy() for c in t.column("x").chunks]).reshape(-1, width)
            got = build(x, ids, cols[0], cols[1])
            lists = [getattr(got, f).ravel() for f in Tree.FIELDS]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in lists], names=list(Tree.FIELDS))

        held, size = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, PACK - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == PACK:
                    yield tree(held)
                    held, size = [], 0
        if size:
            yield tree(held)

    placed = rows.mapInArrow(near, "row long, vec_id long, label long, x array<long>, pivot int")
    order = ["label", "pivot", F.xxhash64("row")]
    return settle(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(grow, TREE))


def searched(trees: DataFrame, queries: DataFrame, seeker, width: int, exact: bool, block: int = 1024, most_broadcast: int = 16_384) -> DataFrame:
    """(row, slot, id, score, found) of what the seeker of each query (row, label, x, scores) has found: seeker(row, label, scores) gives an object
    for descend(), whose lists are slots 1, 2 ...

    Queries come in blocks formed on Spark; every tree meets every block, and a task keeps the best of all its trees for each query, so that later
    trees are searched with what earlier ones gave. Up to most_broadcast queries the blocks are broadcast; beyond, Spark pairs the partitions."""
    asked = settle(queries.select("row", "label", "x", "scores"))
    n = asked.count()
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // block)))).cast("int"))
    blocks = settle(numbered.groupBy("block").agg(F.collect_list(F.struct("row", "label", "x", "scores")).alias("asked")))
    kind = np.float64 if exact else np.int64

    def run(batches):
        import pyarrow as pa

        seekers: dict[int, list] = {}

        def out(b):
            cols = [[], [], [], [], []]
            for row, found, _, _ in seekers.pop(b):
                for slot, best in enumerate(found.best if isinstance(found.best, list) else [found.best], 1):
                    for s, i, r in zip(best.scores.tolist(), best.ids.tolist(), best.rows.tolist(), strict=True):
                        for c, v in zip(cols, (row, slot, None if i == NO_ID else i, s, r), strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "slot", "id", "score", "found"])

        for batch in batches:
            for i in range(batch.num_rows):
                lists = [batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(9)]
                tree = Tree(**dict(zip(Tree.FIELDS, lists, strict=True)))
                tree.x = tree.x.reshape(-1, width).astype(kind)
                b = batch.column(9)[i].as_py()
                if b not in seekers:
                    if len(seekers) >= 16:  # what a task holds stays bounded
                        yield from map(out, list(seekers))
                    own = []
                    for r in batch.column(10)[i].as_py():
                        q = np.array(r["x"], kind)
                        own.append((r["row"], seeker(r["row"], r["label"], r["scores"]), q, float(np.sqrt((q.astype(np.float64) ** 2).sum())) * (1 + 1e-9)))
                    seekers[b] = own
                for _, found, q, norm in seekers[b]:
                    descend(tree, q, norm, found)
        yield from map(out, list(seekers))

    pairs = trees.crossJoin(F.broadcast(blocks) if n <= most_broadcast else blocks).select(*Tree.FIELDS, "block", "asked")
    return pairs.mapInArrow(run, "row long, slot int, id long, score long, found long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's slot: scores fall, ids rise among equals (nulls last), then rows."""
    w = W.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Mine hard negatives from rows (vec_id, embedding, label) for those that anchor holds of.

    Components become integers, floor(scale * c); a score is an inner product, exact. An anchor's positives are its best other rows of its
    label; for each, the best rows of other labels with low % to high % of the positive's score are returned: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Higher scores come first, then smaller ids (nulls last).

    Rows without a label, a vector or components, or with a null, NaN or infinite one, take no part; a null vec_id takes part. Each row stands for
    itself, repeated ones too: a row is never its own positive, its copy may be. A positive of negative score has no window; an empty table gives no rows. Vectors of
    different lengths, or with products beyond 64 bits, raise; other columns are ignored."""
    own = vectors(rows, scale)
    n, least, most, size = own.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))).first()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if least != most:
        raise ValueError(f"vectors have {least} to {most} components")
    if most * size * size >= 1 << 63:
        raise OverflowError("inner products don't fit in 64 bits")
    exact = most * size * size < 1 << 53
    trees = forest(own)
    asked = own.where(anchor).withColumn("scores", F.array().cast("array<long>"))
    liked = best(searched(trees, asked, lambda row, label, _: Positives(row, label, positives), most, exact), positives)
    liked = settle(liked.select("row", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = liked.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    windows = lambda scores: [(-(-low * s // 100), high * s // 100) for s in scores]
    found = best(searched(trees, asked.drop("scores").join(scores, "row"), lambda row, label, scores: Negatives(label, windows(scores), negatives), most, exact), negatives)
    return found.join(liked, ["row", "slot"]).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
