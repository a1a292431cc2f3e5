"""Connected components: local contraction, then alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Edges that a task contracts at a time.
HELD = 500_000
EDGES = "a long, b long"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) from each node to the smallest that the edges (a, b) connect it with, itself left out."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(shorter := new[new], new):
            new = shorter
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def contracted(batches):
    """The edges of a task's rows (a, b) as stars, HELD of them at a time: they connect what was connected, in fewer steps."""
    import pyarrow as pa

    held, rows = [], 0

    def flush():
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(t.column("a").to_numpy(), t.column("b").to_numpy())], names=["a", "b"])

    for b in batches:
        for i in range(0, b.num_rows, HELD):
            held.append(b.slice(i, HELD))
            rows += held[-1].num_rows
            if rows >= HELD:
                yield flush()
                held, rows = [], 0
    if rows:
        yield flush()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each node reaches, from edges (a, b): rows (node, root) for every node with an edge
    to another node and a smaller node in its component.

    Large-star ties each node's larger neighbours to its smallest neighbour, small-star does so with the smaller ones; before edges are
    checkpointed, those that lie in one task are contracted to stars. Rounds needed grow with the logarithm of the nodes; each is checkpointed. All tables
    grow with the input, so the joins merge: a hub's edges stream through one task and nothing is broadcast. Raises if max_rounds is not enough."""
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(contracted, EDGES))  # a > b
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = settle(e.mapInArrow(contracted, EDGES))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
