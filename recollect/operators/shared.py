"""Results that several plans read are computed once and kept where every executor finds them."""

from __future__ import annotations

import gc
import uuid
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local session that names none, as in tests, gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-recollect-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Results that one operation reads several times, in compressed files of the shared folder, which go when it is over. A checkpoint is not compressed, and
    stays until the driver happens to collect its garbage: settle() is for small results and for those that outlive the operation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def hold(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{checkpoint_dir(self.spark)}/scratch-{uuid.uuid4().hex}")
        df = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.simpleString() == "void" else F.col(f"`{f.name}`") for f in df.schema])
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def release(self) -> None:
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []
        let_go(self.spark)


def let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files and checkpoints of finished work once the driver's garbage is collected; after large work that is now."""
    gc.collect()
    spark._jvm.System.gc()


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a small scan dealt out over the cluster's cores; a scan of at least as many splits stays as it is.

    A file of one row group is otherwise one task's work, whatever comes after it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def counted(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in that order, from 0. Tasks count what they hold; only their totals, one row a task, are added up apart."""
    held = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    totals = sorted((r.part, r.n) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, s - n) for (p, n), s in zip(totals, accumulate(n for _, n in totals), strict=True)]
    first = rows.sparkSession.createDataFrame(before, "_part long, _first long")
    return held.join(F.broadcast(first), part == F.col("_part")).withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_first")


def small(batches, rows: int = 256, size: int = 4_000_000):
    """Slices of record batches, of that many rows and about that many bytes at most (one row at least), so that what a
    worker makes of a batch in Python stays small however long the texts are."""
    for b in batches:
        step = max(1, min(rows, int(size * b.num_rows / max(1, b.nbytes)))) if b.num_rows else 1
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


#: Bytes of rows that a task bundles in one go.
BUNDLED = 16 << 20


def moved(rows: DataFrame, key: str, deal) -> DataFrame:
    """rows after a shuffle by an integer column: deal takes (key, bundle) and says how they move. A bundle holds rows of one key and task as columns, compressed,
    which takes about a third of what Spark's shuffle files take of such rows. Rows lose their order."""
    import pyarrow as pa

    at = rows.columns.index(key)

    def bundle(batches):
        import pyarrow.compute as pc

        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def made(held):
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t.column(at))).combine_chunks()
            keys = t.column(at).to_numpy()
            ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip([0, *ends], ends, strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=options) as out:
                    out.write_table(t.slice(start, end - start), max_chunksize=10_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + 1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "bundle"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= BUNDLED:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    def undo(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from pa.ipc.open_stream(b.column(1)[i].as_buffer())

    return deal(rows.mapInArrow(bundle, "key int, bundle binary")).mapInArrow(undo, rows.schema)


def groups(batches, keys: list[str]):
    """Join up a stream of sorted record batches so that each table yielded holds whole groups of equal keys.

    Memory: one batch and one group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = {k: batch.column(k)[batch.num_rows - 1] for k in keys}
        same = None
        for k in keys:
            eq = pc.fill_null(pc.equal(batch.column(k), last[k]), False)
            same = eq if same is None else pc.and_(same, eq)
        flags = np.asarray(same.to_numpy(zero_copy_only=False))
        other = np.flatnonzero(~flags)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and any(held[-1].column(k)[0] != last[k] for k in keys)):
            whole = held + ([batch.slice(0, cut)] if cut else [])
            if whole:
                yield pa.Table.from_batches(whole).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
