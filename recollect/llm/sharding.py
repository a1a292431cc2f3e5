"""Contiguous shards of near equal bytes, cut on global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle


def balanced_shards(docs: DataFrame, n_shards: int = 24, overhead: int = 8, n_ranges: int | None = None) -> DataFrame:
    """Deal documents into n_shards contiguous shards whose byte sizes are as equal as whole documents allow.

    The order is doc_id, then the text's hash. Each range of that order gives its total; prefix sums of the
    totals (one number per range, n_ranges of them at most) place every range, and a running sum inside the
    range places every row. A document belongs to the shard that its middle byte falls in.

    Returns doc_id, size (UTF-8 bytes plus overhead; null text: overhead alone), text_crc32 (null text: that of
    the empty text), shard, slot (gapless from 0 in each shard). Null doc_ids sort first. Repeated rows each get
    a slot of their own. An empty table gives no rows; texts of any length are never copied, only measured."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # One scan of the texts; what goes on is 32 bytes a row. The row number parts equal rows among ranges when one key is hot.
    rows = settle(rows.withColumn("u", F.monotonically_increasing_id()))
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "h", "u"]
    rows = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most n rows
    base, total, count = [], 0, 0
    for r in sorted(totals):
        base.append((r.part, total, count))
        total, count = total + r.bytes, count + r.rows
    base = spark.createDataFrame(base, "part int, before long, above long") if base else spark.createDataFrame([], "part int, before long, above long")

    w = W.partitionBy("part").orderBy(*order)
    placed = rows.join(F.broadcast(base), "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("start"), (F.col("above") + F.row_number().over(w) - 1).alias("place"))
    middle = F.expr(f"int((start * 2 + size) * {n_shards} div {max(1, 2 * total)})")  # whole numbers: good for 10**17 bytes
    placed = settle(placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1))))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
