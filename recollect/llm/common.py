"""Shared helpers of the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint_dir, groups, settle, small  # noqa: F401  for the operators here

#: ASCII white space, as the word rule [^\x20\x09-\x0D]+ sees it.
SPACES = " \t\n\x0b\x0c\r"

U64 = np.uint64


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, wherever its file system is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), under these names only, so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def raw(docs: DataFrame, *more: str) -> DataFrame:
    """As texts(), the text as UTF-8 bytes for Python workers."""
    return texts(docs, *more).withColumn("text", F.col("text").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
