"""The corpus pipeline: each stage takes the documents that the one before it kept, and its decisions take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.bloom import Split
from recollect.llm.bpe import bpe
from recollect.llm.common import checkpoint_dir, remove, settle
from recollect.llm.decontam import decontaminate
from recollect.llm.lines import line_dedup
from recollect.llm.rules import quality_rules
from recollect.llm.similar import row_key, similar_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go. Null texts go with them."""
    return quality_rules(docs, counts=False, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; a document stays, whatever is left of it."""
    return line_dedup(docs, carry=COLUMNS[2:4]).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the first by doc_id (nulls last), then by a hash of the text, then by the
    other columns. Near copies are 80 % alike on five-word shingles; SimHash links and MinHash bands find the candidates.

    Only rows that go, or share doc_id and text with others, are sent to meet that decision; all others stay where they are."""
    rows = settle(similar_rows(docs, distance=3, shingle=5, percent=80))
    busy = rows.where("n > 1 or not first")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    whole = docs.select(row_key(F.col("doc_id"), text_hash).alias("key"), text_hash.alias("text_hash"), *COLUMNS)
    split = Split(busy.select(row_key(F.col("doc_id"), F.col("text_hash"))))
    alone, met = whole.mapInArrow(split.without, whole.schema), whole.mapInArrow(split.within, whole.schema)
    gone = rows.where("not first").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    met = met.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_anti")
    one = met.groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]])
    return alone.select(*COLUMNS).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, carry=COLUMNS[1:]).where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids_sha256", "decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("benchmark decontamination", decontamination), ("byte-level bpe", tokens)]

#: SQL has no XXH64 and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet to the shared folder and read again, and
    removed once the next one's stands. The last one's stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
