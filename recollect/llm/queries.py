"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    out = balanced_shards(read(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.array_min("distances").alias("best_distance"), "contaminated")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe

    return bpe(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids_sha256", "decoded_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, personal_data

    out = personal_data(read(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:4]))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, named, secret_scan

    out = secret_scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piecewise import edited_fingerprints

    return edited_fingerprints(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items(), key=lambda x: int("0" + "".join(filter(str.isdigit, x[0].split("_")[0])))) if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
