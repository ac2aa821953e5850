"""One query per operator, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, crosspolytope, kneserney, linededup, minhash, mtree, packing, sharding, tokencounts, toxicity
from docloom.llm.common import Scratch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return mtree.top_k(rows, rows.where("vec_id % 20 = 0"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = kneserney.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "perplexity", "threshold", "rejected")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return crosspolytope.nearest(rows, rows.where("vec_id % 100 = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = toxicity.train(documents, read(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, model, ["doc_id"])
    # a null doc_id has no remainder
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    predicted = (F.col("toxicity") >= 0.7).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokencounts.token_lengths(read(spark, sf_dir, "documents"))
    # written once: the suffix sums read it twice, and the texts are encoded once only
    histogram = Scratch(spark, "lengths").table(tokencounts.length_histogram(lengths), "histogram")
    return tokencounts.limit_table(histogram)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_packing, op3_top_k, op4_bpe, op5_line_dedup, op6_quality, op7_sharding, op8_nearest, op9_toxicity, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": minhash.ORACLE, "op3_top_k": mtree.ORACLE, "op5_line_dedup": linededup.ORACLE}
