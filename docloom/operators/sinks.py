"""Sinks: nested JSON by document, manifest, JSON lines, one folder for each training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.enrich import first_dates, published
from docloom.operators.structure import nodes

VERSION = "1.0"


def document_json(described: DataFrame) -> DataFrame:
    """doc_id and json: metadata, blocks in order, nodes with their paths. described: Documents.described.

    Blocks go into their nodes and nodes into their document, all within the one
    partitioning by document.
    """
    keep = ("ordinal", "chunk_id", "type", "text_plain", "text_original", "char_count", "token_count_est", "embedding_ready", "prev_chunk_id", "next_chunk_id", "parent_heading_chunk_id", "page_number")
    of_node = ("node_id", "parent_id", "node_type", "title", "level", "path", "chunk_ids")
    tree = nodes(described, keep).withColumn("_at", F.coalesce("first_ordinal", F.lit(-1)))
    docs = tree.groupBy("doc_id").agg(
        F.array_sort(F.flatten(F.collect_list("blocks"))).alias("_b"), F.array_sort(F.collect_list(F.struct("_at", *of_node))).alias("_n"), F.first("about", ignorenulls=True).alias("about")
    )
    without = lambda rows, first, names: F.transform(rows, lambda r: F.struct(*[r[n].alias(n) for n in names if n != first]))
    parts = F.struct(
        F.lit(VERSION).alias("version"),
        F.col("doc_id").cast("string").alias("document_id"),
        published(F.col("about"), first_dates(F.col("_b.text_plain"))).alias("metadata"),
        F.struct(without("_n", "_at", of_node).alias("nodes")).alias("structure"),
        without("_b", "ordinal", keep).alias("blocks"),
    )
    return docs.select("doc_id", F.to_json(parts).alias("json"))


def chunk_file(chunks: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """doc_id and json: a document's chunks in an envelope with their parameters."""
    row = F.struct("chunk_num", "chunk_id", "text", "token_count_est", "block_ids", "structure_path", "heading_path")
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["chunk_num"] - b["chunk_num"]).alias("chunks"))
    params = F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(overlap).alias("overlap_tokens"))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), params.alias("chunking_params"), F.size("chunks").alias("chunk_count"), "chunks")).alias("json"))


def manifest(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for each document of a batch."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return documents.join(stats, "doc_id", "left").select("doc_id", name.alias("filename"), F.coalesce("block_count", F.lit(0)).alias("block_count"), F.coalesce("total_token_count_est", F.lit(0)).alias("token_count_est"))


def combined_lines(blocks: DataFrame) -> DataFrame:
    """All embedding-ready blocks of a batch, flat."""
    return blocks.where("embedding_ready").select("doc_id", "ordinal", "chunk_id", "type", "text_plain", "token_count_est")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(jsons: DataFrame, path: str) -> None:
    """One JSON text a line, in files of the job's partitions."""
    jsons.select("json").write.mode("overwrite").text(path)


def chat_lines(pairs: DataFrame) -> DataFrame:
    """Instruction pairs as chat messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return pairs.select("doc_id", F.to_json(F.struct(F.array(message("user", "instruction"), message("assistant", "response")).alias("messages"))).alias("json"))


def alpaca_lines(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc_id", F.to_json(F.struct("instruction", F.lit("").alias("input"), F.col("response").alias("output"))).alias("json"))
