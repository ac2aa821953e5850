"""Operator 10: exact length histogram.

Documents are encoded once and reduced to a count for each encoded length.
Suffix sums over that histogram answer, for every context limit, how many
documents exceed it, how many tokens a cut at it keeps, and which quantile it is.
The sums run in two levels (blocks of lengths, then lengths within a block), so
no task holds more than one block of lengths or the list of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import prepare
from docloom.llm.tokenizers import encode, public, public_pattern

BLOCK = 1024


def token_lengths(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and n_tokens for every row of `docs` (doc_id, text), whole texts, the ids being those of the tokenizer's file.

    Null and empty texts have none. Repeated rows and rows without a doc_id count
    one by one. An empty table gives no rows; other columns are ignored, whatever
    their names. The end id that packing adds is not counted.
    """
    prepare(docs.sparkSession)
    json_path = json_path or public("byte_bpe_50k.json")
    rank_path = rank_path or public("byte_bpe_50k.tiktoken")
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(t, json_path, rank_path, pattern)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and the number of documents of exactly that length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: what it holds, keeps and loses.

    max_tokens: the limit. n_docs: documents of exactly that length. docs_over: longer
    ones. docs_within: the others. total_tokens: of all documents. kept_tokens: after
    cutting every document at the limit. lost_tokens: the rest. quantile: share of
    documents within the limit. Between two rows kept_tokens is linear in the limit
    (its slope is docs_over), so the table answers every limit; `answer` does so.
    """
    h = histogram.select(F.col("n_tokens").alias("max_tokens"), "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    h = h.withColumn("block", F.floor(F.col("max_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    later = Window.orderBy(F.desc("block"))  # one row for each BLOCK lengths
    blocks = blocks.select(
        "block",
        (F.sum("b_docs").over(later) - F.col("b_docs")).alias("docs_after"),
        (F.sum("b_tokens").over(later) - F.col("b_tokens")).alias("tokens_after"),
        F.sum("b_docs").over(Window.partitionBy()).alias("all_docs"),
        F.sum("b_tokens").over(Window.partitionBy()).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("max_tokens"))
    out = h.join(blocks, "block").select(
        "max_tokens",
        "n_docs",
        (F.sum("n_docs").over(within) - F.col("n_docs") + F.col("docs_after")).alias("docs_over"),
        (F.sum("tokens").over(within) - F.col("tokens") + F.col("tokens_after")).alias("tokens_over"),
        "all_docs",
        "total_tokens",
    )
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("max_tokens") * F.col("docs_over")
    return out.select(
        "max_tokens",
        "n_docs",
        "docs_over",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        "total_tokens",
        kept.alias("kept_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def answer(limits: DataFrame, context: DataFrame) -> DataFrame:
    """kept_tokens and docs_over for each `context` (max_tokens long), occurring length or not.

    The next shorter length that occurs gives the answer: docs_over is its own, and
    kept_tokens grows by docs_over for each token that the limit lies above it. A
    limit below every length keeps max_tokens of every document.
    """
    none = F.lit(None).cast("long")
    points = limits.select("max_tokens", "docs_over", "kept_tokens", (F.col("docs_within") + F.col("docs_over")).alias("n"), F.lit(False).alias("asked"))
    asked = context.select("max_tokens", none.alias("docs_over"), none.alias("kept_tokens"), none.alias("n"), F.lit(True).alias("asked"))
    w = Window.orderBy("max_tokens", "asked").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(~F.col("asked"), F.struct("max_tokens", "docs_over", "kept_tokens")), ignorenulls=True).over(w)
    both = points.unionByName(asked).withColumn("k", known).withColumn("n", F.max("n").over(Window.partitionBy())).where("asked")
    over = F.coalesce(F.col("k.docs_over"), F.col("n"), F.lit(0))
    return both.select(
        "max_tokens",
        over.alias("docs_over"),
        (F.coalesce(F.col("k.kept_tokens"), F.lit(0)) + over * (F.col("max_tokens") - F.coalesce(F.col("k.max_tokens"), F.lit(0)))).alias("kept_tokens"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share `q` of the documents stay within."""
    return limits.where(F.col("quantile") >= q).agg(F.min("max_tokens").alias("max_tokens"))
