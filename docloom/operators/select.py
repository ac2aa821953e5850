"""Selective extraction: parts of documents, with their structure kept whole until the choice is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_section(sections: DataFrame, tree: DataFrame, title: str) -> DataFrame:
    """Blocks of the sections whose title contains `title` (any case), subsections included."""
    chosen = tree.where(F.lower("title").contains(title.lower()) & (F.col("node_id") != "root")).select("doc_id", F.col("node_id").alias("_step"))
    steps = sections.withColumn("_step", F.explode("structure_path"))
    return steps.join(chosen, ["doc_id", "_step"], "left_semi").drop("_step").dropDuplicates(["doc_id", "ordinal"])


def by_type(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.where(F.col("type").isin(*types))


def by_pages(blocks: DataFrame, first: int, last: int) -> DataFrame:
    return blocks.where(F.col("page_number").between(first, last))


def by_keyword(blocks: DataFrame, pattern: str, around: int = 40) -> DataFrame:
    """Blocks that match the pattern (any case), with the text around the first match."""
    p = f"(?i)(?s).{{0,{around}}}(?:{pattern}).{{0,{around}}}"
    return blocks.where(F.col("text_plain").rlike(f"(?i){pattern}")).withColumn("preview", F.regexp_extract("text_plain", p, 0))


def rebuilt(sections: DataFrame) -> DataFrame:
    """Chosen blocks as documents of their own: neighbours linked anew, paths as they were."""
    from docloom.operators.blocks import linked

    return linked(sections.drop("prev_chunk_id", "next_chunk_id", "surrounding_text_preview"))


def minimal(sections: DataFrame) -> dict[str, DataFrame]:
    """Chosen blocks as documents: blocks linked anew, and the nodes that own or lead to them, heading map, id map and statistics of these alone.

    Headings that were not chosen keep their nodes, by path, without a title.
    """
    from docloom.operators import enrich, structure

    blocks = rebuilt(sections)
    steps = blocks.select("doc_id", "ordinal", "chunk_id", "type", "text_plain", "node_id", "structure_path", F.posexplode("structure_path").alias("level", "step"))
    own = F.col("step") == F.col("node_id")
    tree = steps.groupBy("doc_id", F.col("step").alias("node_id")).agg(
        F.max(F.slice("structure_path", 1, F.col("level") + 1)).alias("path"),
        F.max("level").alias("level"),
        F.coalesce(F.max(F.when(own & (F.col("type") == "heading"), F.col("text_plain"))), F.lit("")).alias("title"),
        F.array_sort(F.collect_list(F.when(own, F.struct("ordinal", "chunk_id")))).alias("_ids"),
        F.min(F.when(own, F.col("ordinal"))).alias("first_ordinal"),
    )
    tree = tree.withColumn("chunk_ids", F.col("_ids.chunk_id")).drop("_ids").withColumn("parent_id", F.try_element_at("path", F.lit(-2)))
    return {"blocks": blocks, "nodes": tree, "heading_map": structure.heading_map(tree), "chunk_id_map": structure.chunk_id_map(blocks), "statistics": enrich.statistics(blocks)}
