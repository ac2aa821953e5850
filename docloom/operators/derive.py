"""Training sets derived from blocks, nodes and chunks. Blocks here are sections: they carry node_id and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.blocks import by_doc, table_records


def _joined(what: str, sep: str, when: Column | None = None) -> Column:
    row = F.struct("ordinal", what)
    rows = F.array_sort(F.collect_list(row if when is None else F.when(when, row)))
    return F.array_join(rows[what], sep)


def instruction_pairs(sections: DataFrame, tree: DataFrame) -> DataFrame:
    """`Explain: {heading}` with the section's own paragraphs, 2000 characters at most; sections without any are left out."""
    body = sections.groupBy("doc_id", "node_id").agg(_joined("text_plain", " ", F.col("type") == "paragraph").alias("_b"), F.sum("token_count_est").alias("token_count_est"))
    rows = tree.where("title <> '' AND size(chunk_ids) > 0").select("doc_id", "node_id", "title").join(body, ["doc_id", "node_id"])
    return rows.where("_b <> ''").select("doc_id", "node_id", F.concat(F.lit("Explain: "), F.col("title")).alias("instruction"), F.substring("_b", 1, 2000).alias("response"), "token_count_est")


def summarization_pairs(sections: DataFrame, tree: DataFrame) -> DataFrame:
    """Of each section with three paragraphs or more: its text before the last one, and the last one as its summary."""
    paragraphs = sections.where("type = 'paragraph' AND node_id <> 'root'")
    last = Window.partitionBy("doc_id", "node_id")
    rows = paragraphs.withColumn("_last", F.max("ordinal").over(last)).withColumn("_n", F.count(F.lit(1)).over(last)).where("_n >= 3")
    out = rows.groupBy("doc_id", "node_id").agg(_joined("text_plain", " ").alias("_d"), F.max_by("text_plain", "ordinal").alias("summary"))
    return out.select("doc_id", "node_id", F.substring("_d", 1, 2000).alias("document"), "summary")


def abstract_pairs(sections: DataFrame) -> DataFrame:
    """An abstract block with the document's headings and paragraphs, 4000 characters at most."""
    abstracts = sections.where("type = 'abstract'").groupBy("doc_id").agg(F.min_by("text_plain", "ordinal").alias("summary"))
    body = sections.where("embedding_ready AND type IN ('paragraph', 'heading')").groupBy("doc_id").agg(_joined("text_plain", " ").alias("_d"))
    return abstracts.join(body, "doc_id").select("doc_id", F.substring("_d", 1, 4000).alias("document"), "summary")


def embedding_payloads(described: DataFrame) -> DataFrame:
    """Every embedding-ready block with its place and its document's title, author and type. described: Documents.described."""
    about = F.first("about", ignorenulls=True).over(Window.partitionBy("doc_id"))
    rows = described.withColumn("about", about).where("embedding_ready AND ordinal IS NOT NULL")
    of_document = (F.col("about.language").alias("document_language"), F.col("about.title").alias("document_title"), F.col("about.author").alias("author"))
    return rows.select("doc_id", "chunk_id", "text_plain", "type", "structure_path", "section_role", "page_number", "token_count_est", *of_document)


def table_texts(sections: DataFrame) -> DataFrame:
    """A table's records with the nearest paragraph, before or after it; the one before wins a tie."""
    place = F.when(F.col("type") == "paragraph", F.struct("ordinal", "text_plain"))
    rows = sections.withColumn("_b", F.last(place, ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_a", F.first(place, ignorenulls=True).over(by_doc().rowsBetween(1, Window.unboundedFollowing)))
    near = F.when(F.col("_b").isNull(), F.col("_a.text_plain")).when(F.col("_a").isNull() | (F.col("ordinal") - F.col("_b.ordinal") <= F.col("_a.ordinal") - F.col("ordinal")), F.col("_b.text_plain")).otherwise(F.col("_a.text_plain"))
    tables = rows.where("type = 'table'").select("doc_id", "ordinal", "caption", near.alias("description"))
    records = table_records(sections).groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("row", F.to_json("record").alias("record"))))["record"].alias("records"))
    return tables.join(records, ["doc_id", "ordinal"], "left")


def classification_features(sections: DataFrame, stats: DataFrame) -> DataFrame:
    """Document statistics, mean paragraph tokens and the text, 8000 characters at most."""
    paragraph = F.when(F.col("type") == "paragraph", F.col("token_count_est"))
    text = sections.groupBy("doc_id").agg(F.avg(paragraph).alias("mean_paragraph_tokens"), F.substring(_joined("text_plain", " "), 1, 8000).alias("text"))
    return stats.join(text, "doc_id")


def qa_examples(resolved: DataFrame, blocks: DataFrame) -> DataFrame:
    """Resolved references as question, answer and context: the target's text answers the citing block's sentence."""
    cite = blocks.select("doc_id", F.col("chunk_id").alias("source_chunk_id"), F.col("text_plain").alias("context"))
    target = blocks.select("doc_id", F.col("chunk_id").alias("target_id"), F.col("text_plain").alias("answer"))
    rows = resolved.where("resolved").join(cite, ["doc_id", "source_chunk_id"]).join(target, ["doc_id", "target_id"])
    return rows.select("doc_id", "source_chunk_id", "target_id", F.concat(F.lit("What does "), F.col("ref_id"), F.lit(" refer to?")).alias("question"), "answer", "context")


def code_examples(sections: DataFrame) -> DataFrame:
    """Code blocks with the paragraph right before them, null if another block is there."""
    before = F.lag(F.when(F.col("type") == "paragraph", F.col("text_plain"))).over(by_doc())
    return sections.withColumn("description", before).where("type = 'code_block'").select("doc_id", "chunk_id", "language", F.col("text_original").alias("code"), "description")


def adjacent_pairs(chunks: DataFrame) -> DataFrame:
    """Neighbouring chunks as source and target."""
    w = Window.partitionBy("doc_id").orderBy("chunk_num")
    return chunks.withColumn("target", F.lead("text").over(w)).where("target IS NOT NULL").select("doc_id", "chunk_num", F.col("text").alias("source"), "target")
