"""Operators over words and lines with positions, as PDF readers give them: (doc_id, page, text, x0, x1, top, bottom, size, bold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINE_GAP, COLUMN_GAP = 3.0, 40.0


def lines_of_words(words: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """Words grouped to lines: a new line begins where `top` grows by more than the gap."""
    page = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    rows = words.withColumn("_new", F.coalesce(F.col("top") - F.lag("top").over(page) > gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("line", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("x0", "text")))["text"], " ")
    return rows.groupBy("doc_id", "page", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.avg("size").alias("size"), F.bool_and("bold").alias("bold"))


def font_headings(lines: DataFrame) -> DataFrame:
    """Lines larger than 1.3 times the page's average are headings; levels by share of the largest size, bold ones one up."""
    page = Window.partitionBy("doc_id", "page")
    rows = lines.withColumn("_avg", F.avg("size").over(page)).withColumn("_max", F.max("size").over(page))
    share = F.col("size") / F.col("_max")
    level = F.when(share >= 0.95, 1).when(share >= 0.80, 2).when(share >= 0.65, 3).otherwise(4)
    level = F.when(F.col("bold") & (level > 1), level - 1).otherwise(level)
    return rows.withColumn("heading_level", F.when(F.col("size") > 1.3 * F.col("_avg"), level)).drop("_avg", "_max")


def without_running_heads(lines: DataFrame, page_height: float, share: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Lines without those that stand in a margin on more than `share` of a document's pages."""
    edge = (F.col("bottom") < margin * page_height) | (F.col("top") > (1 - margin) * page_height)
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = lines.where(edge).groupBy("doc_id", "text").agg(F.count_distinct("page").alias("n")).join(pages, "doc_id").where(F.col("n") > share * F.col("pages"))
    return lines.join(often.select("doc_id", "text").withColumn("_edge", F.lit(True)), ["doc_id", "text"], "left").where(~(edge & F.coalesce("_edge", F.lit(False)))).drop("_edge")


def columns(lines: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """The column of each line: left edges that lie further apart than the gap begin a new one."""
    page = Window.partitionBy("doc_id", "page").orderBy("x0")
    rows = lines.withColumn("_new", F.coalesce(F.col("x0") - F.lag("x0").over(page) > gap, F.lit(True)).cast("int"))
    return rows.withColumn("column", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reading_order(lines: DataFrame) -> DataFrame:
    """`order` of the lines of a document: by page, column, top, left edge."""
    rows = lines if "column" in lines.columns else columns(lines)
    w = Window.partitionBy("doc_id").orderBy("page", "column", "top", "x0")
    return rows.withColumn("order", F.row_number().over(w))
