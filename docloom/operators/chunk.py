"""Token-bounded chunks with overlap.

A document's running token sums are folded in order, as one aggregate expression
in the JVM that carries indices only; texts are cut out of the document afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.blocks import by_doc

MAX_TOKENS, OVERLAP = 512, 50


def block_text(blocks: DataFrame) -> DataFrame:
    """`blocks` with rendered: Markdown-like text by type, and its tokens `t`."""
    fence = F.concat(F.lit("```"), F.coalesce("language", F.lit("None")), F.lit("\n"), F.col("text_original"), F.lit("\n```"))
    items = F.array_join(F.transform(F.filter("items", lambda it: it["depth"] == 0), lambda it: F.concat(F.lit("- "), F.coalesce(it["text"], F.lit("")))), "\n")
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    data = F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), line), "\n")
    rendered = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("heading_level", F.lit(1))), F.lit(" "), F.col("text_plain")))
        .when(F.col("type") == "code_block", fence)
        .when((F.col("type") == "list") & F.col("items").isNotNull(), items)
        .when((F.col("type") == "table") & (F.size("rows") > 1), data)
        .otherwise(F.col("text_plain"))
    )
    return blocks.withColumn("rendered", rendered).withColumn("t", X.token_estimate("rendered"))


def greedy_spans(running: Column, max_tokens: int, overlap: int, split_oversize: bool = True) -> Column:
    """Groups of a document's blocks as (first, last) indices from 0, for the running sums of the blocks' tokens.

    A block over the limit stands alone. A group that would pass the limit
    closes, and the next one starts with its trailing blocks within the overlap.
    Groups are runs, so the fold keeps where the open one began, and the two ends
    of each closed one, a list that is copied whenever a group closes.
    """
    span = lambda a, z: F.array(F.struct(a.cast("int").alias("first"), z.cast("int").alias("last")))
    upto = lambda k: F.coalesce(F.get(running, k - 1), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        first, done = s["first"], s["done"]
        n, filled = upto(i + 1) - upto(i), first < i
        closed = F.when(filled, F.concat(done, span(first, i - 1))).otherwise(done)
        tail = F.array_min(F.filter(F.sequence(first, i), lambda k: upto(i) - upto(k) <= overlap))
        alone = F.struct((i + 1).alias("first"), F.concat(closed, span(i, i)).alias("done"))
        turned = F.struct(F.coalesce(tail, i).alias("first"), closed.alias("done"))
        over = filled & (upto(i + 1) - upto(first) > max_tokens)
        return F.when((n > max_tokens) & F.lit(split_oversize), alone).when(over, turned).otherwise(s)

    start = F.struct(F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))
    size = F.size(running)
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(every, start, step, lambda s: F.when(s["first"] < size, F.concat(s["done"], span(s["first"], size - 1))).otherwise(s["done"]))


def grouped(blocks: DataFrame, fields: tuple[str, ...], max_tokens: int, overlap: int, split_oversize: bool = True) -> DataFrame:
    """doc_id, k (from 0) and g, the structs of a group's blocks in order; blocks carry their tokens as `t`.

    What leaves a document is cut before it is exploded, so no row of a group
    holds the document, and no group's texts are copied but for the overlap.
    """
    running = F.sum(F.col("t").cast("long")).over(by_doc().rowsBetween(Window.unboundedPreceding, 0))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "_running", "t", *fields)))
    docs = blocks.withColumn("_running", running).groupBy("doc_id").agg(rows.alias("b"))
    spans = greedy_spans(F.col("b._running"), max_tokens, overlap, split_oversize)
    return docs.select("doc_id", F.posexplode(F.transform(spans, lambda s: F.slice("b", s["first"] + 1, s["last"] - s["first"] + 1))).alias("k", "g"))


def _all(field: str) -> Column:
    return F.transform("g", lambda b: b[field])


def truncated(c: Column, max_tokens: int) -> Column:
    """A text over the limit loses words from its end, ten at a time, while it has more than ten."""
    w = X.words(c)
    n = F.size(w)
    # tokens are floor(0.75 n): within the limit while 3 n < 4 (limit + 1)
    fits = F.floor((F.lit(4 * (max_tokens + 1)) - 1) / 3)
    drops = F.least(F.ceil((n - fits) / 10), F.ceil((n - 10) / 10))
    return F.when(X.tokens_of_words(n) > max_tokens, F.array_join(F.slice(w, 1, F.greatest(n - 10 * drops, F.lit(0)).cast("int")), " ")).otherwise(c)


def common_prefix(paths: Column) -> Column:
    """The longest common prefix of an array of paths."""
    def shorter(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        cut = F.array_position(same, False)
        return F.when(cut == 0, a).otherwise(F.slice(a, 1, (cut - 1).cast("int")))

    empty = F.array().cast("array<string>")
    return F.when(F.size(paths) > 0, F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))), F.element_at(paths, 1), shorter)).otherwise(empty)


def chunks(sections: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of the embedding-ready blocks: ids, text, tokens, block ids, common structure and heading paths.

    sections: blocks with structure_path and heading_path (see structure.with_sections).
    """
    groups = grouped(block_text(sections.where("embedding_ready")), ("chunk_id", "rendered", "structure_path", "heading_path"), max_tokens, overlap)
    out = groups.select("doc_id", (F.col("k") + 1).alias("chunk_num"), F.array_join(_all("rendered"), "\n\n").alias("_t"), _all("chunk_id").alias("block_ids"), _all("structure_path").alias("_s"), _all("heading_path").alias("_h"))
    n = F.col("chunk_num").cast("string")
    cid = F.concat(F.lit("chunk-"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))
    out = out.withColumn("text", truncated(F.col("_t"), max_tokens))
    return out.select("doc_id", "chunk_num", cid.alias("chunk_id"), "text", X.token_estimate("text").alias("token_count_est"), "block_ids", common_prefix(F.col("_s")).alias("structure_path"), common_prefix(F.col("_h")).alias("heading_path"))


def rag_chunks(blocks: DataFrame, max_tokens: int = 512, overlap: int = 64) -> DataFrame:
    """Sliding chunks of plain texts joined by spaces; a block over the limit is not set apart, and the tail is kept."""
    rows = blocks.where("embedding_ready").withColumn("t", F.col("token_count_est"))
    groups = grouped(rows, ("chunk_id", "text_plain"), max_tokens, overlap, split_oversize=False)
    return groups.select("doc_id", (F.col("k") + 1).alias("chunk_num"), F.array_join(_all("text_plain"), " ").alias("text"), _all("chunk_id").alias("block_ids"), F.aggregate(_all("t"), F.lit(0), lambda a, x: a + x).alias("token_count_est"))


def section_chunks(sections: DataFrame, max_tokens: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks that show at most three rows of a table and 500 characters of code; with the sections they touch and their place."""
    head = F.array_join(F.transform(F.slice("rows", 1, 3), lambda r: F.array_join(r, " | ", "")), "\n")
    text = F.when(F.col("type") == "table", head).when(F.col("type") == "code_block", F.substring("text_plain", 1, 500)).otherwise(F.col("text_plain"))
    rows = sections.where("embedding_ready").withColumn("_x", text).withColumn("t", X.token_estimate("_x"))
    groups = grouped(rows, ("chunk_id", "_x", "node_id", "heading_path"), max_tokens, overlap, split_oversize=False)
    return groups.select("doc_id", F.col("k").alias("position"), F.array_join(_all("_x"), "\n\n").alias("text"), _all("chunk_id").alias("block_ids"), F.array_distinct(_all("node_id")).alias("section_ids"), F.element_at(_all("heading_path"), 1).alias("heading_path"))
