"""Canonical blocks: rendering, content, label merge, links to neighbours. One partitioning, by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as X


def by_doc():
    """A document's blocks in reading order; windows need a session, so this is no constant."""
    return Window.partitionBy("doc_id").orderBy("ordinal")


def before():
    return by_doc().rowsBetween(Window.unboundedPreceding, -1)


def chunk_id(ordinal: Column | str = "ordinal") -> Column:
    n = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("string")
    return F.concat(F.lit("blk-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))


def render_table(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    full = F.filter(rows, lambda r: F.size(r) > 0)
    return F.concat(F.lit("Table\n"), F.array_join(F.transform(full, line), "\n"))


def render_list(items: Column, ordered: Column, field: str = "text") -> Column:
    top = F.filter(items, lambda it: it["depth"] == 0)
    marked = lambda it, i: F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), F.coalesce(it[field], it["text"], F.lit("")))
    return F.array_join(F.transform(top, marked), "\n")


def rendered(original: bool = False) -> Column:
    """The plain text of a raw block by its type."""
    text, rows, field = ("text_original", "rows_original", "text_original") if original else ("text", "rows", "text")
    image = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(F.coalesce("src", F.lit("")))
    return (
        F.when(F.col("type") == "table", render_table(F.col(rows)))
        .when(F.col("type") == "list", render_list(F.col("items"), F.coalesce("ordered", F.lit(False)), field))
        .when(F.col("type") == "divider", "---")
        .when(F.col("type") == "image_placeholder", image)
        .otherwise(F.coalesce(text, F.lit("")))
    )


def base_blocks(raw: DataFrame) -> DataFrame:
    """Raw blocks with ids, plain text, counts and content fields; nothing is shuffled."""
    kind = F.when(F.col("type") == "list_item", "paragraph").otherwise(F.col("type"))
    rows = raw.withColumn("type", kind).withColumn("text_plain", rendered()).withColumn("_original", rendered(original=True))
    level = F.when(F.col("type") == "heading", F.coalesce(F.when(F.col("level") > 0, F.col("level")), X.heading_level("text_plain")))
    return rows.select(
        "doc_id",
        "ordinal",
        chunk_id().alias("chunk_id"),
        "type",
        "text_plain",
        F.when(F.col("_original") != "", F.col("_original")).otherwise(F.col("text_plain")).alias("text_original"),
        level.alias("heading_level"),
        F.when(F.col("type") == "heading", X.numbered_label("text_plain")).alias("heading_label"),
        F.when(F.col("type") == "paragraph", X.key_values("text_plain")).alias("key_values"),
        F.coalesce("ordered", F.lit(False)).alias("ordered"),
        "items",
        "rows",
        F.when(F.col("type") == "table", F.coalesce(F.try_element_at("rows", F.lit(1)), F.array().cast("array<string>"))).alias("headers"),
        F.when(F.col("type") == "table", F.greatest(F.size("rows") - 1, F.lit(0))).alias("row_count"),
        F.when(F.col("type") == "table", F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))).alias("column_count"),
        "language",
        "filename",
        "line_count",
        "functions",
        "classes",
        "imports",
        "definitions",
        "src",
        "alt",
        "caption",
        "page_number",
        "source_location",
        "confidence",
        F.lit(None).cast("string").alias("intro_text"),
        *(["about"] if "about" in raw.columns else []),
    )


def counted(blocks: DataFrame) -> DataFrame:
    """char_count, word_count, token_count_est and embedding_ready from the final text."""
    rows = blocks.withColumn("char_count", F.length("text_plain")).withColumn("word_count", X.word_count("text_plain"))
    return rows.withColumn("token_count_est", X.tokens_of_words(F.col("word_count"))).withColumn("embedding_ready", ~F.col("type").isin(*K.NOT_EMBEDDED))


def merge_labels(blocks: DataFrame) -> DataFrame:
    """A paragraph of at most five words that ends with a colon joins the list right after it; its own row goes."""
    label = (F.col("type") == "paragraph") & (X.word_count("text_plain") <= 5) & F.col("text_plain").rlike(f":[{X.WS}]*\\z")
    rows = blocks.withColumn("_joins", F.coalesce(label & (F.lead("type").over(by_doc()) == "list"), F.lit(False)))
    rows = rows.withColumn("_label", F.lag(F.when(F.col("_joins"), F.struct("text_plain", "text_original"))).over(by_doc()))
    has = F.col("_label").isNotNull()
    return (
        rows.where(~F.col("_joins"))
        .withColumn("intro_text", F.col("_label.text_plain"))
        .withColumn("text_plain", F.when(has, F.concat(F.col("_label.text_plain"), F.lit("\n"), F.col("text_plain"))).otherwise(F.col("text_plain")))
        .withColumn("text_original", F.when(has, F.concat(F.col("_label.text_original"), F.lit("\n"), F.col("text_original"))).otherwise(F.col("text_original")))
        .drop("_joins", "_label")
    )


def linked(blocks: DataFrame) -> DataFrame:
    """prev_chunk_id, next_chunk_id and the preview of both neighbours."""
    near = lambda f, c: f(c).over(by_doc())
    preview = F.concat(
        F.coalesce(F.substring(near(F.lag, "text_plain"), 1, 50), F.lit("")), F.lit(" | "), F.coalesce(F.substring(near(F.lead, "text_plain"), 1, 50), F.lit(""))
    )
    return blocks.withColumns(
        {
            "prev_chunk_id": near(F.lag, "chunk_id"),
            "next_chunk_id": near(F.lead, "chunk_id"),
            "surrounding_text_preview": F.regexp_replace(preview, r"^[ |]+|[ |]+\z", ""),
        }
    )


def with_parent_heading(blocks: DataFrame) -> DataFrame:
    """The nearest heading before; for a heading the nearest of a lower level.

    One running maximum for each level that can occur replaces a search backwards.
    """
    place = F.struct("ordinal", "chunk_id")
    running = [F.max(F.when((F.col("type") == "heading") & (F.col("heading_level") == n), place)).over(before()).alias(f"_h{n}") for n in range(1, 10)]
    rows = blocks.select("*", *running)
    above = F.lit(None).cast(rows.schema["_h1"].dataType)
    chain = above
    for n in range(9, 0, -1):
        lower = [F.col(f"_h{k}") for k in range(1, n)]
        best = F.greatest(*lower) if len(lower) > 1 else lower[0] if lower else above
        chain = F.when(F.col("heading_level") == n, best).otherwise(chain)
    nearest = F.greatest(*[F.col(f"_h{n}") for n in range(1, 10)])
    parent = F.when(F.col("type") == "heading", chain["chunk_id"]).otherwise(nearest["chunk_id"])
    return rows.withColumn("parent_heading_chunk_id", parent).drop(*[f"_h{n}" for n in range(1, 10)])


def canonical_blocks(raw: DataFrame) -> DataFrame:
    """Raw blocks (doc_id, ordinal, fields) to blocks; all windows share one shuffle by doc_id."""
    return with_parent_heading(linked(counted(merge_labels(base_blocks(raw)))))


def with_content(blocks: DataFrame) -> DataFrame:
    """`blocks` with content: the fields of each one's type as a JSON object, {} for dividers, the text for other types."""

    def fields(**columns: Column | str) -> Column:
        return F.to_json(F.struct(*[(F.lit(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})

    text, none, no_rows = F.col("text_plain"), F.lit(None).cast("string"), F.array().cast("array<array<string>>")
    rows = F.coalesce("rows", no_rows)
    lines = F.transform(F.split("text_original", "\n"), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("text")))
    names = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("functions", "classes", "imports")}
    number = F.col("ordinal").cast("string")
    image_id = F.concat(F.lit("img-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    of_type = {
        "heading": fields(text=text, level=F.col("heading_level"), numbered=F.col("heading_label").isNotNull(), label=F.col("heading_label")),
        "paragraph": fields(text=text, sentences=X.sentences("text_plain")),
        "code_block": fields(code=F.col("text_original"), language=F.col("language"), filename=F.col("filename"), line_numbers=F.lit(False), lines=lines, line_count=F.col("line_count"), **names),
        "list": fields(list_type=F.when(F.col("ordered"), "ordered").otherwise("unordered"), items=F.col("items")),
        "table": fields(
            headers=F.col("headers"), rows=F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), cells=rows, row_count=F.col("row_count"),
            header_row_count=(F.size("headers") > 0).cast("int"), column_count=F.col("column_count"),
        ),
        "definition_list": fields(items=F.col("definitions")),
        "quote": fields(text=text, attribution=none, source=none, cite_chunk_id=none),
        "image_placeholder": fields(image_id=image_id, image_uri=F.coalesce("src", F.lit("")), alt_text=F.coalesce("alt", F.lit(""))),
        "figure": fields(image_uri=F.coalesce("src", F.lit("")), alt_text=F.coalesce("alt", F.lit("")), caption=F.col("caption")),
        "divider": F.lit("{}"),
    }
    out = fields(text=text)
    for kind, made in of_type.items():
        out = F.when(F.col("type") == kind, made).otherwise(out)
    return blocks.withColumn("content", out)


def paragraph_groups(blocks: DataFrame) -> DataFrame:
    """Runs of two or more paragraphs in a row as one text: doc_id, first and last ordinal, n_paragraphs, text."""
    is_p = F.col("type") == "paragraph"
    run = F.row_number().over(by_doc()) - F.row_number().over(Window.partitionBy("doc_id", "_p").orderBy("ordinal"))
    rows = blocks.withColumn("_p", is_p).withColumn("_run", run).where("_p")
    texts = F.array_sort(F.collect_list(F.struct("ordinal", "text_plain")))
    grouped = rows.groupBy("doc_id", "_run").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("n_paragraphs"), texts.alias("_t"))
    return grouped.where("n_paragraphs > 1").select("doc_id", "first_ordinal", "last_ordinal", "n_paragraphs", F.array_join(F.col("_t.text_plain"), "\n\n").alias("text"))


def table_records(blocks: DataFrame) -> DataFrame:
    """A row for each data row of each table, as a map from header to cell; cells beyond the headers are left out."""
    rows = blocks.where((F.col("type") == "table") & (F.size("rows") > 1)).select("doc_id", "ordinal", "headers", F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("row", "cells"))
    n = F.least(F.size("headers"), F.size("cells"))
    pairs = F.zip_with(F.slice("headers", 1, n), F.slice("cells", 1, n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    names = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1)
    return rows.select("doc_id", "ordinal", "row", F.map_from_entries(first).alias("record"))


def table_markdown(blocks: DataFrame) -> DataFrame:
    """Each table as Markdown."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("headers", lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    body = F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), line)
    out = F.array_join(F.concat(F.array(line(F.col("headers")), rule), body), "\n")
    return blocks.where((F.col("type") == "table") & (F.size("rows") > 0)).select("doc_id", "ordinal", out.alias("markdown"))


def table_html(blocks: DataFrame) -> DataFrame:
    """Each table as HTML, with its number in the document: doc_id, ordinal, table_id, html."""
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def line(cells: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    body = F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: line(r, "td")), "")
    html = F.concat(F.lit("<table><thead>"), line(F.col("headers"), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))
    n = F.row_number().over(by_doc()).cast("string")
    table_id = F.concat(F.lit("tbl-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
    return blocks.where((F.col("type") == "table") & (F.size("rows") > 0)).select("doc_id", "ordinal", table_id.alias("table_id"), html.alias("html"))


def table_grid(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, table, row, col, text, rowspan, colspan) on a full grid: every covered place has the cell's text.

    Where spans overlap the cell that starts later in reading order wins. has_merged_cells is per table.
    """
    spans = cells.withColumn("_r", F.explode(F.sequence(F.lit(0), F.greatest(F.col("rowspan"), F.lit(1)) - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.greatest(F.col("colspan"), F.lit(1)) - 1)))
    placed = spans.groupBy("doc_id", "table", (F.col("row") + F.col("_r")).alias("grid_row"), (F.col("col") + F.col("_c")).alias("grid_col")).agg(
        F.max_by("text", F.struct("row", "col")).alias("text"), F.max((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("merged")
    )
    per_table = Window.partitionBy("doc_id", "table")
    return placed.select("doc_id", "table", "grid_row", "grid_col", "text", F.max("merged").over(per_table).alias("has_merged_cells"), (F.max("grid_col").over(per_table) + 1).alias("column_count"))
