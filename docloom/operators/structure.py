"""Section trees by window functions: paths, nodes, heading map, boundaries, contents.

A document's tree is the table of its nodes with their paths. The ancestor at
dense level j of a row is the latest heading of level j before it, unless a
heading of a lower level came later; that takes one running maximum for each
level, in one pass over the blocks of a document, and no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.blocks import by_doc

MAX_LEVEL = 9


def doc():
    return Window.partitionBy("doc_id")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def _padded(n: Column) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def node_type(level: Column) -> Column:
    return F.when(level == 0, "document").when(level == 1, "section").when(level == 2, "subsection").when(level <= 6, "subsubsection").otherwise("section")


def dense_levels(blocks: DataFrame) -> DataFrame:
    """`blocks` with dense_level: the document's distinct heading levels ranked from 1; null for other blocks."""
    heading = F.col("type") == "heading"
    # a dense rank over all rows would count the nulls of other blocks; they sort last and rank after
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("_hl").asc_nulls_last()))
    return blocks.withColumn("_hl", F.when(heading, F.col("heading_level"))).withColumn("dense_level", F.when(heading, rank)).drop("_hl")


def with_sections(blocks: DataFrame) -> DataFrame:
    """`blocks` with node_id, structure_path, heading_path (the titles along it), section_role and parent_structure_node_id
    (null in documents without headings)."""
    heading = F.col("type") == "heading"
    rows = dense_levels(blocks).withColumn("_k", F.sum(heading.cast("int")).over(so_far()))
    rows = rows.withColumn("_node", F.when(heading, F.concat(F.lit("sec-"), _padded(F.col("_k") - 1))))
    running = [F.max(F.when(F.col("dense_level") == n, F.struct("ordinal", F.col("_node").alias("node"), F.col("text_plain").alias("title")))).over(so_far()).alias(f"_a{n}") for n in range(1, MAX_LEVEL + 1)]
    rows = rows.select("*", F.max(heading.cast("int")).over(doc()).alias("_any"), *running)
    # one fold over the levels: an ancestor counts if it stands after all those above it
    start = F.struct(F.lit(-1).alias("latest"), F.array(F.lit("root")).alias("path"), F.array().cast("array<string>").alias("titles"))

    def step(s: Column, a: Column) -> Column:
        deeper = F.struct(a["ordinal"].alias("latest"), F.concat(s["path"], F.array(a["node"])).alias("path"), F.concat(s["titles"], F.array(a["title"])).alias("titles"))
        return F.when(a.isNotNull() & (a["ordinal"] > s["latest"]), deeper).otherwise(s)

    place = F.aggregate(F.array(*[f"_a{n}" for n in range(1, MAX_LEVEL + 1)]), start, step)
    rows = rows.withColumn("_place", place).withColumn("structure_path", F.col("_place.path")).withColumn("node_id", F.element_at("structure_path", -1))
    rows = rows.withColumn("heading_path", F.filter("_place.titles", lambda t: t != ""))
    rows = rows.withColumn("parent_structure_node_id", F.when(F.col("_any") == 1, F.col("node_id")))
    rows = rows.withColumn("section_role", F.when(heading, X.section_role("text_plain")))
    return rows.drop("_k", "_node", "_any", "_place", *[f"_a{n}" for n in range(1, MAX_LEVEL + 1)])


def nodes(sections: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each node that owns blocks or is a root: ids, path, title, level, its own chunk ids in order, token sum, ordinals.

    The root's title is the document's first block, cut at 100 characters, if the
    first heading is not of the first dense level. With `keep`, the nodes' own
    blocks come along as `blocks`, structs of these columns, and `about` where the
    sections have it; a row without an ordinal stands for a document without blocks.
    """
    heading = F.col("type") == "heading"
    level1 = F.min_by("dense_level", F.when(heading, F.col("ordinal"))).over(doc())
    first = F.min_by("text_plain", "ordinal").over(doc())
    begins = F.col("ordinal") == F.min("ordinal").over(doc())
    here = F.struct("node_id", F.lit(True).alias("own"))
    root = F.struct(F.lit("root").alias("node_id"), F.lit(False).alias("own"))
    # a document's first block also stands for its root, which may own nothing: all in the one partitioning by document
    at = F.explode(F.when(F.col("_begins") & (F.col("node_id") != "root"), F.array(here, root)).otherwise(F.array(here)))
    rows = sections.withColumns({"_root_title": F.when(level1 > 1, F.substring(first, 1, 100)).otherwise(""), "_begins": begins}).withColumn("_at", at)

    def mine(c) -> Column:
        return F.when(F.col("_at.own") & F.col("ordinal").isNotNull(), c)

    is_root = F.col("node_id") == "root"
    tree = rows.groupBy("doc_id", F.col("_at.node_id").alias("node_id")).agg(
        F.max(mine(F.col("structure_path"))).alias("path"),  # the same for all rows of a node
        F.max(mine(F.when(heading, F.col("text_plain")))).alias("title"),
        F.max("_root_title").alias("_root_title"),
        F.max(mine(F.col("dense_level"))).alias("level"),
        F.array_sort(F.collect_list(mine(F.struct("ordinal", "chunk_id")))).alias("_ids"),
        F.sum(mine(F.col("token_count_est"))).alias("token_count_est"),
        *[f(mine(F.col(c))).alias(n) for f, c, n in ((F.min, "ordinal", "first_ordinal"), (F.max, "ordinal", "last_ordinal"), (F.min, "page_number", "page_start"), (F.max, "page_number", "page_end"))],
        *([F.collect_list(mine(F.struct(*keep))).alias("blocks"), F.first("about", ignorenulls=True).alias("about")] if keep else []),
    )
    tree = tree.withColumns(
        {
            "path": F.when(is_root, F.array(F.lit("root"))).otherwise(F.col("path")),
            "title": F.coalesce(F.when(is_root, F.col("_root_title")).otherwise(F.col("title")), F.lit("")),
            "level": F.when(is_root, 0).otherwise(F.col("level")),
            "token_count_est": F.coalesce("token_count_est", F.lit(0)).cast("long"),
        }
    )
    return tree.select(
        "doc_id", "node_id", F.try_element_at("path", F.lit(-2)).alias("parent_id"), node_type(F.col("level")).alias("node_type"), "title", "level", "path",
        F.col("_ids.chunk_id").alias("chunk_ids"), "token_count_est", "first_ordinal", "last_ordinal", "page_start", "page_end", *(("blocks", "about") if keep else ()),
    )


def heading_map(tree: DataFrame) -> DataFrame:
    """Titled nodes that own blocks: their first chunk, text, level; in reading order by first_ordinal."""
    return tree.where((F.col("title") != "") & (F.size("chunk_ids") > 0)).select(
        "doc_id", F.element_at("chunk_ids", 1).alias("chunk_id"), F.col("title").alias("heading_text"), "level", "node_id", "first_ordinal"
    )


def boundaries(tree: DataFrame) -> DataFrame:
    """For each section with blocks of its own: first and last of them, and their tokens."""
    return tree.where((F.col("node_id") != "root") & (F.size("chunk_ids") > 0)).select(
        "doc_id", "node_id", F.element_at("chunk_ids", 1).alias("start_chunk_id"), F.element_at("chunk_ids", -1).alias("end_chunk_id"), F.lit("section").alias("boundary_type"), "token_count_est", "first_ordinal"
    )


def contents(tree: DataFrame) -> DataFrame:
    """Table of contents: level, title, section, in reading order."""
    return tree.where("node_id <> 'root'").select("doc_id", "first_ordinal", "level", "title", F.col("node_id").alias("section_id"))


def chunk_id_map(sections: DataFrame) -> DataFrame:
    """chunk_id, its path, its real position; `index` is 0 as consumers of the format expect."""
    return sections.select("doc_id", "chunk_id", F.lit(0).alias("index"), "structure_path", "ordinal")


def page_spans(sections: DataFrame) -> DataFrame:
    """First and last page of each node's whole subtree."""
    rows = sections.where(F.col("page_number").isNotNull()).select("doc_id", F.explode("structure_path").alias("node_id"), "page_number")
    return rows.groupBy("doc_id", "node_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


def paragraph_places(sections: DataFrame) -> DataFrame:
    """is_first_paragraph and is_last_paragraph within a node, and the node's role for every block of it."""
    role = F.first("section_role", ignorenulls=True).over(Window.partitionBy("doc_id", "node_id"))
    kind = Window.partitionBy("doc_id", "node_id", "type")
    paragraph = F.col("type") == "paragraph"
    return sections.withColumns(
        {
            "is_first_paragraph": paragraph & (F.min("ordinal").over(kind) == F.col("ordinal")),
            "is_last_paragraph": paragraph & (F.max("ordinal").over(kind) == F.col("ordinal")),
            "inherited_role": role,
        }
    )


def repaired_headings(blocks: DataFrame) -> DataFrame:
    """`blocks` with repaired_level, repaired_text and inferred: headings as they should have been.

    The distinct levels of a document close up from its lowest one on. If none of
    them is 1, a heading of level 1 is put before the first block (ordinal -1, null
    in other columns): the first text of more than three characters among headings
    and paragraphs, 100 of them at most. Paragraphs in capitals under 100
    characters become headings of level 2; in documents without any heading, those
    of 11 to 79 characters do, of level 1 among the first ten blocks. A column
    `style` that calls a paragraph title, subtitle or heading promotes it, too.
    """
    heading, paragraph = F.col("type") == "heading", F.col("type") == "paragraph"
    text = X.strip("text_plain")
    style = F.lower("style").isin("title", "subtitle", "heading") if "style" in blocks.columns else F.lit(False)
    any_heading = F.max(heading.cast("int")).over(doc()) == 1
    lowest = F.min(F.when(heading, F.col("heading_level"))).over(doc())
    loud = paragraph & X.is_upper("text_plain")
    with_others = paragraph & (F.length(text) < 100) & (X.is_upper("text_plain") | F.coalesce(style, F.lit(False)))
    alone = loud & (F.length(text) > 10) & (F.length(text) < 80)
    rows = dense_levels(blocks).withColumns({"_any": any_heading, "_low": lowest, "_text": text})
    promoted = F.when(F.col("_any") & with_others, 2).when(~F.col("_any") & alone, F.least(F.lit(2), 1 + F.floor(F.col("ordinal") / 10)).cast("int"))
    rows = rows.withColumn("_promoted", promoted)
    rows = rows.withColumns(
        {
            "repaired_level": F.when(heading, F.col("dense_level") + F.col("_low") - 1).otherwise(F.col("_promoted")),
            "repaired_text": F.when(F.col("_promoted").isNotNull() & X.is_upper("_text"), F.initcap(F.lower("_text"))).otherwise(F.col("text_plain")),
            "inferred": F.col("_promoted").isNotNull(),
        }
    )
    usable = F.when((heading | paragraph) & (F.length("_text") > 3), F.struct("ordinal", F.substring("_text", 1, 100).alias("t")))
    rows = rows.withColumns({"_title": F.min(usable).over(doc())["t"], "_first": F.col("ordinal") == F.min("ordinal").over(doc())})
    # the first block also stands for the title put before it
    here = F.struct(F.lit(False).alias("title"))
    rows = rows.withColumn("_is", F.explode(F.when(F.col("_first") & F.col("_any") & (F.col("_low") > 1), F.array(F.struct(F.lit(True).alias("title")), here)).otherwise(F.array(here))))
    new = {
        "ordinal": F.lit(-1), "type": F.lit("heading"), "repaired_level": F.lit(1), "repaired_text": F.coalesce("_title", F.lit("Untitled Document")), "inferred": F.lit(True),
    }
    out = [F.col("doc_id")]
    for c in (*(c for c in blocks.columns if c != "doc_id"), "repaired_level", "repaired_text", "inferred"):
        out.append(F.when(F.col("_is.title"), new.get(c)).otherwise(F.col(c)).alias(c) if c in new else F.when(~F.col("_is.title"), F.col(c)).alias(c))
    return rows.select(*out)


def list_items(blocks: DataFrame) -> DataFrame:
    """A row for each list item: item_id, text, level, marker, the list's start_number, and item_path and depth.

    The path is the numbers of the items that the item is nested in, from the flat
    levels, whatever their number: one fold over a list keeps the items that are
    still open, of which those of the new item's level or deeper close. A jump
    over levels counts as one.
    """
    lists = blocks.where("type = 'list'").select("doc_id", F.col("ordinal").alias("block"), F.coalesce("ordered", F.lit(False)).alias("ordered"), "items")
    levels = F.transform("items", lambda it: F.greatest(it["level"], it["depth"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<level:int,item:int>>").alias("open"), F.array().cast("array<array<int>>").alias("paths"))

    def step(s: Column, level: Column) -> Column:
        above = F.filter(s["open"], lambda o: o["level"] < level)
        now = F.concat(above, F.array(F.struct(level.cast("int").alias("level"), s["at"].alias("item"))))
        return F.struct((s["at"] + 1).alias("at"), now.alias("open"), F.concat(s["paths"], F.array(now["item"])).alias("paths"))

    rows = lists.select("doc_id", "block", "ordered", F.posexplode(F.arrays_zip("items", F.aggregate(levels, start, step, lambda s: s["paths"]).alias("path"))).alias("item", "x"))
    number = F.when(F.col("ordered"), F.lit(1))
    parent = F.slice("item_path", 1, F.greatest(F.size("item_path") - 1, F.lit(0)))
    rows = rows.select("doc_id", "block", "item", "ordered", F.greatest("x.items.level", "x.items.depth").alias("level"), F.col("x.items.text").alias("text"), F.col("x.path").alias("item_path"))
    place = F.row_number().over(Window.partitionBy("doc_id", "block", "parent").orderBy("item"))
    rows = rows.withColumn("parent", F.array_join(parent.cast("array<string>"), "."))
    marker = F.when(F.col("ordered"), F.concat(place.cast("string"), F.lit("."))).otherwise("•")
    n = (F.col("item") + 1).cast("string")
    item_id = F.concat(F.lit("li-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
    return rows.withColumns({"item_id": item_id, "marker": marker, "start_number": number, "depth": F.size("item_path") - 1}).drop("parent", "ordered")


def list_paths(blocks: DataFrame) -> DataFrame:
    """The items' places alone: doc_id, block, item, level, text, item_path, depth."""
    return list_items(blocks).select("doc_id", "block", "item", "level", "text", "item_path", "depth")


def anonymous_sections(sections: DataFrame) -> DataFrame:
    """Sections as groups of blocks, with a level-0 one for what stands before the first heading."""
    rows = sections.withColumn("section", F.when(F.col("node_id") == "root", "anonymous").otherwise(F.col("node_id")))
    return rows.groupBy("doc_id", "section").agg(
        F.coalesce(F.max("dense_level"), F.lit(0)).alias("level"), F.count(F.lit(1)).alias("n_blocks"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal")
    )
