"""What is computed about documents: references, dates, statistics, metadata, quality."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as X
from docloom.operators.blocks import by_doc

TRAILING = ".,;:!?)"


def reference_matches(blocks: DataFrame) -> DataFrame:
    """Every match of the reference patterns: doc_id, ordinal, chunk_id, pattern (its number), pos, type, target, context.

    Spark's regular expressions give no offsets, so the matching is an Arrow pass
    over the blocks that hold a likely character.
    """
    compiled = [(k, name, re.compile(p)) for k, (name, p) in enumerate(K.REFERENCE_PATTERNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "ordinal", "chunk_id", "pattern", "pos", "type", "target", "context"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, ordinal, chunk, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, name, pattern in compiled:
                    for m in pattern.finditer(text):
                        rows.append((doc_id, ordinal, chunk, k, m.start(), name, m.group(0).rstrip(TRAILING), text[max(0, m.start() - 30) : m.end() + 30]))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    likely = blocks.where(F.col("text_plain").rlike(r"[@:]|10\.\d"))
    schema = "doc_id long, ordinal int, chunk_id string, pattern int, pos int, type string, target string, context string"
    return likely.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), "chunk_id", "text_plain").mapInArrow(run, schema)


def cross_references(blocks: DataFrame) -> DataFrame:
    """The first match of each target in a document, numbered by seq."""
    place = ["ordinal", "pattern", "pos"]
    first = Window.partitionBy("doc_id", "target").orderBy(*place)
    rows = reference_matches(blocks).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*place))
    return rows.select("doc_id", seq.alias("seq"), "type", "target", "context", F.col("chunk_id").alias("source_chunk_id"))


def resolved_references(references: DataFrame, blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """References to block or section ids (doc_id, ref_id, target_id) with what they point at; unresolved ones stay."""
    b = blocks.select("doc_id", F.col("chunk_id").alias("target_id"), F.col("type").alias("target_type"))
    n = tree.select("doc_id", F.col("node_id").alias("target_id"), F.col("title").alias("target_heading"))
    rows = references.join(b, ["doc_id", "target_id"], "left").join(n, ["doc_id", "target_id"], "left")
    return rows.withColumn("resolved", F.col("target_type").isNotNull() | F.col("target_heading").isNotNull())


def footnote_links(blocks: DataFrame) -> DataFrame:
    """Footnotes with the blocks that refer to them as [n]: doc_id, footnote chunk, marker, referring chunk."""
    marker = F.regexp_extract("text_plain", r"^\[?(\d+)[\].):]?\s", 1)
    notes = blocks.where("type = 'footnote'").select("doc_id", F.col("chunk_id").alias("footnote_chunk_id"), marker.alias("marker")).where("marker <> ''")
    marks = F.explode(F.array_distinct(F.regexp_extract_all("text_plain", F.lit(r"\[(\d+)\]"), F.lit(1))))
    cites = blocks.where("type <> 'footnote'").select("doc_id", F.col("chunk_id").alias("referenced_by"), marks.alias("marker"))
    return notes.join(cites, ["doc_id", "marker"])


def document_dates(blocks: DataFrame) -> DataFrame:
    """doc_id and the dates among the first 5000 characters of the document's text, in order."""
    # 5000 characters never need more than 5000 blocks
    start = F.sum(F.length("text_plain") + 1).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    head = blocks.withColumn("_at", F.coalesce(start, F.lit(0))).where("_at < 5000")
    texts = F.array_sort(F.collect_list(F.struct("ordinal", "text_plain")))
    return head.groupBy("doc_id").agg(texts["text_plain"].alias("_t")).select("doc_id", first_dates(F.col("_t")).alias("dates"))


def first_dates(texts: Column) -> Column:
    """The dates among the first 5000 characters of a document, given as its blocks' texts in order."""
    return X.dates(F.substring(F.array_join(F.slice(texts, 1, 5000), " "), 1, 5000))


def statistics(blocks: DataFrame) -> DataFrame:
    """Counts of a document, in one aggregation."""
    kind = lambda t: F.count_if(F.col("type") == t)
    return blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("block_count"),
        kind("heading").alias("section_count"),
        kind("table").alias("table_count"),
        kind("figure_caption").alias("figure_count"),
        kind("footnote").alias("footnote_count"),
        F.sum("char_count").alias("total_char_count"),
        F.sum("token_count_est").alias("total_token_count_est"),
        F.sum("word_count").alias("total_word_count"),
    )


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count_est").alias("tokens"))


def described(parsed: DataFrame) -> DataFrame:
    """`parsed` with about: a struct of the document's title, author, source, dates, language and so on, each the first
    non-empty of the places that can name it."""

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(k)), F.lit("")) for k in keys])

    filename = F.regexp_extract("path", r"([^/]*)$", 1)
    source = first("source")
    several = F.coalesce(first("multilingual") == "true", F.lit(False))
    fields = {
        "path": F.col("path"),
        "mime_type": F.col("mime_type"),
        "title": F.coalesce(first("title", "Title"), F.nullif(filename, F.lit(""))),
        "subtitle": first("subtitle", "Subject"),
        "author": first("author", "creator"),
        "declared_source": F.coalesce(source, F.col("path")),
        "source_type": F.when(source.isNotNull(), "frontmatter").otherwise("filesystem"),
        "created": X.date_field(first("created", "date")),
        "modified": X.date_field(first("modified")),
        "published": first("published"),
        "language": F.when(several, "multilingual").otherwise("en"),
        "language_confidence": F.when(several, 0.95).otherwise(0.99),
        "declared_language": first("language"),
        "page_count": F.coalesce(first("page_count").cast("int"), F.lit(0)),
        "classification": F.struct(
            F.coalesce(first("doc_type"), F.lit("unknown")).alias("doc_type"), first("genre").alias("genre"), F.filter(F.transform(F.split(F.coalesce(first("keywords"), F.lit("")), ","), X.strip), lambda k: k != "").alias("keywords")
        ),
        "rights": F.struct(first("license").alias("license"), first("copyright").alias("copyright"), F.lit(True).alias("open_access")),
        "error": F.col("error"),
    }
    return parsed.withColumn("about", F.struct(*[c.alias(n) for n, c in fields.items()]))


def published(about: Column, dates: Column) -> Column:
    """`about` whose publication date, where none is given, is the first of the dates in the text."""
    return about.withField("published", F.coalesce(about["published"], F.try_element_at(dates, F.lit(1))))


def metadata(parsed: DataFrame, dates: DataFrame) -> DataFrame:
    """A row for each document: the fields of `described`, with its dates (doc_id, dates)."""
    rows = described(parsed).select("doc_id", "about").join(dates, "doc_id", "left")
    return rows.select("doc_id", published(F.col("about"), F.col("dates")).alias("about")).select("doc_id", "about.*")


def structure_scores(blocks: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """1 less half the share of headings that skip a level; without headings 0.5 if the document has a row in `sections`, else 0.3."""
    headings = blocks.where("type = 'heading'")
    skip = F.col("heading_level") - F.lag("heading_level").over(by_doc()) > 1
    marked = headings.withColumn("_skip", F.coalesce(skip, F.lit(False)).cast("int"))
    scored = marked.groupBy("doc_id").agg((1 - 0.5 * F.sum("_skip") / F.count(F.lit(1))).alias("score"))
    rows = blocks.select("doc_id").distinct().join(scored, "doc_id", "left")
    flat = F.lit(0.3)
    if sections is not None:
        rows = rows.join(sections.select("doc_id", F.lit(0.5).alias("flat")).distinct(), "doc_id", "left")
        flat = F.coalesce("flat", flat)
    return rows.select("doc_id", F.coalesce("score", flat).alias("structure_score"))


def completeness(issues: DataFrame) -> DataFrame:
    """1 less 0.2 for each error and 0.05 for each warning, less at most a half (issues: doc_id, severity)."""
    cost = F.sum(F.when(F.col("severity") == "error", 0.2).when(F.col("severity") == "warning", 0.05).otherwise(0.0))
    return issues.groupBy("doc_id").agg((1 - F.least(F.lit(0.5), cost)).alias("completeness"))


INLINE = (
    ("bold", r"\*\*([^*]+)\*\*"),
    ("italic", r"(?<!\*)\*([^*]+)\*(?!\*)"),
    ("code", r"`([^`]+)`"),
    ("highlight", r"==([^=]+)=="),
    ("strikethrough", r"~~([^~]+)~~"),
    ("link", r"(\S+) \[((?:https?:|/)[^\]]*)\]"),
)


def inline_marks(blocks: DataFrame) -> DataFrame:
    """Emphasis, code and links that a paragraph's plain text marks: doc_id, ordinal, type, start, end (of the whole mark), text, href.

    Offsets need matches with places, so this is an Arrow pass over the paragraphs that hold a mark.
    """
    compiled = [(kind, re.compile(p)) for kind, p in INLINE]
    names = ["doc_id", "ordinal", "type", "start", "end", "text", "href"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ordinal, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind, pattern in compiled:
                    rows += [(doc_id, ordinal, kind, m.start(), m.end(), m.group(1), m.group(2) if kind == "link" else None) for m in pattern.finditer(text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    marked = blocks.where("type = 'paragraph'").where(F.col("text_plain").rlike(r"[*`\[]|==|~~"))
    schema = "doc_id long, ordinal int, type string, start int, end int, text string, href string"
    return marked.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), "text_plain").mapInArrow(run, schema)
