"""Validation: independent issue tables, one readiness row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K

TOKEN_CEILING, CHUNK_CEILING, TINY = 4096, 2048, 10
ISSUE = ["doc_id", "kind", "path", "message"]
# Error codes of the taxonomy.
ERROR_CODES = (
    "DETECT_001", "DETECT_002", "EXTRACT_001", "EXTRACT_002", "EXTRACT_003", "STRUCT_001", "STRUCT_002",
    "NORM_001", "OCR_001", "VALIDATE_001", "VALIDATE_002", "IO_001", "UNKNOWN",
)


def _issue(rows: DataFrame, kind: str, path, message) -> DataFrame:
    return rows.select("doc_id", F.lit(kind).alias("kind"), path.alias("path"), message.alias("message"))


def missing_fields(blocks: DataFrame) -> DataFrame:
    """Required fields that are null and counts that are negative."""
    rules = [(f"missing {c}", F.col(c).isNull()) for c in ("chunk_id", "type", "text_plain", "char_count", "token_count_est", "embedding_ready")]
    rules += [(f"{c} below 0", F.col(c) < 0) for c in ("char_count", "token_count_est")]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules]))
    rows = blocks.withColumn("_m", F.explode(found))
    return _issue(rows, "schema", F.concat(F.lit("blocks["), F.col("ordinal"), F.lit("]")), F.col("_m"))


def strict_types(blocks: DataFrame) -> DataFrame:
    """Block types outside the schema's list: an opt-in rule, since readers accept them."""
    rows = blocks.where(~F.col("type").isin(*K.BLOCK_TYPES))
    return _issue(rows, "enum", F.col("chunk_id"), F.concat(F.lit("type "), F.col("type")))


# Patterns of the full schema's fields.
SHA256, LANGUAGE, DATE = r"^[a-f0-9]{64}$", r"^[a-z]{2}(-[A-Z]{2})?$", r"^\d{4}-\d{2}-\d{2}(T.*)?$"
NODE_TYPES = ("document", "section", "subsection", "subsubsection")


def schema_issues(blocks: DataFrame, metadata: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """What breaks the full schema: an opt-in rule set over blocks, documents' metadata and nodes, as far as their tables have the columns.

    Blocks: types of the list, levels 1 to 6, confidence 0 to 1, pages from 1, ids
    of their pattern. Metadata: title not blank, language, date and checksum of
    their patterns where they are not null. Nodes: types of the list, levels from
    0, a path that ends with the node.
    """
    def rules(df: DataFrame, path, *found) -> DataFrame:
        live = [F.when(bad, F.lit(text)) for needs, bad, text in found if needs in df.columns]
        rows = df.withColumn("_m", F.explode(F.array_compact(F.array(*live, F.lit(None).cast("string")))))
        return _issue(rows, "schema", path, F.col("_m"))

    def unlike(c: str, pattern: str):
        return F.col(c).isNotNull() & ~F.col(c).rlike(pattern)

    out = rules(
        blocks, F.concat(F.lit("blocks["), F.col("ordinal"), F.lit("]")),
        ("chunk_id", unlike("chunk_id", r"^blk-\d{3,}$"), "chunk_id is no block id"),
        ("type", ~F.col("type").isin(*K.BLOCK_TYPES), "type is not in the list"),
        ("heading_level", ~F.col("heading_level").between(1, 6), "heading_level is not 1 to 6"),
        ("confidence", ~F.col("confidence").between(0, 1), "confidence is not 0 to 1"),
        ("page_number", F.col("page_number") < 1, "page_number is below 1"),
        ("rows", (F.col("type") == "table") & (F.size("rows") < 1), "rows is empty"),
        ("items", (F.col("type") == "list") & (F.size("items") < 1), "items is empty"),
    )
    if metadata is not None:
        out = out.unionByName(rules(
            metadata, F.lit("metadata"),
            ("title", F.col("title").isNull() | (F.trim("title") == ""), "title is blank"),
            ("language", unlike("language", LANGUAGE), "language is no language tag"),
            ("published", unlike("published", DATE), "published is no date"),
            ("checksum_sha256", unlike("checksum_sha256", SHA256), "checksum_sha256 is no checksum"),
        ))
    if nodes is not None:
        out = out.unionByName(rules(
            nodes, F.concat(F.lit("structure."), F.col("node_id")),
            ("node_type", ~F.col("node_type").isin(*NODE_TYPES), "node_type is not in the list"),
            ("level", F.col("level") < 0, "level is below 0"),
            ("path", F.element_at("path", -1) != F.col("node_id"), "path does not end with the node"),
        ))
    return out


def duplicate_ids(blocks: DataFrame) -> DataFrame:
    rows = blocks.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _issue(rows, "duplicate", F.col("chunk_id"), F.concat(F.col("n"), F.lit(" blocks have this id")))


def wrong_counts(blocks: DataFrame) -> DataFrame:
    rows = blocks.where(F.col("char_count") != F.length("text_plain"))
    return _issue(rows, "char_count", F.col("chunk_id"), F.concat(F.lit("char_count "), F.col("char_count"), F.lit(" is not "), F.length("text_plain")))


def orphan_candidates(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Candidates (doc_id, chunk_id) without a block."""
    rows = candidates.join(blocks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    return _issue(rows, "candidate", F.col("chunk_id"), F.lit("no such block"))


def readiness(blocks: DataFrame, sections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seven flags for each document, and `ml_ready` from the first four.

    sections: doc_id and chunk_id of the blocks that the structure covers.
    """
    per_doc = blocks.groupBy("doc_id").agg(
        (F.count(F.lit(1)) > 0).alias("has_blocks"),
        F.bool_and(F.trim("text_plain") != "").alias("no_empty_text"),
        F.bool_and(F.col("token_count_est") <= TOKEN_CEILING).alias("tokens_in_range"),
    )
    has_structure = sections.select("doc_id").distinct().withColumn("has_structure", F.lit(True))
    has_candidates = candidates.select("doc_id").distinct().withColumn("has_candidates", F.lit(True))
    uncovered = blocks.select("doc_id", "chunk_id").join(sections.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti").select("doc_id").distinct().withColumn("_gap", F.lit(True))
    rows = per_doc.join(has_structure, "doc_id", "left").join(has_candidates, "doc_id", "left").join(uncovered, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_structure", "has_candidates")})
    rows = rows.withColumn("structure_covers_blocks", F.col("_gap").isNull()).drop("_gap")
    return rows.withColumn("ml_ready", F.col("has_blocks") & F.col("has_structure") & F.col("has_candidates") & F.col("no_empty_text"))


def chunk_readiness(chunks: DataFrame) -> DataFrame:
    """Per document: chunks in range, none empty, all with a heading path, and a warning if over a tenth are tiny."""
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.bool_and(F.col("token_count_est") <= CHUNK_CEILING).alias("tokens_in_range"),
        F.bool_and(F.trim("text") != "").alias("no_empty_text"),
        F.bool_and(F.size("heading_path") > 0).alias("all_have_heading_path"),
        (F.avg((F.col("token_count_est") < TINY).cast("int")) > 0.1).alias("many_tiny"),
    )


def roundtrip_scores(originals: DataFrame, stats: DataFrame) -> DataFrame:
    """How much of the original survives: text 0.5, headings 0.3, metadata 0.2 (originals: doc_id, n_chars, n_headings, has_title)."""
    rows = originals.join(stats.select("doc_id", "total_char_count", "section_count"), "doc_id", "left")
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(F.least(F.coalesce(a, F.lit(0)) / b, F.lit(1.0)))
    coverage, headings = share(F.col("total_char_count"), F.col("n_chars")), share(F.col("section_count"), F.col("n_headings"))
    meta = F.when(F.col("has_title"), 1.0).otherwise(0.0)
    rows = rows.select("doc_id", coverage.alias("text_coverage"), headings.alias("heading_ratio"), meta.alias("metadata_score"))
    return rows.withColumn("score", 0.5 * F.col("text_coverage") + 0.3 * F.col("heading_ratio") + 0.2 * F.col("metadata_score")).withColumn("passes", F.col("text_coverage") > 0.85)


def report(issues: DataFrame, ready: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each document: validity, readiness, numbers of issues and blocks."""
    counts = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issue_count"))
    rows = stats.join(ready, "doc_id", "left").join(counts, "doc_id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    return rows.select("doc_id", (F.col("issue_count") == 0).alias("schema_valid"), F.coalesce("ml_ready", F.lit(False)).alias("ml_ready"), "issue_count", "block_count", "section_count", "total_token_count_est")


# What each code stands for (by the name of the error or a part of its message), and whether a part of the document is left.
ERRORS = (
    ("DETECT_001", "unknown format|octet-stream", "failed"),
    ("DETECT_002", "format mismatch", "partial"),
    ("EXTRACT_001", "[Ee]ncrypted|[Pp]assword", "failed"),
    ("EXTRACT_002", "BadZipFile|KeyError|not a zip|[Cc]orrupt", "failed"),
    ("OCR_001", "[Tt]esseract|OCR", "partial"),
    ("STRUCT_001", "no headings", "partial"),
    ("STRUCT_002", "RecursionError|nesting", "partial"),
    ("NORM_001", "Unicode\\w*Error", "partial"),
    ("VALIDATE_001", "schema", "partial"),
    ("VALIDATE_002", "checksum|char_count", "partial"),
    ("IO_001", "EXTRACT_SIZE|FileNotFoundError|PermissionError|OSError|MemoryError", "failed"),
    ("EXTRACT_003", "ModuleNotFoundError|ImportError|ParseError|ValueError|Error", "failed"),
)


def error_issues(parsed: DataFrame) -> DataFrame:
    """Files that could not be parsed wholly, with a code and a status (failed or partial): such rows never fail a job."""
    code, status = F.lit("UNKNOWN"), F.lit("failed")
    for c, pattern, state in reversed(ERRORS):
        hit = F.col("error").rlike(pattern)
        code, status = F.when(hit, c).otherwise(code), F.when(hit, state).otherwise(status)
    rows = parsed.where(F.col("error").isNotNull()).withColumns({"_code": code, "_status": status})
    return rows.select("doc_id", F.lit("extract").alias("kind"), F.col("_code").alias("path"), F.col("error").alias("message"), F.col("_status").alias("status"))
