"""From files or text columns to raw blocks: one Arrow pass, where a real parser is needed."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom import schemas
from docloom.functions import constants as K
from docloom.functions.detect import extraction_mime, members, starts_with
from docloom.functions.python_text import normalize_whitespace
from docloom.sources import archives, html, lines, pdf

#: Rows and bytes of an Arrow batch: files must not pile up in a worker.
BATCH_ROWS, BATCH_BYTES = "256", "4194304"


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path and content of the files below `path`."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "content")


def clean(text: str | None) -> str | None:
    if text is None:
        return None
    return normalize_whitespace(text if text.isascii() else unicodedata.normalize("NFKC", text))


def _items(block: dict, depth: int = 0) -> list[dict]:
    """List items in reading order; nested lists follow their item, one deeper."""
    out = []
    for it in block.get("items") or []:
        out.append({"text": clean(it["text"]), "text_original": it["text"], "level": it.get("level", depth), "depth": depth})
        for inner in it.get("nested", ()):
            out += _items(inner, depth + 1)
    return out


def raw_row(block: dict) -> dict[str, Any]:
    row: dict[str, Any] = {f: block.get(f) for f in schemas.RAW_BLOCK.names}
    row["text_original"], row["text"] = block.get("text"), clean(block.get("text"))
    if block["type"] == "list":
        row["items"] = _items(block)
    if block["type"] == "definition_list":
        row["definitions"] = block.get("items") or [{"term": block.get("term") or "", "definition": block.get("definition") or ""}]
        row["items"] = None
    if block["type"] == "table":
        row["rows_original"] = block["rows"]
        row["rows"] = [[clean(c) for c in r] for r in block["rows"]]
    row["confidence"] = block.get("confidence", 0.95)
    row["source_location"] = block.get("source_location", "")
    return row


def parse(mime: str, content: bytes, path: str, closed_references: bool = False, blocks: bool = True) -> tuple[list[dict], dict]:
    if mime == "application/pdf":
        return pdf.parse_pdf(content)
    if mime == K.EPUB:
        return archives.parse_epub(content)
    if mime == K.DOCX:
        return archives.parse_docx(content)
    if mime == "text/html" and not blocks:
        return [], html.parse_metadata(content.decode("utf-8", "replace"), closed_references)
    if mime == "text/html":
        return html.parse_html(content.decode("utf-8", "replace"), closed_references=closed_references)
    return lines.parse_text(lines.decode(content), path)


def _flat(meta: dict) -> list[tuple[str, str]]:
    out = {}
    for k, v in meta.items():
        if v is not None:
            out[str(k)] = v if isinstance(v, str) else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v, ensure_ascii=False, default=str)
    return list(out.items())


PARSED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("meta", schemas.META),
        T.StructField("raw", T.ArrayType(schemas.RAW_BLOCK)),
        T.StructField("error", T.StringType()),
    ]
)


def extract(files: DataFrame, max_bytes: int | None = None, closed_references: bool = False, blocks: bool = True) -> DataFrame:
    """doc_id, path, mime_type, meta, raw (array of raw blocks), error for each row of doc_id, path, mime_type, content.

    A file that cannot be parsed gives no blocks and an error; it never fails the
    job. Files of any size are parsed, unless `max_bytes` sets a limit. HTML pages
    are read with `closed_references` as `html.tree` defines it. Without `blocks`
    the whole documents are parsed for their metadata, and raw is empty.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    kinds = {f.name: to_arrow_type(f.dataType) for f in PARSED.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for doc_id, path, mime, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, meta, error = [], {}, None
                try:
                    if max_bytes is not None and content is not None and len(content) > max_bytes:
                        raise ValueError("EXTRACT_SIZE: file too large")
                    found, meta = parse(mime or "text/plain", content or b"", path or "", closed_references, blocks)
                    raw = [raw_row(b) for b in found] if blocks else []
                except Exception as e:  # one bad file must not end the job
                    error = f"{type(e).__name__}: {e}"
                for k, v in (("doc_id", doc_id), ("path", path), ("mime_type", mime), ("meta", _flat(meta)), ("raw", raw), ("error", error)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    return files.select(F.col("doc_id").cast("long"), "path", "mime_type", "content").mapInArrow(run, PARSED)


def extract_files(files: DataFrame) -> DataFrame:
    """`extract` for rows of path and content: the format is detected, doc_id is a hash of path."""
    names = F.when(starts_with(F.col("content"), b"PK"), members(F.col("content"))["names"])
    rows = files.withColumn("_names", names)
    mime = extraction_mime(F.col("path"), F.col("content"), F.col("_names"))
    return extract(rows.select(F.xxhash64("path").alias("doc_id"), "path", mime.alias("mime_type"), "content"))


def extract_pages(pages: DataFrame, ocr: bool = False) -> DataFrame:
    """Raw blocks of texts of pages (doc_id, page, text), as a PDF reader or, with `ocr`, a recogniser gives them."""
    kinds = {"doc_id": pa.int64(), "page": pa.int32(), "raw": to_arrow_type(T.ArrayType(schemas.RAW_BLOCK))}
    parser = lines.parse_ocr if ocr else lines.parse_page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = (c.to_pylist() for c in batch.columns)
            raw = [[raw_row(b) for b in parser(t or "", n)] for n, t in zip(numbers, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, numbers, raw), kinds.values(), strict=True)], list(kinds))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType()), T.StructField("raw", T.ArrayType(schemas.RAW_BLOCK))])
    parsed = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text").mapInArrow(run, schema)
    rows = parsed.select("doc_id", "page", F.posexplode("raw").alias("_at", "b"))
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_at")) - 1).alias("ordinal"), "b.*")


def extract_texts(texts: DataFrame, mime: str, path: str = "", closed_references: bool = False, blocks: bool = True) -> DataFrame:
    """`extract` for rows of doc_id and text, all of one format."""
    files = texts.select("doc_id", F.lit(path).alias("path"), F.lit(mime).alias("mime_type"), F.col("text").cast("binary").alias("content"))
    return extract(files, closed_references=closed_references, blocks=blocks)


def raw_blocks(parsed: DataFrame) -> DataFrame:
    """A row for each raw block: doc_id, ordinal, its fields."""
    return parsed.select("doc_id", F.posexplode("raw").alias("ordinal", "b")).select("doc_id", "ordinal", "b.*")


def described_blocks(parsed: DataFrame) -> DataFrame:
    """`raw_blocks` that bring the column `about` along, on a document's last block (the label merge takes none that is last).

    A document without blocks is a row without an ordinal, so one pass over the
    parsed documents serves blocks and documents.
    """
    rows = parsed.select("doc_id", "about", F.size("raw").alias("_n"), F.posexplode_outer("raw").alias("ordinal", "b"))
    last = F.coalesce(F.col("ordinal") == F.col("_n") - 1, F.lit(True))
    return rows.select("doc_id", "ordinal", "b.*", F.when(last, F.col("about")).alias("about"))
