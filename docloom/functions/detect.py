"""Format detection as column expressions over a path and a file's bytes."""

from __future__ import annotations

import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions.text import WS

SAMPLE = 8192


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case, empty for none (a leading dot alone is none)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^./]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def mime_by_extension(path: Column) -> Column:
    return _lookup(extension(path), K.EXTENSION_MIME)


def code_language(path: Column) -> Column:
    return _lookup(extension(path), K.CODE_LANGUAGE)


def starts_with(content: Column, prefix: bytes) -> Column:
    return F.substring(content, 1, len(prefix)) == F.lit(prefix)


def members(content: Column) -> Column:
    """Names in a ZIP archive and its `mimetype` member; null if it is no readable archive. ZIP has no reader in Spark."""

    def read(rows: pd.Series) -> pd.DataFrame:
        out = []
        for b in rows:
            try:
                with zipfile.ZipFile(BytesIO(b)) as z:
                    names = z.namelist()
                    kind = z.read("mimetype").decode("utf-8", "replace").strip() if "mimetype" in names else None
                    out.append((names, kind))
            except (zipfile.BadZipFile, TypeError, OSError, RuntimeError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["names", "mimetype"])

    return F.pandas_udf(read, "names array<string>, mimetype string")(content)


def zip_kind(names: Column, mimetype: Column) -> Column:
    def has(n: str) -> Column:
        return F.array_contains(names, n)

    return (
        F.when(names.isNull(), "application/zip")
        .when(has("[Content_Types].xml") & has("word/document.xml"), K.DOCX)
        .when(has("[Content_Types].xml") & has("xl/workbook.xml"), K.XLSX)
        .when(F.coalesce(mimetype.contains("epub"), F.lit(False)), K.EPUB)
        .when(F.exists(names, lambda n: n.contains(".opf")), K.EPUB)
        .when(has("content.xml") & has("META-INF/manifest.xml"), K.ODT)
        .otherwise("application/zip")
    )


def is_text(content: Column) -> Column:
    """No NUL in the first 8 KiB, and valid UTF-8 or fewer than three in ten bytes above 127."""
    sample = F.substring(content, 1, SAMPLE)
    # Latin-1 maps bytes to characters one to one, so characters count bytes
    latin = F.decode(sample, "ISO-8859-1")
    high = F.length(latin) - F.length(F.regexp_replace(latin, r"[\x{80}-\x{ff}]", ""))
    return F.when(F.length(sample) == 0, True).when(F.locate("\x00", latin) > 0, False).when(F.is_valid_utf8(sample.cast("string")), True).otherwise(high / F.length(sample) < 0.3)


def text_kind(text: Column) -> Column:
    """Markdown, HTML, CSV or plain text by content: the caller gives the sample that detection reads."""
    lines = F.split(text, "\n", 51)

    def marked(line: Column) -> Column:
        out = F.lit(False)
        for s in K.MARKDOWN_STARTS:
            out = out | line.startswith(s)
        return out

    low = F.lower(text)
    # the first two lines that are not blank, without a look at the others
    rows = [F.regexp_extract(text, f"\\A[{WS}]*+{before}([^\\n]++)", 1) for before in ("", f"[^\\n]++\\n[{WS}]*+")]
    commas = [F.length(r) - F.length(F.replace(r, F.lit(","), F.lit(""))) for r in rows]
    csv = (commas[0] > 1) & (commas[1] == commas[0])
    return (
        F.when(F.exists(F.slice(lines, 1, 50), marked), "text/markdown")
        .when(low.contains("<html") | low.contains("<!doctype html"), "text/html")
        .when(F.coalesce(csv, F.lit(False)), "text/csv")
        .otherwise("text/plain")
    )


def mime_by_signature(content: Column, zip_mime: Column) -> Column:
    out = F.when(is_text(content), text_kind(F.make_valid_utf8(F.substring(content, 1, SAMPLE).cast("string"))))
    for prefix, mime in reversed(K.SIGNATURES):
        out = F.when(starts_with(content, prefix), zip_mime if mime == "application/zip" else F.lit(mime)).otherwise(out)
    return out


def confidence(by_extension: Column, by_signature: Column) -> Column:
    both = by_extension.isNotNull() & by_signature.isNotNull()
    return F.when(both & (by_extension == by_signature), 1.0).when(by_signature.isNotNull(), 0.70).when(by_extension.isNotNull(), 0.50).otherwise(0.10)


def confidence3(by_extension: Column, by_signature: Column, deep: Column) -> Column:
    """With a third vote by a deep look: all that voted agree, two agree, one alone."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return (
        F.when(same(by_extension, by_signature), 1.0)
        .when(same(by_signature, deep), 0.90)
        .when(by_signature.isNotNull(), 0.70)
        .when(deep.isNotNull(), 0.60)
        .when(by_extension.isNotNull(), 0.50)
        .otherwise(0.10)
    )


def encoding(content: Column) -> Column:
    return F.when(starts_with(content, b"\xef\xbb\xbf"), "utf-8-sig").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


def extraction_mime(path: Column, content: Column, names: Column) -> Column:
    """The format that extraction follows: a known extension first, content after it."""
    ext = extension(path)
    head = F.lower(F.decode(F.substring(content, 1, 8), "ISO-8859-1"))
    return (
        F.when(ext.isin(*K.EXTRACTION_EXTENSIONS), mime_by_extension(path))
        .when(starts_with(content, b"%PDF-"), "application/pdf")
        .when(starts_with(content, b"PK") & F.coalesce(F.array_contains(names, "word/document.xml"), F.lit(False)), K.DOCX)
        .when(starts_with(content, b"PK") & F.coalesce(F.exists(names, lambda n: n.contains(".opf")), F.lit(False)), K.EPUB)
        .when(head.contains("<html"), "text/html")
        .otherwise("text/plain")
    )


def is_scanned(page_chars: Column, page_images: Column) -> Column:
    """More than half of the pages hold under 50 characters and an image (both columns are arrays by page)."""
    bare = F.filter(F.zip_with(page_chars, page_images, lambda c, i: (c < 50) & (i > 0)), lambda x: x)
    return F.coalesce(F.size(bare) > F.size(page_chars) * 0.5, F.lit(False))


def detect(files):
    """A detection row for each row of `files` (path, content): both votes, the decision, confidence, encoding."""
    with_zip = files.withColumn("_zip", F.when(starts_with(F.col("content"), b"PK"), members(F.col("content"))))
    by_ext, by_sig = mime_by_extension(F.col("path")), mime_by_signature(F.col("content"), zip_kind(F.col("_zip.names"), F.col("_zip.mimetype")))
    rows = with_zip.withColumns({"extension_mime": by_ext, "signature_mime": by_sig})
    final = F.coalesce("signature_mime", "extension_mime", F.lit("application/octet-stream"))
    return rows.select(
        "path",
        file_name(F.col("path")).alias("filename"),
        "extension_mime",
        "signature_mime",
        final.alias("detected_format"),
        confidence(F.col("extension_mime"), F.col("signature_mime")).alias("confidence"),
        encoding(F.col("content")).alias("encoding"),
        F.length("content").alias("file_size_bytes"),
        extraction_mime(F.col("path"), F.col("content"), F.col("_zip.names")).alias("extraction_mime"),
    )
