"""PDF and OCR readers, where the optional libraries are installed; without them a PDF has no blocks."""

from __future__ import annotations

from io import BytesIO

from docloom.sources.lines import parse_ocr, parse_page

OCR_DPI = 200


# The passwords that an encrypted file is tried with.
PASSWORDS = ("", "password", "123456")


class Encrypted(ValueError):
    """No known password opens the file."""


def _tried(opens, password: str | None):
    """What `opens` gives for the first password that it takes; readers raise for one that is wrong."""
    for p in (password,) if password else PASSWORDS:
        try:
            return opens(p)
        except Exception as e:
            if "password" not in f"{type(e).__name__} {e!r}".lower():
                raise
    raise Encrypted("file is encrypted: a password is required")


def page_texts(raw: bytes, password: str | None = None) -> list[tuple[str, list]] | None:
    """(text, tables) of each page by the first reader that is installed; None without one."""
    try:
        import pdfplumber
    except ImportError:
        pdfplumber = None
    if pdfplumber:
        with _tried(lambda p: pdfplumber.open(BytesIO(raw), password=p), password) as pdf:
            return [(p.extract_text() or "", p.extract_tables() or []) for p in pdf.pages]
    try:
        import fitz
    except ImportError:
        return None
    with fitz.open(stream=raw, filetype="pdf") as pdf:
        if pdf.needs_pass and not any(pdf.authenticate(p) for p in ((password,) if password else PASSWORDS)):
            raise Encrypted("file is encrypted: a password is required")
        return [(p.get_text(), []) for p in pdf]


def ocr_texts(raw: bytes) -> list[str] | None:
    try:
        import pytesseract
        from pdf2image import convert_from_bytes
    except ImportError:
        return None
    return [pytesseract.image_to_string(image, lang="eng") for image in convert_from_bytes(raw, dpi=OCR_DPI)]


def parse_pdf(raw: bytes) -> tuple[list[dict], dict]:
    """(blocks, metadata). Each page's tables follow its text; if all pages are blank, OCR reads them."""
    pages = page_texts(raw)
    if pages is None:
        return [], {"page_count": 0}
    blocks = []
    for n, (text, tables) in enumerate(pages, 1):
        blocks += parse_page(text, n)
        blocks += [{"type": "table", "rows": [[c or "" for c in r] for r in t], "page_number": n} for t in tables if t]
    if not blocks and (texts := ocr_texts(raw)):
        for n, text in enumerate(texts, 1):
            blocks += parse_ocr(text, n)
    return blocks, {"page_count": len(pages)}
