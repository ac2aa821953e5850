"""DOCX and EPUB from their ZIP archives, with the standard library only; external entities are never resolved."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from posixpath import dirname
from xml.etree import ElementTree

from docloom.sources.html import parse_html

#: Larger members are not unpacked: a guard against archive bombs.
MAX_MEMBER = 100 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_TERMS = "{http://purl.org/dc/terms/}"
_OPF = "{http://www.idpf.org/2007/opf}"


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError(f"archive member too large: {name}")
    return z.read(name)


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in raw:
        raise ValueError("entity declarations are not accepted")
    return ElementTree.fromstring(raw)


def _said(node: ElementTree.Element | None) -> str | None:
    return None if node is None else node.text


def _runs(node: ElementTree.Element) -> list[str]:
    return [t.text for t in node.iter(f"{_W}t") if t.text]


def parse_docx(raw: bytes, in_order: bool = False) -> tuple[list[dict], dict]:
    """(blocks, metadata). Paragraphs, then tables, then footnotes; `in_order` keeps tables where they stand."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        names = set(z.namelist())
        body = _xml(_member(z, "word/document.xml")).find(f"{_W}body") if "word/document.xml" in names else None
        notes = _xml(_member(z, "word/footnotes.xml")) if "word/footnotes.xml" in names else None
        core = _xml(_member(z, "docProps/core.xml")) if "docProps/core.xml" in names else None
    flow: list[dict] = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            text = "".join(_runs(child)).strip()
            style = child.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"heading\s*(\d+)", (style.get(f"{_W}val") or "").lower()) if style is not None else None
            if text:
                kind = {"type": "heading", "level": int(level.group(1))} if level and int(level.group(1)) else {"type": "paragraph", "level": None}
                flow.append(kind | {"text": text, "source_location": "paragraph"})
        elif child.tag == f"{_W}tbl":
            rows = [["".join(_runs(c)).strip() for c in r.findall(f"{_W}tc")] for r in child.findall(f"{_W}tr")]
            if rows := [r for r in rows if r]:
                flow.append({"type": "table", "rows": rows, "source_location": "table"})
    if not in_order:
        flow.sort(key=lambda b: b["type"] == "table")
    for n in notes.findall(f"{_W}footnote") if notes is not None else ():
        if n.get(f"{_W}id") not in ("0", "-1") and (said := _runs(n)):
            flow.append({"type": "footnote", "text": " ".join(said), "source_location": "footnote"})
    meta: dict = {}
    if core is not None:
        for key, tag in (("title", f"{_DC}title"), ("author", f"{_DC}creator"), ("subject", f"{_DC}subject"), ("language", f"{_DC}language"), ("created", f"{_TERMS}created"), ("modified", f"{_TERMS}modified")):
            meta[key] = _said(core.find(f".//{tag}"))
    return flow, meta


def spine_of(raw: bytes) -> tuple[list[tuple[str, str]], dict]:
    """((path, href) of the chapters in reading order, metadata); spine entries without manifest or member are skipped."""
    with zipfile.ZipFile(BytesIO(raw)) as z:
        names = z.namelist()
        opf = None
        if "META-INF/container.xml" in names:
            found = re.search(r'full-path="([^"]+)"', _member(z, "META-INF/container.xml").decode("utf-8", "replace"))
            opf = found.group(1) if found else None
        opf = opf or next((n for n in names if n.endswith(".opf")), None)
        if opf not in names:
            return [], {}
        package = _xml(_member(z, opf))
    meta = {tag: _said(package.find(f".//{_DC}{tag}")) for tag in ("title", "creator", "language", "publisher", "date", "identifier", "description")}
    href = {i.get("id"): i.get("href") for i in package.findall(f"{_OPF}manifest/{_OPF}item")}
    folder = dirname(opf)
    out = []
    for ref in package.findall(f"{_OPF}spine/{_OPF}itemref"):
        h = href.get(ref.get("idref"))
        path = f"{folder}/{h}".replace("//", "/") if folder else h
        if h and path in names:
            out.append((path, h))
    return out, meta


def parse_epub(raw: bytes) -> tuple[list[dict], dict]:
    """(blocks of all chapters in spine order, metadata with page_count = chapters)."""
    chapters, meta = spine_of(raw)
    blocks = []
    with zipfile.ZipFile(BytesIO(raw)) as z:
        for path, _ in chapters:
            blocks += parse_html(_member(z, path).decode("utf-8", "replace"))[0]
    return blocks, meta | {"page_count": len(chapters)}
