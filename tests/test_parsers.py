import io
import zipfile

import pytest

from docloom.sources import archives, html, lines
from docloom.sources.extract import raw_row


def brief(blocks):
    out = []
    for b in blocks:
        if b["type"] == "heading":
            out.append(("h", b["level"], b["text"]))
        elif b["type"] == "list":
            out.append(("l", b["ordered"], [(i["text"], i.get("level")) for i in b["items"]]))
        elif b["type"] == "table":
            out.append(("t", b["rows"]))
        elif b["type"] == "code_block":
            out.append(("c", b["language"], b["text"]))
        else:
            out.append((b["type"], b.get("text")))
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("# A\ntext one\ntext two\n\n- x\n  - y\n\n---\n", [("h", 1, "A"), ("paragraph", "text one text two"), ("l", False, [("x", 0), ("y", 1)]), ("divider", None)]),
        ("Title\n===\nSub\n---\n", [("h", 1, "Title"), ("h", 2, "Sub")]),
        ("#tag", [("h", 1, "tag")]),
        ("a\n- b", [("paragraph", "a - b")]),
        ("- - -", [("l", False, [("- -", 0)])]),
        ("| h1 | h2 |\n|---|---|\n| 1 |  |\n", [("t", [["h1", "h2"], ["1"]])]),
        ("> q1\n\n> q2", [("quote", "q1 q2")]),
        ("t\n\n```py\n  x=1\n```", [("paragraph", "t"), ("c", "py", "  x=1")]),
        ("####### deep", [("h", 6, "deep")]),
        ("1. a\n   more\n2. b\nrest", [("l", True, [("a more", 0), ("b", 0)]), ("paragraph", "rest")]),
        ("```\nopen", [("c", None, "open")]),
        ("", []),
    ],
)
def test_markdown(text, want):
    assert brief(lines.parse_markdown(text)) == want


def test_indented_code_is_an_option():
    assert brief(lines.parse_markdown("a\n\n    x = 1\n\n    y\n\nb", indented_code=True)) == [("paragraph", "a"), ("c", None, "x = 1\n\ny"), ("paragraph", "b")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("INTRODUCTION\n\nhello world\nmore\n1) x\n2) y\n", [("h", 1, "Introduction"), ("paragraph", "hello world\nmore"), ("l", True, [("x", 0), ("y", 0)])]),
        ("Title\n=====\nSub\n---\ntext", [("h", 1, "Title"), ("h", 2, "Sub"), ("paragraph", "text")]),
        ("• a\n• b", [("l", False, [("a", 0), ("b", 0)])]),
        ("ABC DEF\nnext", [("paragraph", "ABC DEF\nnext")]),
        ("Long title\n==", [("paragraph", "Long title\n==")]),
    ],
)
def test_plain(text, want):
    assert brief(lines.parse_plain(text)) == want


def test_text_files():
    blocks, meta = lines.parse_text("---\ntitle: T\nsource: S\n---\n# H", "a.md")
    assert meta == {"title": "T", "source": "S"} and brief(blocks) == [("h", 1, "H")]
    assert lines.parse_text("---\n: [\n---\nx", "a.txt")[1] == {}
    assert brief(lines.parse_text("```py\nx\n```", "a.md")[0]) == [("c", "py", "```py\nx\n```")]
    assert brief(lines.parse_text("#!/usr/bin/env python3\nx", "a")[0])[0][:2] == ("c", "python")
    assert brief(lines.parse_text("#!/bin/sh\nx", "a")[0])[0][:2] == ("c", None)
    assert brief(lines.parse_text("x = 1", "a.py")[0]) == [("c", "python", "x = 1")]
    assert lines.decode(b"\xef\xbb\xbfx") == "x" and lines.decode(b"caf\xe9") == "café"


@pytest.mark.parametrize(
    "line, kind",
    [("1. Alpha", "heading"), ("1) Alpha", "list_item"), ("Term: a definition sentence.", "definition_list"), ("1 kilosecond: 16.7 minutes", None), ("ALL CAPS", "heading"), ("See: other", None), ("edit", None), ("A plain sentence that ends here and goes on for a while.", None)],
)
def test_page_lines(line, kind):
    block = lines.page_line(line)
    assert (block["type"] if block else None) == kind or (kind is None and block is not None and block["type"] == "definition_list")


def test_pages_and_ocr():
    assert brief(lines.parse_page("Short Title\nGoes On\nMore\n\na sentence here.\nand more.\n", 3)) == [("h", 3, "Short Title Goes On"), ("h", 3, "More"), ("paragraph", "a sentence here. and more.")]
    assert {b["page_number"] for b in lines.parse_page("x", 3)} == {3}
    ocr = lines.parse_ocr("TITLE HERE\n\nsome text. that ends\nhere.\n\n- item\n")
    assert brief(ocr) == [("h", 1, "TITLE HERE"), ("paragraph", "some text. that ends here."), ("l", False, [("item", 0)])]
    assert [b["confidence"] for b in ocr] == [0.75, 0.80, 0.75]


PAGE = (
    '<html><head><title> T </title><meta name="author" content="Me"><meta property="og:type" content="x"></head><body><nav>no</nav><article>lead<h1>T</h1>'
    '<p>a <b>b</b> <strong>c</strong><br>d <a href="/x">e</a> <code>f</code> <abbr title="g">h</abbr><!-- c --><img alt="i"></p><div>bare<p>in</p></div>'
    "<ul><li>p<ul><li>q</li></ul></li></ul><dl><dt>t</dt><dd>d</dd></dl><pre><code class='language-sql'>x\n y</code></pre><blockquote>z</blockquote><hr>"
    "<figure><img src='s' alt='a'><figcaption>cap</figcaption></figure><table><tr><th>1</th></tr><tr><td>2</td></tr></table><span>gone</span></article></body></html>"
)


def test_html():
    blocks, meta = html.parse_html(PAGE)
    assert meta == {"title": "T", "author": "Me", "og_type": "x"}
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "paragraph", "list", "definition_list", "code_block", "quote", "divider", "figure", "table"]
    assert blocks[1]["text"] == "a b **c**\nd e [/x] `f` h (g)[Image: i]"
    assert blocks[3]["items"] == [{"text": "p", "nested": [{"type": "list", "ordered": False, "items": [{"text": "q"}]}]}]
    assert blocks[4]["items"] == [{"term": "t", "definition": "d"}] and blocks[5]["language"] == "sql"
    assert blocks[9]["rows"] == [["1"], ["2"]]
    assert [b["text"] for b in html.parse_html("<body>x<p>y</p></body>", bare_text=True)[0]] == ["x", "y"]
    assert brief(html.parse_html("<div class='content'><p>a</p></div><p>b</p>", content_class=True)[0]) == [("paragraph", "a")]
    assert html.parse_html("<p>漢字</p>")[1]["multilingual"] is True


@pytest.mark.parametrize("page", [PAGE, "", "<p>漢字</p>", "<p>&#x6f22;</p>", "<nav>漢字</nav>x", "<body><p>a<title> b </title><meta name=AUTHOR content=c><div>漢"])
def test_html_metadata_without_blocks(page):
    assert html.parse_metadata(page) == html.parse_html(page)[1]


def test_html_trees_are_lenient():
    assert brief(html.parse_html("<article><h1>A</h1><p><b>x<p>y</article>")[0]) == [("h", 1, "A"), ("paragraph", "xy")]
    assert html.parse_html("</p><p>a</i></p>")[0][0]["text"] == "a"
    deep = "<div>" * 3000 + "<p>x</p>"
    assert html.tree(deep).text() == "x"


def test_html_references_without_semicolon():
    page = '<title>a &amp;&amp b</title><p id="x&lt">&copy=2 &ampx; &foo; &#39;&#39 &lt;b&gt; <![CDATA[&amp;]]>\ue000</p>&'
    assert html.parse_html(page)[1] == {"title": "a && b"}
    blocks, meta = html.parse_html(page, closed_references=True)
    assert meta == {"title": "a &&amp b"}
    assert blocks[0]["text"] == "&copy=2 &ampx; &foo; '&#39 <b> &amp;\ue000"
    root = html.tree(page + "<p&amp &amp>y</p&amp>z", closed_references=True)
    assert root.find("p").attrs == {"id": "x&lt"} and root.find("p&amp").attrs == {"&amp": ""}
    assert root.find("p&amp").text() == "y" and root.children[-1] == "z"


def test_html_titles_hold_no_markup():
    blocks, meta = html.parse_html("<head><TITLE>a &lt;b <p>c</p></Title ></head><body><p>d &amp; <b>e</b>")
    assert meta == {"title": "a <b <p>c</p>"} and [b["text"] for b in blocks] == ["d & e"]
    blocks, meta = html.parse_html("<title>a<title>b<article><p>c</p></article>")
    assert meta == {"title": "a"} and [b["text"] for b in blocks] == ["c"]
    assert html.parse_html("<title/><p>c</p><title>t</title>")[1] == {"title": ""}


def archive(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    para = lambda t, s="": f'<w:p>{s and f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>"}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{para('c1')}</w:tc><w:tc>{para('c2')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {W}><w:body>{para('Head', 'Heading2')}{table}{para('text')}</w:body></w:document>"
    notes = f'<w:footnotes {W}><w:footnote w:id="-1">{para("sep")}</w:footnote><w:footnote w:id="1">{para("note")}</w:footnote></w:footnotes>'
    core = '<cp:p xmlns:cp="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Doc</dc:title></cp:p>'
    return archive(**{"[Content_Types].xml": "", "word/document.xml": body, "word/footnotes.xml": notes, "docProps/core.xml": core})


def test_docx():
    blocks, meta = archives.parse_docx(docx())
    assert brief(blocks) == [("h", 2, "Head"), ("paragraph", "text"), ("t", [["c1", "c2"]]), ("footnote", "note")] and meta["title"] == "Doc"
    assert [b["type"] for b in archives.parse_docx(docx(), in_order=True)[0]] == ["heading", "table", "paragraph", "footnote"]


def epub():
    opf = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest>'
        '<item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/><item id="gone" href="gone.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="none"/><itemref idref="gone"/><itemref idref="a"/></spine></package>'
    )
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>'
    return archive(**{"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OPS/c.opf": opf, "OPS/a.xhtml": "<body><h1>A</h1></body>", "OPS/b.xhtml": "<body><p>B</p></body>"})


def test_epub():
    blocks, meta = archives.parse_epub(epub())
    assert brief(blocks) == [("paragraph", "B"), ("h", 1, "A")] and meta["title"] == "Book" and meta["page_count"] == 2


def test_entities_are_refused():
    bad = archive(**{"word/document.xml": f'<!DOCTYPE x [<!ENTITY e "x">]><w:document {W}/>'})
    with pytest.raises(ValueError):
        archives.parse_docx(bad)


def test_raw_rows_keep_originals():
    row = raw_row({"type": "paragraph", "text": "ﬁ  x"})
    assert row["text"] == "fi x" and row["text_original"] == "ﬁ  x" and row["confidence"] == 0.95
    nested = raw_row(html.parse_html("<ol><li>p<ul><li>q</li></ul></li><li>r</li></ol>")[0][0])
    assert [(i["text"], i["depth"]) for i in nested["items"]] == [("p", 0), ("q", 1), ("r", 0)]


def test_encrypted_pdfs_are_tried_with_known_passwords(monkeypatch):
    import sys
    import types

    from docloom.sources import pdf

    class Page:
        def extract_text(self):
            return "A sentence of the page."

        def extract_tables(self):
            return [[["k", None]]]

    class File:
        pages = [Page()]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    class PDFPasswordIncorrect(Exception):
        pass

    def opens(stream, password):
        if password != stream.read().decode():
            raise PDFPasswordIncorrect
        return File()

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=opens))
    blocks, meta = pdf.parse_pdf(b"123456")
    assert [(b["type"], b.get("text"), b.get("rows"), b["page_number"]) for b in blocks] == [("paragraph", "A sentence of the page.", None, 1), ("table", None, [["k", ""]], 1)]
    assert meta == {"page_count": 1}
    with pytest.raises(pdf.Encrypted, match="encrypted"):
        pdf.parse_pdf(b"secret")
    assert pdf.page_texts(b"secret", "secret")
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda stream, password: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        pdf.parse_pdf(b"")
