import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import detect as D
from docloom.functions import text as X
from docloom.functions.python_text import normalize_whitespace
from docloom.sources import lines


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column expression over one text."""

    def run(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]

    return run


@pytest.fixture(scope="session")
def values(spark):
    def run(f, texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        return [r["v"] for r in sorted(df.select("k", f(F.col("t")).alias("v")).collect(), key=lambda r: r["k"])]

    return run


def test_tokens(values):
    texts = [" ".join("w" * n) for n in (0, 1, 2, 3, 4, 7, 8)]
    assert values(X.token_estimate, texts) == [1, 1, 1, 2, 3, 5, 6]


def test_whitespace(values):
    texts = ["a\n \n \nb", "a\n\n\n\nb", "x\t\ty  z \r\n w", "​A­B"]
    assert values(X.normalize_whitespace, texts) == ["a\n\n\nb", "a\n\nb", "x y z\nw", "AB"]


def test_text_functions_agree_with_python(values):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="aB \t\r\n​é \x1c\x85 .", max_size=30), min_size=20, max_size=20))
    def check(texts):
        assert values(X.normalize_whitespace, texts) == [normalize_whitespace(t) for t in texts]
        assert values(X.word_count, texts) == [len(t.split()) for t in texts]
        assert values(X.strip, texts) == [t.strip() for t in texts]
        assert values(X.is_upper, texts) == [t.isupper() for t in texts]
        assert values(X.heading_level, texts) == [lines.level_of(t) for t in texts]

    check()


def test_key_values(values):
    texts = ["Key: Value\nOther → thing", "A: 1", "A: 1\nA: 2", "See: x\nA: 1", "A: 1\nB: 2\nA: 3", "A: wikipedia:x\nhttp://x: 1\nB: 1"]
    assert values(X.key_values, texts) == [{"Key": "Value", "Other": "thing"}, None, None, None, {"A": "3", "B": "2"}, None]


def test_dates_and_urls(values):
    assert values(X.dates, ["On February 31, 2024 and march 5 2020", "none"]) == [["2024-02-31", "2020-03-05"], []]
    urls = ["http://e.com/p?utm_source=x&id=1#f", "http://h/x?page=2&ref=x", "https://a/b", "", "http://h?a=1&b=&a=2&c=3"]
    assert values(X.clean_url, urls) == ["https://e.com/p?id=1#f", "https://h/x?page=2", "https://a/b", "", "https://h?a=1&a=2&c=3"]
    fields = ["2020-01-02", "2020/1/2".replace("/1/2", "/01/02"), "13/02/2020", "March 5, 2020", "2020-01-02T03:04:05Z", "soon"]
    assert values(X.date_field, fields) == ["2020-01-02", "2020-01-02", "2020-02-13", "2020-03-05", "2020-01-02", "soon"]


def test_headings_and_roles(values):
    texts = ["INTRO", "A" * 45, "1.2.3 Foo", "Short one", "A somewhat longer title", ""]
    assert values(X.heading_level, texts) == [1, 2, 3, 3, 2, 2]
    assert values(X.section_role, ["Related Work and Methods", "Discussion of Results", "Intro"]) == ["background", "results", None]
    assert values(X.numbered_label, ["1.2 Foo", "IV. Bar", "Baz"]) == ["1.2", "IV", None]
    assert values(X.language_guess, ["größe", "été", "año", "plain"]) == ["de", "fr", "es", "en"]
    assert values(X.has_cjk, ["漢字", "abc"]) == [True, False]


def test_sentences(value):
    got = value(X.sentences, "One two.  Three!  ")
    assert [(r.sentence_id, r.text, r.start_char, r.end_char) for r in got] == [(1, "One two.", 0, 8), (2, "Three!", 10, 16)]


def test_code_symbols(spark):
    code = "import os\nclass A:\n  def f(self):\n    if (x):\n      pass\ndef f(a):\n  pass\n"
    df = spark.createDataFrame([(code,)], "t string")
    got = df.select(*[c.alias(n) for c, n in zip(X.code_symbols("t"), ("f", "c", "i"), strict=True)]).first()
    block = lines.code_block(code, "python", "a.py")
    assert (got.f, got.c, got.i) == (block["functions"], block["classes"], block["imports"]) == (["f"], ["A"], ["os"])


FILES = [
    ("a.md", b"# T\n", "text/markdown", "text/markdown", "text/markdown", 1.0, "text/markdown", "utf-8"),
    ("a.txt", b"[1,2]", "text/plain", "text/markdown", "text/markdown", 0.70, "text/plain", "utf-8"),
    ("x", b"a,b,c\n1,2,3\n", None, "text/csv", "text/csv", 0.70, "text/plain", "utf-8"),
    ("a.pdf", b"hello", "application/pdf", "text/plain", "text/plain", 0.70, "application/pdf", "utf-8"),
    ("x", b"<!DOCTYPE html>", None, "text/html", "text/html", 0.70, "text/plain", "utf-8"),
    ("x", b"", None, "text/plain", "text/plain", 0.70, "text/plain", "utf-8"),
    ("x", b"\x00\x01", None, None, "application/octet-stream", 0.10, "text/plain", "utf-8"),
    ("x", b"caf\xe9", None, "text/plain", "text/plain", 0.70, "text/plain", "latin-1"),
    ("d/b.HTML", b"\xef\xbb\xbf<p>", "text/html", "text/plain", "text/plain", 0.70, "text/html", "utf-8-sig"),
    (".md", b"%PDF-1.4", None, "application/pdf", "application/pdf", 0.70, "application/pdf", "utf-8"),
]


def test_detection(spark):
    df = spark.createDataFrame([(f"{k}/{p}", bytearray(c)) for k, (p, c, *_) in enumerate(FILES)], "path string, content binary")
    rows = sorted(D.detect(df).collect(), key=lambda r: int(r.path.split("/")[0]))
    for r, (_, c, ext, sig, final, conf, extraction, enc) in zip(rows, FILES, strict=True):
        assert (r.extension_mime, r.signature_mime, r.detected_format, r.confidence, r.extraction_mime, r.encoding) == (ext, sig, final, conf, extraction, enc), r
        assert r.file_size_bytes == len(c)


def test_zip_kinds(spark):
    import io
    import zipfile

    def archive(*names, **more):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, more.get(n, ""))
        return bytearray(b.getvalue())

    files = [
        ("0", archive("[Content_Types].xml", "word/document.xml"), K.DOCX),
        ("1", archive("[Content_Types].xml", "xl/workbook.xml"), K.XLSX),
        ("2", archive("mimetype", mimetype="application/epub+zip"), K.EPUB),
        ("3", archive("a/b.opf"), K.EPUB),
        ("4", archive("content.xml", "META-INF/manifest.xml"), K.ODT),
        ("5", archive("other"), "application/zip"),
        ("6", bytearray(b"PK\x03\x04broken"), "application/zip"),
    ]
    got = {r.path: r.detected_format for r in D.detect(spark.createDataFrame([f[:2] for f in files], "path string, content binary")).collect()}
    assert got == {p: mime for p, _, mime in files}


def test_scanned_pages(spark):
    df = spark.createDataFrame([([10, 20, 900], [1, 2, 0]), ([900, 900], [1, 1]), ([], [])], "c array<int>, i array<int>")
    assert [r[0] for r in df.select(D.is_scanned(F.col("c"), F.col("i"))).collect()] == [True, False, False]


def test_shapes_of_fixed_values():
    assert len(K.EXTENSION_MIME) == 15 and len(K.CODE_LANGUAGE) == 83 and len(K.BLOCK_TYPES) == 19
    assert all(re.compile(p) for _, p in K.REFERENCE_PATTERNS)
    assert unicodedata.normalize("NFKC", "ﬁ①") == "fi1"
