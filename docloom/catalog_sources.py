"""Queries of parsers, files and repairs over small documents rendered from the part and nation tables; see `catalog`."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.catalog import _crm, _talk, expected, query, raw_of, table
from docloom.functions import constants
from docloom.functions import detect as D
from docloom.operators import blocks as B
from docloom.operators import enrich as E
from docloom.operators import select as Q
from docloom.operators import sinks as K
from docloom.operators import structure as T
from docloom.plans.documents import Documents
from docloom.sources import extract

#: Columns of `part` by short names, as both sides use them.
PART = "p AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(p_partkey AS VARCHAR) AS k, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part)"


#: Tasks for each core that the rows of `part` are dealt to: a file of a few MB holds a million documents, and comes as one or two tasks.
TASKS = 4


def parts(s, d) -> DataFrame:
    cast = {"doc_id": F.col("p_partkey").cast("long"), "k": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"), "size": F.col("p_size").cast("string")}
    return table(s, d, "part").select(*[c.alias(n) for n, c in cast.items()]).repartition(TASKS * s.sparkContext.defaultParallelism, "doc_id")


def filled(template: str) -> Column:
    """The template with its {name}s replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(before), F.col(name)]
    return F.concat(*out, F.lit(rest))


def filled_sql(template: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [before, None, name]
    quoted, skip = [], False
    for piece in [*out, rest]:
        if piece is None:
            skip = True
        elif skip:
            quoted.append(piece)
            skip = False
        elif piece:
            quoted.append("'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return "(" + " || ".join(quoted) + ")"


def block_sql(rows: list[tuple], columns: tuple[str, ...], where: str = "") -> str:
    """SQL of the blocks that a template gives: a SELECT for each row of values; templates are strings with braces, None is null."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        return filled_sql(v) if isinstance(v, str) else str(v)

    each = [f"SELECT doc_id, {', '.join(f'{value(v)} AS {c}' for v, c in zip(r, columns, strict=True))} FROM p {where}" for r in rows]
    return f"WITH {PART} " + " UNION ALL ".join(each)


# ------------------------------------------------------------------ text


@query(f"WITH {PART} SELECT doc_id, 'file No ' || k || '2 of ' || name AS text, 'ﬁle Ｎｏ ' || k || '² of ' || name AS original FROM p")
def nfkc_text(s, d):
    texts = parts(s, d).select("doc_id", filled("ﬁle Ｎｏ {k}² of {name}").alias("text"))
    return Documents.from_texts(texts, "text/plain").blocks.select("doc_id", F.col("text_plain").alias("text"), F.col("text_original").alias("original"))


_MD = "{name}\n=====\n\nSub {brand}\n-----\n\n> quoted {kind}\n> again\n\n---\n\n- one {size}\n  - two\n\n1. first\n2. second {k}\n"


@query(
    block_sql(
        [
            (0, "heading", "{name}", 1),
            (1, "heading", "Sub {brand}", 2),
            (2, "quote", "quoted {kind} again", None),
            (3, "divider", "---", None),
            (4, "list", "- one {size}\n- two", None),
            (5, "list", "1. first\n2. second {k}", None),
        ],
        ("ordinal", "type", "text", "level"),
    )
)
def md_block_kinds(s, d):
    texts = parts(s, d).select("doc_id", filled(_MD).alias("text"))
    b = Documents.from_texts(texts, "text/markdown", "a.md").blocks
    return b.select("doc_id", "ordinal", "type", F.col("text_plain").alias("text"), F.col("heading_level").alias("level"))


@query(
    f"""WITH {PART} SELECT doc_id, 'code_block' AS type, ['python', 'javascript', 'rust', 'sql'][doc_id % 4 + 1] AS language, ['a.py', 'run', '', 'q.SQL'][doc_id % 4 + 1] AS filename,
      [2, 2, 3, 1][doc_id % 4 + 1] AS line_count, CASE WHEN doc_id % 4 = 0 THEN ['f' || k] ELSE [] END AS functions, CASE WHEN doc_id % 4 = 2 THEN ['std::fs'] ELSE [] END AS imports FROM p""",
    lists=("functions", "imports"),
)
def code_files(s, d):
    """Code by extension, by interpreter line and by fence."""
    at = (F.col("doc_id") % 4).cast("int")
    text = F.get(F.array(filled("def f{k}(x):\n    pass"), filled("#!/usr/bin/env node\nlet a = {k}"), filled("```rust\nuse std::fs;\n// {k}"), filled("select {k}")), at)
    path = F.get(F.array(*map(F.lit, ("d/a.py", "run", "", "d/q.SQL"))), at)
    files = parts(s, d).select("doc_id", path.alias("path"), F.lit("text/plain").alias("mime_type"), text.cast("binary").alias("content"))
    return Documents(extract.extract(files)).blocks.select("doc_id", "type", "language", "filename", "line_count", "functions", "imports")


@query(f"WITH {PART} SELECT doc_id, name AS title, '2019-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created, '2020-01-02' AS modified FROM p")
def iso_dates(s, d):
    """Dates that YAML reads as dates, as ISO texts."""
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    texts = parts(s, d).withColumn("day", day).select("doc_id", filled("---\ntitle: {name}\ndate: 2019-03-{day}\nmodified: 2020-01-02\n---\n# T {k}").alias("text"))
    return Documents.from_texts(texts, "text/markdown", "a.md").metadata.select("doc_id", "title", "created", "modified")


# ------------------------------------------------------------------ pages

_PAGE = "A Study\nof Parts\nThis part {name} is described here.\nIt goes on.\nINTRODUCTION {k}\n1) first {name}.\nMaterial: wood and {brand} glue.\n2.1 Methods\n"


@query(
    block_sql(
        [
            (0, "heading", "A Study of Parts", 3, 1),
            (1, "paragraph", "This part {name} is described here. It goes on.", None, 1),
            (2, "heading", "INTRODUCTION {k}", 1, 1),
            (3, "paragraph", "first {name}.", None, 1),
            (4, "definition_list", "Material: wood and {brand} glue.", None, 1),
            (5, "heading", "2.1 Methods", 2, 1),
            (6, "paragraph", "Last {name} page, and more.", None, 2),
        ],
        ("ordinal", "type", "text", "level", "page"),
    )
)
def page_blocks(s, d):
    p = parts(s, d)
    pages = p.select("doc_id", F.lit(2).alias("page"), filled("Last {name} page, and more.").alias("text")).unionByName(p.select("doc_id", F.lit(1).alias("page"), filled(_PAGE).alias("text")))
    b = B.canonical_blocks(extract.extract_pages(pages))
    return b.select("doc_id", "ordinal", "type", F.col("text_plain").alias("text"), F.col("heading_level").alias("level"), F.col("page_number").alias("page"))


@query(
    block_sql(
        [(0, "heading", "OVERVIEW {k}", 0.75, "ocr inferred"), (1, "paragraph", "This is text of {name}. And more.", 0.8, "ocr inferred"), (2, "list", "- item {brand}", 0.75, "ocr inferred")],
        ("ordinal", "type", "text", "confidence", "source"),
    ).replace(" AS confidence", " :: DOUBLE AS confidence")
)
def ocr_blocks(s, d):
    pages = parts(s, d).select("doc_id", F.lit(1).alias("page"), filled("OVERVIEW {k}\n\nThis is text of {name}.\nAnd more.\n\n- item {brand}\n").alias("text"))
    b = B.canonical_blocks(extract.extract_pages(pages, ocr=True))
    return b.select("doc_id", "ordinal", "type", F.col("text_plain").alias("text"), "confidence", F.col("source_location").alias("source"))


# ------------------------------------------------------------------ HTML

_HTML = """<html><head><title> {name} </title><meta name="description" content="Part {k}"><meta name="keywords" content="{kind}, spare ,"><meta property="og:title" content="OG {brand}"><script>var x = "{k}";</script></head>
<body><nav><p>menu {k}</p></nav><main>
<h2>{name} <em>guide</em></h2>
<p>Uses <strong>{brand}</strong>, <code>x{k}</code>, <a href="https://e.org/{k}">link</a>, <a href="#top">top</a>, <del>old</del> <mark>new</mark> <abbr title="as is">a.i.</abbr><br>end <img alt="pic"></p>
<ul><li>one<ul><li>inner {size}</li></ul></li><li>two</li></ul>
<table><tr><th>k</th><th>a &lt; b</th></tr><tr><td>size</td><td>{size}</td></tr></table>
<pre><code class="language-sql">select {k}</code></pre>
<blockquote>said {kind}</blockquote>
<img src="/i/{k}.png" alt="">
<hr>
<div>loose<p>in div</p><aside><p>gone</p></aside></div>
<figure><img src="f.png" alt="F"><figcaption>Figure {k}</figcaption></figure>
<dl><dt>Term</dt><dd>Meaning {size}</dd></dl>
<form><p>gone</p></form>
</main><footer><p>gone</p></footer></body></html>"""
_HTML_TEXT = "Uses **{brand}**, `x{k}`, link [https://e.org/{k}], top, ~~old~~ ==new== a.i. (as is)\nend [Image: pic]"


def _html_texts(s, d) -> DataFrame:
    return parts(s, d).select("doc_id", filled(_HTML).alias("text"))


def _html(s, d) -> Documents:
    return Documents.from_texts(_html_texts(s, d), "text/html")


@query(
    block_sql(
        [
            (0, "heading", "{name} *guide*", 2, None, None),
            (1, "paragraph", _HTML_TEXT, None, None, None),
            (2, "list", "- one\n- two", None, None, None),
            (3, "table", "Table\n| k | a < b |\n| size | {size} |", None, None, None),
            (4, "code_block", "select {k}", None, "sql", None),
            (5, "quote", "said {kind}", None, None, None),
            (6, "image_placeholder", "/i/{k}.png", None, None, None),
            (7, "divider", "---", None, None, None),
            (8, "paragraph", "in div", None, None, None),
            (9, "figure", None, None, None, "Figure {k}"),
            (10, "definition_list", None, None, None, None),
        ],
        ("ordinal", "type", "text", "level", "language", "caption"),
    )
)
def html_elements(s, d):
    """Every element that gives a block, the inline marks, and the noise that goes."""
    return _html(s, d).blocks.select("doc_id", "ordinal", "type", F.nullif("text_plain", F.lit("")).alias("text"), F.col("heading_level").alias("level"), "language", "caption")


@query(f"WITH {PART} SELECT doc_id, name AS title, 'Part ' || k AS description, 'OG ' || brand AS og_title FROM p")
def html_metadata(s, d):
    m = F.col("meta")
    parsed = extract.extract_texts(_html_texts(s, d), "text/html", blocks=False)
    return parsed.select("doc_id", m["title"].alias("title"), m["description"].alias("description"), m["og_title"].alias("og_title"))


@query(f"WITH {PART} SELECT doc_id, i AS item, ['one', 'inner ' || size, 'two'][i + 1] AS text, [0, 1, 0][i + 1] AS depth, [[0], [0, 1], [2]][i + 1] AS item_path FROM p, (VALUES (0), (1), (2)) v(i)", lists=("item_path",))
def html_list_items(s, d):
    return T.list_items(_html(s, d).blocks).select("doc_id", "item", "text", "depth", "item_path")


@query(f"WITH {PART} SELECT doc_id, 'Term' AS term, 'Meaning ' || size AS definition FROM p")
def html_definitions(s, d):
    return _html(s, d).blocks.select("doc_id", F.explode("definitions").alias("x")).select("doc_id", "x.term", "x.definition")


@query(f"WITH {PART} SELECT doc_id, 'tbl-001' AS table_id, '<table><thead><tr><th>k</th><th>a &lt; b</th></tr></thead><tbody><tr><td>size</td><td>' || size || '</td></tr></tbody></table>' AS html FROM p")
def table_html(s, d):
    return B.table_html(_html(s, d).blocks).select("doc_id", "table_id", "html")


@query(
    f"""WITH {PART}, t AS (SELECT *, {filled_sql(_HTML_TEXT)} AS x FROM p),
    m AS (SELECT doc_id, x, 'bold' AS type, '**' || brand || '**' AS mark, brand AS text, NULL AS href FROM t UNION ALL SELECT doc_id, x, 'code', '`x' || k || '`', 'x' || k, NULL FROM t
      UNION ALL SELECT doc_id, x, 'strikethrough', '~~old~~', 'old', NULL FROM t UNION ALL SELECT doc_id, x, 'highlight', '==new==', 'new', NULL FROM t
      UNION ALL SELECT doc_id, x, 'link', 'link [https://e.org/' || k || ']', 'link', 'https://e.org/' || k FROM t)
    SELECT doc_id, 1 AS ordinal, type, text, href, strpos(x, mark) - 1 AS start_char, strpos(x, mark) - 1 + length(mark) AS end_char FROM m"""
)
def inline_elements(s, d):
    r = E.inline_marks(_html(s, d).blocks)
    return r.select("doc_id", "ordinal", "type", "text", "href", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"))


@query(f"WITH {PART} SELECT doc_id, 'unknown' AS doc_type, [kind, 'spare'] AS keywords, NULL :: VARCHAR AS license, true AS open_access FROM p", lists=("keywords",))
def classification_and_rights(s, d):
    m = _html(s, d).metadata
    return m.select("doc_id", "classification.doc_type", "classification.keywords", "rights.license", "rights.open_access")


@query(
    f"""WITH {PART} SELECT doc_id, x.* FROM p, LATERAL (VALUES
      ('heading', 'level', '2'), ('paragraph', 'text', {filled_sql(_HTML_TEXT)}), ('list', 'list_type', 'unordered'), ('list', 'items[1].text', 'inner ' || size), ('table', 'headers[1]', 'a < b'), ('table', 'rows[0][1]', size),
      ('table', 'column_count', '2'), ('code_block', 'lines[0].text', 'select ' || k), ('code_block', 'language', 'sql'), ('quote', 'text', 'said ' || kind), ('image_placeholder', 'image_id', 'img-006'),
      ('image_placeholder', 'image_uri', '/i/' || k || '.png'), ('definition_list', 'items[0].definition', 'Meaning ' || size), ('figure', 'caption', 'Figure ' || k)) x(type, field, said)"""
)
def block_content(s, d):
    """Fields of the content of each type of block, out of its JSON."""
    asked = (
        ("heading", "level"), ("paragraph", "text"), ("list", "list_type"), ("list", "items[1].text"), ("table", "headers[1]"), ("table", "rows[0][1]"), ("table", "column_count"), ("code_block", "lines[0].text"),
        ("code_block", "language"), ("quote", "text"), ("image_placeholder", "image_id"), ("image_placeholder", "image_uri"), ("definition_list", "items[0].definition"), ("figure", "caption"),
    )
    got = [F.struct(F.lit(t).alias("of"), F.lit(f).alias("field"), F.get_json_object("content", f"$.{f}").alias("said")) for t, f in asked]
    b = B.with_content(_html(s, d).blocks.where("type <> 'paragraph' OR ordinal = 1"))
    return b.select("doc_id", "type", F.explode(F.array(*got)).alias("x")).where("x.of = type").select("doc_id", "type", "x.field", "x.said")


# ------------------------------------------------------------------ files

_KIND = ["epub", "docx", "broken", "xlsx", "odt", "zip"]
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _members(kind: str, name: str) -> dict[str, str]:
    if kind == "epub":
        opf = (
            '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest>'
            '<spine><itemref idref="b"/><itemref idref="gone"/><itemref idref="a"/></spine></package>'
        )
        container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>'
        return {"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OPS/c.opf": opf, "OPS/a.xhtml": "<body><h1>A</h1></body>", "OPS/b.xhtml": f"<body><p>B {name}</p></body>"}
    if kind == "docx":
        para = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
        head = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
        cells = "".join(f"<w:tc>{para(c)}</w:tc>" for c in ("c1", "c2"))
        body = f"<w:document {_W}><w:body>{para(f'Head {name}', head)}<w:tbl><w:tr>{cells}</w:tr></w:tbl>{para('text')}</w:body></w:document>"
        return {"[Content_Types].xml": "<Types/>", "word/document.xml": body}
    return {"xlsx": {"[Content_Types].xml": "", "xl/workbook.xml": ""}, "odt": {"content.xml": "", "META-INF/manifest.xml": ""}}.get(kind, {"a.txt": name})


def _archives(s, d) -> DataFrame:
    """k, path, content: an archive of some kind for each nation, written into bytes by the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = (c.to_pylist() for c in batch.columns)
            out = []
            for k, name in zip(keys, names, strict=True):
                kind = _KIND[k % 6]
                b = BytesIO()
                if kind == "broken":
                    b.write(b"PK\x03\x04broken")
                else:
                    with zipfile.ZipFile(b, "w") as z:
                        for member, text in _members(kind, name).items():
                            z.writestr(member, text)
                out.append((k, f"n{k}" + (".docx" if kind == "broken" else ""), b.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["k", "path", "content"]) if out else batch.slice(0, 0)

    return table(s, d, "nation").select(F.col("n_nationkey").cast("int"), "n_name").mapInArrow(run, "k int, path string, content binary")


_PATHS = "n AS (SELECT n_name, n_nationkey % 6 AS kind, 'n' || n_nationkey || CASE WHEN n_nationkey % 6 = 2 THEN '.docx' ELSE '' END AS path FROM nation)"


@query(f"WITH {_PATHS} SELECT path, ['{constants.EPUB}', '{constants.DOCX}', 'application/zip', '{constants.XLSX}', '{constants.ODT}', 'application/zip'][kind + 1] AS detected_format, CAST(0.7 AS DOUBLE) AS confidence FROM n")
def detect_archives(s, d):
    return D.detect(_archives(s, d).select("path", "content")).select("path", "detected_format", "confidence")


@query(
    f"""WITH {_PATHS} SELECT path, 0 AS ordinal, 'paragraph' AS type, 'B ' || n_name AS text, NULL AS level FROM n WHERE kind = 0 UNION ALL SELECT path, 1, 'heading', 'A', 1 FROM n WHERE kind = 0
    UNION ALL SELECT path, 0, 'heading', 'Head ' || n_name, 2 FROM n WHERE kind = 1 UNION ALL SELECT path, 1, 'paragraph', 'text', NULL FROM n WHERE kind = 1
    UNION ALL SELECT path, 2, 'table', 'Table' || chr(10) || '| c1 | c2 |', NULL FROM n WHERE kind = 1"""
)
def archive_blocks(s, d):
    """Chapters in spine order; paragraphs and tables of word-processor files."""
    docs = Documents.from_files(_archives(s, d).where("k % 6 < 3").select("path", "content"))
    names = docs.parsed.select("doc_id", "path")
    return docs.blocks.join(names, "doc_id").select("path", "ordinal", "type", F.col("text_plain").alias("text"), F.col("heading_level").alias("level"))


@query(f"WITH {_PATHS} SELECT path, [2, 3, 0][kind + 1] AS n_blocks, kind = 2 AS failed FROM n WHERE kind < 3")
def batch_isolation(s, d):
    """A file that cannot be read is a row with an error, and the others of its batch are whole."""
    docs = Documents.from_files(_archives(s, d).where("k % 6 < 3").select("path", "content"))
    return docs.parsed.select("path", F.size("raw").alias("n_blocks"), F.col("error").isNotNull().alias("failed"))


@query("SELECT n_nationkey AS doc_id, ['utf-8', 'latin-1', 'utf-8-sig'][n_nationkey % 3 + 1] AS encoding, CASE WHEN n_nationkey % 3 = 1 THEN 'é ' ELSE '' END || n_name || ' is here' AS text FROM nation")
def encodings(s, d):
    """UTF-8 with and without its mark, and Latin-1, found and decoded."""
    k = (F.col("n_nationkey") % 3).cast("int")
    head = F.get(F.array(*[F.unhex(F.lit(x)) for x in ("", "E920", "EFBBBF")]), k)
    files = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("a.txt").alias("path"), F.lit("text/plain").alias("mime_type"), F.concat(head, F.concat("n_name", F.lit(" is here")).cast("binary")).alias("content"))
    found = files.select("doc_id", D.encoding(F.col("content")).alias("encoding"))
    return found.join(Documents(extract.extract(files)).blocks.select("doc_id", F.col("text_plain").alias("text")), "doc_id").select(F.col("doc_id").cast("int"), "encoding", "text")


@query("SELECT n_nationkey AS doc_id, ['application/rtf', 'text/csv', 'text/html', 'text/markdown'][n_nationkey % 4 + 1] AS mime, CASE WHEN n_nationkey % 4 = 2 THEN n_name ELSE '<p>' || n_name || '</p>' END AS text FROM nation")
def format_router(s, d):
    """Each format goes to its parser; one that has none is read as text."""
    mime = F.get(F.array(*map(F.lit, ("application/rtf", "text/csv", "text/html", "text/markdown"))), (F.col("n_nationkey") % 4).cast("int"))
    content = F.concat(F.lit("<p>"), F.col("n_name"), F.lit("</p>")).cast("binary")
    files = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit("").alias("path"), mime.alias("mime_type"), content.alias("content"))
    docs = Documents(extract.extract(files))
    return docs.blocks.join(docs.parsed.select("doc_id", F.col("mime_type").alias("mime")), "doc_id").select(F.col("doc_id").cast("int"), "mime", F.col("text_plain").alias("text"))


@query("SELECT l_orderkey AS doc_id, 2 * count(*) FILTER (l_quantity < 25 AND l_linenumber % 2 = 0) > count(*) AS scanned FROM lineitem GROUP BY l_orderkey")
def scanned_files(s, d):
    """Orders as files, their line items as pages: quantities as numbers of characters, even ones with an image."""
    row = F.struct((F.col("l_quantity") * 2).cast("int").alias("chars"), (F.col("l_linenumber") % 2 == 0).cast("int").alias("images"))
    pages = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(row).alias("p"))
    return pages.select("doc_id", D.is_scanned(F.col("p.chars"), F.col("p.images")).alias("scanned"))


# ------------------------------------------------------------------ references, footnotes, repair, scores


@query(
    f"""WITH {PART}, t AS (SELECT doc_id, k, {filled_sql("Mail a{k}@b.org or see Wikipedia:Widget_{k} and 10.1234/p{k} with arXiv:2101.0000 at https://e.org/{k}.")} AS x FROM p),
    m AS (SELECT doc_id, x, 1 AS seq, 'url' AS type, 'https://e.org/' || k AS target, 1 AS more FROM t UNION ALL SELECT doc_id, x, 2, 'arxiv', 'arXiv:2101.0000', 0 FROM t
      UNION ALL SELECT doc_id, x, 3, 'doi', '10.1234/p' || k, 0 FROM t UNION ALL SELECT doc_id, x, 4, 'wikipedia', 'Wikipedia:Widget_' || k, 0 FROM t UNION ALL SELECT doc_id, x, 5, 'email', 'a' || k || '@b.org', 0 FROM t)
    SELECT doc_id, seq, type, target, x[greatest(1, strpos(x, target) - 30):strpos(x, target) - 1 + length(target) + more + 30] AS context, 'blk-000' AS source_chunk_id FROM m"""
)
def reference_kinds(s, d):
    """All five kinds of references with the text around them."""
    text = filled("Mail a{k}@b.org or see Wikipedia:Widget_{k} and 10.1234/p{k} with arXiv:2101.0000 at https://e.org/{k}.")
    return E.cross_references(Documents.from_texts(parts(s, d).select("doc_id", text.alias("text")), "text/plain").blocks)


def _made(s, d, *rows: tuple[str, str, int | None]) -> DataFrame:
    """Raw blocks of every part: (type, template, level) in order."""
    each = [F.struct(F.lit(t).alias("type"), filled(x).alias("text"), F.lit(n).cast("int").alias("level")) for t, x, n in rows]
    found = parts(s, d).select("doc_id", F.posexplode(F.array(*each)).alias("ordinal", "b")).select("doc_id", "ordinal", "b.*")
    return B.canonical_blocks(raw_of(found))


@query(block_sql([("blk-001", "1", "blk-000"), ("blk-002", "2", "blk-000"), ("blk-001", "1", "blk-003")], ("footnote_chunk_id", "marker", "referenced_by")))
def footnote_links(s, d):
    blocks = _made(s, d, ("paragraph", "Made of iron [1], wood [2] and [1].", None), ("footnote", "[1] iron of {brand}", None), ("footnote", "2. wood {name}", None), ("paragraph", "Once more [1], not [9].", None))
    return E.footnote_links(blocks).select("doc_id", "footnote_chunk_id", "marker", "referenced_by")


@query(
    block_sql([(-1, 1, "Head {k}", "true"), (0, 2, "Head {k}", "false"), (1, 4, "Deep {name}", "false"), (2, 2, "Loud Words", "true"), (3, 3, "Mid", "false"), (4, None, "Text.", "false")], ("ordinal", "level", "text", "inferred")).replace("('true')", "true").replace("('false')", "false")
)
def heading_repair(s, d):
    """Levels close up, a title is inferred, a shouted paragraph becomes a heading."""
    blocks = _made(s, d, ("heading", "Head {k}", 2), ("heading", "Deep {name}", 6), ("paragraph", "LOUD WORDS", None), ("heading", "Mid", 4), ("paragraph", "Text.", None))
    return T.repaired_headings(blocks).select("doc_id", "ordinal", F.col("repaired_level").alias("level"), F.col("repaired_text").alias("text"), "inferred")


@query(block_sql([(0, 1, "A Shouted Title", "true"), (1, None, "text of {name}", "false")], ("ordinal", "level", "text", "inferred")).replace("('true')", "true").replace("('false')", "false"))
def heading_inference(s, d):
    """Headings of a document that has none."""
    blocks = _made(s, d, ("paragraph", "A SHOUTED TITLE", None), ("paragraph", "text of {name}", None))
    return T.repaired_headings(blocks).select("doc_id", "ordinal", F.col("repaired_level").alias("level"), F.col("repaired_text").alias("text"), "inferred")


@query(block_sql([("root", "Before {k}", 0), ("sec-000", "3.{size} Low", 2), ("sec-001", "IV. High", 1)], ("node_id", "title", "level")))
def root_titles(s, d):
    """A root takes the first block's text as its title where the first heading is not of the first level."""
    blocks = _made(s, d, ("paragraph", "Before {k}", None), ("heading", "3.{size} Low", 4), ("heading", "IV. High", 2))
    return T.nodes(T.with_sections(blocks)).select("doc_id", "node_id", "title", "level")


@query(block_sql([(0, "3.{size}"), (1, "IV"), (2, None)], ("ordinal", "label")))
def heading_labels(s, d):
    blocks = _made(s, d, ("heading", "3.{size} Low", 4), ("heading", "IV. High", 2), ("heading", "{name}", 3))
    return blocks.select("doc_id", "ordinal", F.col("heading_label").alias("label"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS doc_id, round(1 - least(0.5, 0.2 * count(*) FILTER (n_nationkey % 3 = 0) + 0.05 * count(*) FILTER (n_nationkey % 3 = 1)), 6) :: DOUBLE AS completeness FROM nation GROUP BY n_regionkey")
def completeness(s, d):
    severity = F.get(F.array(*map(F.lit, ("error", "warning", "info"))), (F.col("n_nationkey") % 3).cast("int"))
    r = E.completeness(table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), severity.alias("severity")))
    return r.select("doc_id", F.round(F.col("completeness").cast("double"), 6).alias("completeness"))


@query("SELECT conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0.3 END :: DOUBLE AS score FROM conversations GROUP BY conv_id")
def structure_score_sections(s, d):
    """Documents without heading levels, half of which have sections."""
    talk = _talk(s, d)
    return E.structure_scores(talk, talk.where("doc_id % 2 = 0")).select("doc_id", F.col("structure_score").cast("double").alias("score"))


@query("SELECT conv_id AS doc_id, 'Explain: ' || conv_id AS instruction, '' AS input, min(text) FILTER (turn = 0) AS output FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn = 0) > 0")
def alpaca_lines(s, d):
    first = table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("Explain: "), F.col("conv_id").cast("string")).alias("instruction"), F.col("text").alias("response"))
    return K.alpaca_lines(first).select("doc_id", F.from_json("json", "instruction string, input string, output string").alias("x")).select("doc_id", "x.*")


# ------------------------------------------------------------------ selection

_CHOSEN = "chosen AS (SELECT * FROM blocks WHERE node <> 'sec-000')"


@query(
    expected(
        """SELECT doc_id, s.node AS node_id, s.parent AS parent_id, CASE s.node WHEN 'sec-001' THEN 'Orders' WHEN 'sec-002' THEN 'Method of query' ELSE '' END AS title,
        coalesce(list(chunk_id ORDER BY ordinal) FILTER (chosen.node = s.node), []) AS chunk_ids
        FROM chosen, (VALUES ('root', NULL), ('sec-000', 'root'), ('sec-001', 'sec-000'), ('sec-002', 'sec-001')) s(node, parent) GROUP BY doc_id, s.node, s.parent""",
        _CHOSEN,
    ),
    lists=("chunk_ids",),
)
def minimal_nodes(s, d):
    """The structure of a selection: nodes that own chosen blocks or lead to them."""
    c = _crm(s, d)
    return Q.minimal(Q.by_section(c.sections, c.nodes, "orders"))["nodes"].select("doc_id", "node_id", "parent_id", "title", "chunk_ids")


@query(expected("SELECT doc_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (type = 'heading') AS sections FROM chosen GROUP BY doc_id", _CHOSEN))
def minimal_statistics(s, d):
    c = _crm(s, d)
    r = Q.minimal(Q.by_section(c.sections, c.nodes, "orders"))["statistics"]
    return r.select("doc_id", F.col("block_count").alias("n"), F.col("total_token_count_est").alias("tokens"), F.col("section_count").alias("sections"))
