"""Every query of the catalogue against its SQL, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

import __spark_entry__
from docloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in result.fetchall())


@pytest.mark.parametrize("name", ["html_headings", "html_title"])
def test_pages_with_cut_references(spark, tmp_path, name):
    """Titles that end within a reference, as the larger tables have them."""
    con = duckdb.connect()
    titles = ["a &amp;&amp", "b &lt", "c &am", "d &amp;lt;", "e &quot;&#39;&#39", "f &"]
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>x</article></body></html>"
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", [(k, page.format(t)) for k, t in enumerate(titles)])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    result = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(result)


def test_titles_with_markup(spark, tmp_path):
    """A title is text up to its end tag, whatever it holds."""
    con = duckdb.connect()
    titles = ["a < b", "a <b", "a <b>c</b> d", "1<2 &amp; 3 > 2", "a <!-- b --> c", "a</b>c", "<![CDATA[q]]>", "x <?y?> z", "a<br/>b", "a <script>b</script> c", " a &lt;i&gt; <i> &am", "</"]
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", [(k, f"<html><head><title>{t}</title></head><body><p>x</body></html>") for k, t in enumerate(titles)])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    df = catalog.QUERIES["html_title"](spark, str(tmp_path))
    result = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES['html_title']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(result)


def test_html_metadata_is_dealt_out(spark, monkeypatch):
    """The parser's tasks do not follow the size of the file of `part`, and it makes no blocks for metadata alone."""
    from docloom.catalog_sources import TASKS
    from docloom.sources import extract

    monkeypatch.setattr(extract.html, "parse_html", None)
    df = catalog.QUERIES["html_metadata"](spark, DATA)
    assert df.rdd.getNumPartitions() == TASKS * spark.sparkContext.defaultParallelism
    assert extract.parse("text/html", b"<title>t</title><p>x", "", blocks=False) == ([], {"title": "t"})


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part(tmp_path):
    """The other queries and the import work where the optional subpackage and the pipeline are absent."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("docloom", "__spark_entry__.py"):
        source = f"{root}/{part}"
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "docloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, docloom.catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
