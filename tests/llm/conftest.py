import zlib

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


#: Null and empty texts, repeated rows, a shared doc_id, a very long text and word, ties, unusual white space.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "something else altogether here"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "word"),
    (7, "word"),
    (None, "word"),
    (None, None),
    (8, "long " * 30000),
    (9, "x" * 5000),
    (10, "Ünïcödé 漢字 😀  \x1c\x85 end"),
    (11, "a b"),
    (12, "A B"),
]


#: Names of columns that operators use for themselves, as integers; `odd` carries them beside the documents' columns.
CLASHING = "rank bits words block bucket place key text_id text_bytes in_doc in_lang cuts rest w b p k n o fold step size shard slot turn level pos at hi lo ahead back n_lines n_shingles set_hi set_lo id copies component_id toxicity perplexity threshold n_tokens doc copy part".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns whose names clash with those that operators use, in other cases too, and one that needs quoting."""
    rows = [(i, t, "en" if k % 3 else None, "s", 7, *[k] * len(CLASHING), "x", 1) for k, (i, t) in enumerate(ODD)]
    extra = "".join(f", {c.upper() if c in ('bits', 'place', 'text_id') else c} int" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long{extra}, label string, `a.b` int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3
