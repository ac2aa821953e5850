import random
import re

import duckdb
import numpy as np
import pytest

from docloom.llm import linededup


def brute(rows, least):
    """(doc_id, text) -> (n_lines, rest) by comparing all pairs of lines along diagonals."""
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda d: (d[0] is not None, d[0] if d[0] is not None else 0))
    flat = []
    for d, (_, t) in enumerate(docs):
        flat += [(d, k, x) for k, x in enumerate(t.split("\n"))] + [None]
    gone = set()
    for p in range(len(flat)):
        for q in range(p):
            if flat[p] and flat[q] and flat[p][2] == flat[q][2] and not (q and flat[p - 1] and flat[q - 1] and flat[p - 1][2] == flat[q - 1][2]):
                n = words = 0
                while p + n < len(flat) and flat[p + n] and flat[q + n] and flat[p + n][2] == flat[q + n][2]:
                    words += len(re.split(rb"[ \t\x0b\x0c\r]+", flat[p + n][2].encode().strip(b" \t\x0b\x0c\r"))) if flat[p + n][2].strip(" \t\x0b\x0c\r") else 0
                    n += 1
                if words >= least:
                    gone |= {flat[p + k][:2] for k in range(n)}
    out = {}
    for d, (i, t) in enumerate(docs):
        lines = t.split("\n")
        out[i, t] = (len(lines), "\n".join(x for k, x in enumerate(lines) if (d, k) not in gone))
    return out


def test_shortest_runs():
    assert linededup.shortest_runs(np.array([10, 3, 0, 8, 1]), 10).tolist() == [1, 3, 0, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_runs_are_maximal(spark, seed):
    """Every later copy comes with the longest prefix that it shares with an earlier suffix, whatever the depth."""
    rng = random.Random(seed)
    docs = [[rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    docs += [docs[0] * 5, docs[0] * 5, list("abcdefghijklmnopqrstu"), list("xabcdefghijklmnopqrstv"), ["a"] * 40]
    df = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.pos): r.n_lines for r in linededup.repeated_runs(df, 1).collect()}
    want, seen = {}, []
    for i, d in enumerate(docs):
        for p in range(len(d)):
            best = 0
            for e in seen:
                n = 0
                while n < min(len(e), len(d) - p) and e[n] == d[p + n]:
                    n += 1
                best = max(best, n)
            if best:
                want[i, p] = best
            seen.append(d[p:])
    assert got == want and max(got.values()) > 16


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (0, 1, 2, 3, 3, 5, 9, 11, 12)]
    unique = iter(range(10**6))
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"only {next(unique)}" for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 10)
    for r in linededup.dedup_lines(df, 10).collect():
        n, rest = want.get((r.doc_id, dict(rows)[r.doc_id]), (0, ""))
        assert (r.n_lines, r.text) == (n, rest) and r.n_deleted == n - (len(rest.split("\n")) if r.n_deleted < n else 0)


def test_against_sql(table):
    docs = table("documents")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(map(tuple, con.execute(linededup.ORACLE).fetchall()))
    got = sorted((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in linededup.dedup_lines(docs).collect())
    assert got == want and any(r[2] for r in got)


def test_odd_rows(spark, odd, empty):
    out = linededup.dedup_lines(odd)
    assert out.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_deleted"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.n_lines == 0 and r.text in (None, "") for r in rows if not r.text)
    assert linededup.dedup_lines(empty).collect() == []
    passage = "one two three four five six seven eight nine ten eleven"
    again = spark.createDataFrame([(None, passage), (1, f"a\n{passage}"), (1, f"a\n{passage}"), (1, f"{passage}\nb")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in linededup.dedup_lines(again).collect())
    assert got == [(-1, passage), (1, "a"), (1, "a"), (1, "b")]
