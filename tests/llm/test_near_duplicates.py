import random
import re

import numpy as np
import pytest

from docloom.llm import minhash
from docloom.llm.common import LOWER, shingle_sets, words_of
from docloom.llm.components import components, forest
from docloom.llm.common import Scratch

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows, width=2, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets, parent = [], {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, s))
        if i is not None:
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def found(df, **k):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **k).collect()), key=repr)


def test_words_and_shingles():
    texts = [b"One  two\tthree", b"", b"one", b"\xc2\xa0x y\x1cz"]
    hashes, owner, first = words_of(texts)
    assert first.tolist() == [0, 3, 3, 4, 6] and owner.tolist() == [0, 0, 0, 2, 3, 3]
    assert hashes[0] == hashes[3]
    grams, at = shingle_sets([b"a b a b a", b"a b", b"b a", b"a"], 2)
    assert np.diff(at).tolist() == [2, 1, 1, 1]
    assert set(grams[at[1] : at[2]]) | set(grams[at[2] : at[3]]) == set(grams[at[0] : at[1]])


def test_against_all_pairs(spark, table):
    docs = table("documents").select("doc_id", "text")
    assert found(docs, width=2) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, width=2) == brute(rows)
    assert minhash.near_duplicates(empty).collect() == []
    kept = {(r.doc_id, r.kept) for r in minhash.near_duplicates(odd, width=2).collect()}
    assert (1, True) in kept and (2, False) in kept and (7, False) in kept and (None, True) in kept


@pytest.mark.parametrize("seed, small", [(1, 64), (2, 64), (2, 1024)])
def test_large_group_of_near_copies(spark, monkeypatch, seed, small):
    """A group far beyond a small node's size, with outsiders at its edge, next to unrelated documents; and compared exhaustively."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
            w[rng.randrange(60)] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(40))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width=2) == brute(rows)


def test_components(spark):
    a, b = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 8}
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.label for r in components(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_components_over_the_cluster(spark, monkeypatch):
    """The iteration that runs while one task could not hold the links."""
    from docloom.llm import components as module

    monkeypatch.setattr(module, "PART_LINKS", 10)
    links = [(i, i + 1) for i in range(0, 80)] + [(200, 100)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.label for r in module.components(df, Scratch(spark, "test"), "d").collect()}
    assert got == {**{i: 0 for i in range(1, 81)}, 200: 100}
