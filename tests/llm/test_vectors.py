import math

import numpy as np
import pytest

from docloom.llm import crosspolytope, mtree

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0, 0) for i in range(60)]
    rows += [(100 + i, rows[5][1], 1, 1) for i in range(150)]  # equal vectors: ties, and a group beyond a page
    rows += [(5, rows[5][1], 2, 2), (400, None, 0, 0), (401, [1.0] * 7 + [None], 0, 0), (402, [math.nan] * 8, 0, 0), (403, [math.inf] + [0.0] * 7, 0, 0), (404, [0.0] * 8, 0, 0), (405, [], 0, 0), (None, [1.0] * 8, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: np.array(r[1]) for r in rows[:210] + [rows[215]]}


def exact(vectors, queries, score, k):
    out = []
    for q in queries:
        order = sorted((score(vectors[q], v), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, n, i, s) for n, (s, i) in enumerate(order, 1)]
    return sorted(out)


def inner(a, b):
    return -int(np.floor(64 * a.astype(np.float32).astype(float)) @ np.floor(64 * b.astype(np.float32).astype(float)))


def test_top_k_is_exact(table):
    rows = table("embeddings")
    vectors = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    got = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in mtree.top_k(rows, rows.where("vec_id % 20 = 0")).collect())
    assert got == exact(vectors, [i for i in vectors if i % 20 == 0], inner, 20)


def test_top_k_of_odd_vectors(spark):
    rows, vectors = odd_vectors(spark)
    got = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in mtree.top_k(rows, rows.where("vec_id < 10 OR vec_id = 404")).collect())
    assert got == exact(vectors, [*range(10), 404], inner, 20)
    assert mtree.top_k(rows.limit(0), rows).collect() == []
    few = rows.where("vec_id < 3")
    assert len(mtree.top_k(few, few).collect()) == 6


def test_every_length_is_an_index_of_its_own(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(100 + i, [float(x) for x in rng.normal(size=4)]) for i in range(21)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = {i: np.array(v) for i, v in rows}
    want = sorted(x for w in (8, 4) for x in exact({i: v for i, v in vectors.items() if len(v) == w}, [i for i in vectors if i % 20 == 0 and len(vectors[i]) == w], inner, 20))
    got = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in mtree.top_k(df, df.where("vec_id % 20 = 0")).collect())
    assert got == want and {q for q, *_ in got} == {0, 20, 40, 100, 120}


def test_top_k_with_small_trees(spark, monkeypatch):
    """Several trees to a pivot, and several blocks of queries to a tree."""
    monkeypatch.setattr(mtree, "PIVOTS", 3)
    monkeypatch.setattr(mtree, "TREE_ROWS", 50)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 8)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = {i: np.array(v) for i, v in rows}
    got = sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in mtree.top_k(df, df.where("vec_id % 10 = 0")).collect())
    assert got == exact(vectors, range(0, 700, 10), inner, 20)


def test_tree_holds_every_row_within_its_radii():
    x = mtree.lifted(np.random.default_rng(1).normal(size=(3000, 6)), 60.0)
    tree = mtree.Tree(x)
    seen = np.sort(np.concatenate([p[1] for p in tree.pages if p[0]]))
    assert seen.tolist() == list(range(3000))

    def rows_below(k):
        p = tree.pages[k]
        return p[1] if p[0] else np.concatenate([rows_below(c) for c in p[1]])

    for leaf, members, centre, parent, radii, *rest in tree.pages:
        ref = x[members] if leaf else x[rest[0]]
        assert np.allclose(parent, mtree.distances(ref, centre[None])[:, 0])
        if not leaf:
            for child, r, router in zip(members, radii, rest[0], strict=True):
                assert mtree.distances(x[rows_below(child)], x[router][None]).max() <= r + 1e-9
    assert len(mtree.Tree(np.ones((1000, 4))).pages) > 1


def distance(a, b):
    return float(np.sqrt(((a - b) ** 2).sum()))


def test_nearest_recall_and_scores(table):
    rows = table("embeddings")
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    queries = [i for i in vectors if i % 10 == 0]
    want = exact(vectors, queries, distance, 10)
    got = crosspolytope.nearest(rows, rows.where("vec_id % 10 = 0")).collect()
    hits = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(hits) >= 0.9 * len(want)
    for r in got:
        assert r.score == pytest.approx(distance(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)
    for q in queries:
        mine = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_recall_with_the_registered_probes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows.collect()}
    queries = [i for i in vectors if i % 100 == 0]
    want = {(q, i) for q, _, i, _ in exact(vectors, queries, distance, 10)}
    got = {(r.query_id, r.vec_id) for r in crosspolytope.nearest(rows, rows.where("vec_id % 100 = 0")).collect()}
    assert len(want & got) >= 0.95 * len(want)


@pytest.mark.parametrize("n", [2, 5, 11, 20])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(n)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        vectors = {i: np.array(v, dtype="f4" if kind == "float" else "f8").astype(float) for i, v in rows}
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in crosspolytope.nearest(df, df).collect())
        assert len(got) == n * min(10, n - 1)
        if n <= 11:
            assert got == [x[:3] for x in exact(vectors, range(n), distance, 10)]


def test_nearest_of_odd_vectors(spark):
    rows, vectors = odd_vectors(spark)
    del vectors[404]  # the zero vector has no direction
    got = crosspolytope.nearest(rows, rows.where("vec_id IN (5, 100, 404)")).collect()
    assert {r.query_id for r in got} == {5, 100}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 5] == [(100 + i, 0.0) for i in range(10)]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == [5, *range(101, 110)]
    assert crosspolytope.nearest(rows.limit(0), rows).collect() == []


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 8))
    assert np.allclose((crosspolytope.hadamard(x) ** 2).sum(1), (x**2).sum(1))
    assert np.allclose(crosspolytope.hadamard(crosspolytope.hadamard(x)), x)
