"""Operator 3: exact top-k inner products by best-first search in M-trees.

Inner products become distances by one more dimension: with a component
sqrt(R^2 - |v|^2), R the largest norm, all rows lie on a sphere, and the row of
largest inner product is the nearest one. Vectors of each length are an index of
their own. Rows go to the nearest of a bounded number of pivots, and each pivot's
rows to M-trees of bounded size: pages of entries, each with its distance to the page's routing object, and for inner
entries the covering radius of the page below.

A query first searches the trees of the pivot it is nearest to. The k-th score
found there bounds the rest: by the triangle inequality a pivot whose distance
less its covering radius exceeds the bound holds no better row, and within a
tree the stored parent distances rule out entries before any distance is
computed. Scores are integers, computed from the quantised vectors; all bounds
give way to rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, prepare
from docloom.llm.vectors import QUERY_ROWS, best_of, groups_of_width, matrix, pack, salted, smallest, usable

#: Pivots that the rows of a length are dealt to, at most, from a sample of a row for each of so many hash values.
PIVOTS, SAMPLE = 64, 4096
TREE_ROWS, PAGE = 4096, 64
#: Slack of every bound against rounding, in units of the sphere's radius.
SLACK = 1e-6


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, never below 0."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    """v with the component that puts every row on the sphere of this squared radius."""
    return np.concatenate((v, np.sqrt(np.maximum(radius2 - (v * v).sum(1, keepdims=True), 0))), 1)


def asking(q: np.ndarray) -> np.ndarray:
    """Queries beside lifted rows: their squared distance to a row is |q|^2 + R^2 - 2 q.v."""
    return np.concatenate((q, np.zeros((len(q), 1))), 1)


class Tree:
    """Pages over rows x (lifted): a leaf page lists rows, an inner page lists pages with routing objects and radii."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.pages: list[tuple] = []  # (leaf, members, centre of the page, parent distances, radii)
        self.root = self._build(np.arange(len(x)), x[:1][0] if len(x) else None)

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> int:
        x = self.x[rows]
        if len(rows) <= PAGE:
            self.pages.append((True, rows, centre, distances(x, centre[None])[:, 0], None))
            return len(self.pages) - 1
        routers = self._routers(rows)
        near = np.argmin(distances(x, self.x[routers]), 1)
        if len(np.unique(near)) == 1:  # equal rows: any split is as good
            parts = min(16, -(-len(rows) // PAGE))
            near, routers = np.arange(len(rows)) * parts // len(rows), np.repeat(routers[:1], parts)
        children, radii, members = [], [], []
        for r in np.unique(near):
            mine = rows[near == r]
            c = self.x[routers[r]]
            children.append(self._build(mine, c))
            radii.append(distances(self.x[mine], c[None]).max())
            members.append(routers[r])
        members = np.array(members)
        self.pages.append((False, np.array(children), centre, distances(self.x[members], centre[None])[:, 0], np.array(radii), members))
        return len(self.pages) - 1

    def _routers(self, rows: np.ndarray) -> np.ndarray:
        """Far-apart rows, greedily: the first, then always the one farthest from those chosen."""
        n = min(16, max(2, len(rows) // PAGE + 1))
        chosen = [0]
        far = distances(self.x[rows], self.x[rows[:1]])[:, 0]
        while len(chosen) < n:
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, distances(self.x[rows], self.x[rows[chosen[-1:]]])[:, 0])
        return rows[np.unique(chosen)]

    def search(self, q: np.ndarray, lift: np.ndarray, bound: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, slack: float):
        """(scores, ids) of the k best rows for each query, nearest pages first; -inf and -1 fill up.

        q are the queries as lifted, `lift` their squared distance at inner product 0,
        `bound` the distances beyond which a row is of no use, `own` each query's own id.
        """
        scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        bound, plain = bound.copy(), self.x[:, :-1]
        everyone = np.arange(len(q))
        heap: list[tuple] = [(0.0, 0, self.root, everyone, np.zeros(len(q)), distances(q, self.pages[self.root][2][None])[:, 0])]
        pushed = 0
        while heap:
            _, _, page, who, low, to_centre = heapq.heappop(heap)
            live = low <= bound[who] + slack
            who, to_centre = who[live], to_centre[live]
            if not len(who):
                continue
            leaf, members, _, parent, radii, *rest = self.pages[page]
            # |d(q, centre) - d(entry, centre)| bounds d(q, entry) without computing it
            lower = np.abs(to_centre[:, None] - parent) - (0 if leaf else radii)
            open_ = lower <= bound[who, None] + slack
            entries, queries = np.flatnonzero(open_.any(0)), np.flatnonzero(open_.any(1))
            if not len(entries):
                continue
            who, open_ = who[queries], open_[np.ix_(queries, entries)]
            if leaf:
                at = members[entries]
                s = np.where(open_ & (ids[at] != own[who, None]), q[who, :-1] @ plain[at].T, -np.inf)
                better = np.flatnonzero((s >= scores[who, -1:]).any(1) & np.isfinite(s).any(1))
                for j in better:
                    w = who[j]
                    all_scores = np.concatenate((scores[w], s[j]))
                    all_ids = np.concatenate((found[w], ids[at]))
                    best = smallest(-all_scores, all_ids, k)
                    scores[w], found[w] = all_scores[best], all_ids[best]
                    if np.isfinite(scores[w, -1]):
                        bound[w] = min(bound[w], np.sqrt(max(0.0, lift[w] - 2 * scores[w, -1])))
            else:
                d = distances(q[who], self.x[rest[0][entries]])
                least = np.maximum(d - radii[entries], 0)
                go = open_ & (least <= bound[who, None] + slack)
                for e in np.flatnonzero(go.any(0)):
                    mine = np.flatnonzero(go[:, e])
                    pushed += 1
                    heapq.heappush(heap, (float(least[mine, e].min()), pushed, int(members[entries[e]]), who[mine], least[mine, e], d[mine, e]))
        return scores, found


def quantised(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * component) as doubles, of the usable rows."""
    out = usable(rows)
    return out.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def pivots_of(rows: DataFrame, n: int, sample: int) -> dict[int, tuple[np.ndarray, float]]:
    """For each vector length: far-apart vectors of a bounded sample, lifted, and the squared radius of the sphere."""

    def choose(table: pa.Table) -> pa.Table:
        x = np.unique(matrix(table.column("v").combine_chunks()), axis=0)
        chosen = [0]
        far = distances(x, x[:1])[:, 0]
        while len(chosen) < min(n, len(x)):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
        return pa.table({"pivots": pa.array(x[chosen].tolist(), pa.list_(pa.float64()))})

    first = rows.groupBy("width", F.pmod(F.xxhash64("vec_id"), F.lit(sample)).alias("slot")).agg(F.min(F.struct("vec_id", "v")).alias("x"))
    # at most `sample` rows of a length, and `n` of them to the driver
    chosen = first.select("width", "x.v").groupBy("width").applyInArrow(choose, "pivots array<double>")
    found: dict[int, list] = {}
    for r in chosen.collect():
        found.setdefault(len(r["pivots"]), []).append(r["pivots"])
    norms = rows.groupBy("width").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("r2"))
    radii = {r["width"]: float(r["r2"]) for r in norms.collect()}
    return {w: (lifted(np.array(x), radii[w]), radii[w]) for w, x in found.items()}


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product with each query.

    rows and queries have vec_id and embedding. A row is no candidate for a query
    of its own vec_id. Vectors null, empty, or with null or non-finite components
    take no part; only vectors of the query's length are candidates. Ties rank by
    vec_id. Repeated rows of a vec_id count once if their vectors agree. Fewer
    than k rows give as many; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "mtree")
    schema = "query_id long, vec_id long, score long"
    base = scratch.table(quantised(rows, scale).distinct().withColumn("width", F.size("v")), "rows")
    index = pivots_of(base, PIVOTS, SAMPLE)
    if not index:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at in groups_of_width(batch.column(1)):
                centres, radius2 = index[width]
                part = batch.take(pa.array(at))
                d = distances(lifted(matrix(part.column(1)), radius2), centres)
                near = np.argmin(d, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "width", "pivot", "far"])

    group = ["width", "pivot"]  # at most PIVOTS groups for each length that occurs
    dealt = base.select("vec_id", "v", "width").mapInArrow(assign, "vec_id long, v array<double>, width int, pivot int, far double")
    blocks = pack(salted(dealt, group, TREE_ROWS, F.col("vec_id")), [*group, "block"], ["vec_id", "v", "far"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.array(batch.column(3)[i].as_py())
                order = np.argsort(ids)
                tree = Tree(lifted(matrix(batch.column(4)[i].values)[order], index[batch.column(0)[i].as_py()][1]))
                far = float(np.max(batch.column(5)[i].as_py()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), pa.array([far]), pa.array([pickle.dumps((ids[order], tree))], pa.binary())], [*group, "block", "radius", "tree"])

    trees = scratch.table(blocks.mapInArrow(grow, "width int, pivot int, block int, radius double, tree binary"), "trees")
    # which pivots of a length have rows, how far these reach, and in how many trees they are: at most PIVOTS rows a length
    reach: dict[int, list[tuple[int, float, int]]] = {}
    for r in trees.groupBy(*group).agg(F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy(*group).collect():
        reach.setdefault(r["width"], []).append((r["pivot"], r["radius"], r["n"]))
    asked = quantised(queries, scale).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for width, at in groups_of_width(batch.column(1)):
                    if width not in reach:
                        continue
                    mine = batch.take(pa.array(at))
                    present, radius, blocks = (np.array(x) for x in zip(*reach[width], strict=True))
                    d = distances(asking(matrix(mine.column(1))), index[width][0][present])
                    home = np.argmin(d, 1)
                    if first:
                        who, to = np.arange(len(d)), home
                    else:
                        bound = mine.column(2).to_numpy(zero_copy_only=False)
                        open_ = d - radius <= bound[:, None] + SLACK * max(1.0, np.sqrt(index[width][1]))
                        open_[np.arange(len(d)), home] = False
                        who, to = np.nonzero(open_)
                    # every tree of a visited pivot is a place of its own
                    times = blocks[to]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, to = np.repeat(who, times), np.repeat(to, times)
                    part = mine.take(pa.array(who))
                    bound = np.full(len(who), np.inf) if first else part.column(2).to_numpy(zero_copy_only=False)
                    columns = [part.column(0), part.column(1), pa.array(bound), pa.array(np.full(len(who), width, np.int32)), pa.array(present[to].astype(np.int32)), pa.array(block.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "bound", *group, "block"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, ids = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here = tuple(batch.column(c)[i].as_py() for c in (0, 1, 2))
                if here != last:  # query blocks of one tree follow each other
                    last, (ids, tree) = here, pickle.loads(batch.column(6)[i].as_py())
                own, bound = (np.array(batch.column(c)[i].as_py()) for c in (3, 5))
                q = matrix(batch.column(4)[i].values)
                radius2 = index[here[0]][1]
                scores, found = tree.search(asking(q), (q * q).sum(1) + radius2, bound, own, ids, k, SLACK * max(1.0, np.sqrt(radius2)))
                at, column = np.nonzero(np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(found[at, column]), pa.array(scores[at, column].astype(np.int64))], ["query_id", "vec_id", "score"])

    def searched(visitors: DataFrame, name: str) -> DataFrame:
        place = [*group, "block"]
        n = visitors.groupBy(*group).agg(F.ceil(F.count_distinct("query_id") / F.lit(QUERY_ROWS)).cast("int").alias("parts"))
        salted_ = visitors.join(F.broadcast(n), group).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        packed = pack(salted_, [*place, "part"], ["query_id", "q", "bound"])
        pairs = packed.join(trees, place).select(*place, "query_id", "q", "bound", "tree")
        return scratch.table(pairs.mapInArrow(search, schema).distinct(), name)

    visit_schema = "query_id long, q array<double>, bound double, width int, pivot int, block int"
    asked = scratch.table(asked, "asked")
    home = searched(asked.mapInArrow(visits(True), visit_schema), "home")
    order = [F.desc("score"), F.col("vec_id")]
    full = best_of(home, k, order).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x) + F.element_at(F.create_map(*[F.lit(y) for w, (_, r2) in index.items() for y in (w, r2)]), F.size("q"))
    # a query that has not found k rows yet is bounded by nothing
    bound = F.when(F.col("s").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(norm - 2 * F.col("s"), F.lit(0.0))))
    rest = searched(asked.join(full, "query_id", "left").select("query_id", "q", bound.alias("bound")).mapInArrow(visits(False), visit_schema), "rest")
    return best_of(home.unionByName(rest).distinct(), k, order).select("query_id", "rank", "vec_id", "score")


#: The same rows by brute force over all pairs; components are finite and not null, as the test tables' are.
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
