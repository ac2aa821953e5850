"""Operator 1: near-duplicate components by a chosen-path set similarity join.

Each distinct shingle set has minwise hashes. In every one of a few independent
trees the sets are dealt to nodes: a node chooses coordinates by its own path,
and a set goes to the children named by its minwise tokens there. The root's
children take one coordinate each, those of deeper nodes two, so that a level
does the work of two. Two sets of Jaccard similarity 0.8 share a root's child
with probability 0.96 and a deeper one's with 0.98; with four trees a pair is
missed about once in 10^5.

Small nodes are compared exhaustively; in a large one every set is compared with
a few pivots, and the node branches on. A large node most of whose sets are like
a pivot would hardly get smaller. It ends: once its sets are linked as far as
other comparisons do it, each set outside the node's largest component is
compared with all of the node, on full sets where the minwise bytes leave a
chance. So no link to an outsider is lost, and none within the component is
sought again. A small node with very many candidates ends likewise.

Comparisons use one byte for each coordinate. What they find are candidates;
every link is confirmed on the full sets. Candidates between sets that are
already connected need no confirmation, so the likeliest one of each set goes
first. Copies with equal sets are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import IdFilter, Scratch, in_filter, mix, prepare, shingle_sets, sub_batches, trim, utf8
from docloom.llm.components import components

#: Coordinates that are compared, and how many of them name paths.
COORDINATES, PATHS = 128, 32
TREES, ROOT_CHOICES, CHOICES, DEPTH = 4, 2, 4, 4
#: Sets in a node that is compared exhaustively, at most; pivots of a larger one.
SMALL, PIVOTS = 1024, 16
#: Equal coordinates that make a candidate (a pair at 0.8 has fewer once in 10^6), that need no doubt, and that make two sets alike.
CANDIDATE, SURE, ALIKE = 81, 122, 90
#: Candidates a set, in a small node, beyond which it ends.
CROWD = 3
SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, minwise array<int>, bytes binary"

_RNG = np.random.default_rng(90210)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minwise hashes (32 bits) of each non-empty set; rows of empty sets are 0."""
    out = np.zeros((len(first) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                out[full, k] = np.minimum.reduceat(((grams ^ (grams >> np.uint64(29))) * _MULTIPLIERS[k]) >> np.uint64(32), first[full])
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, the size and a 128-bit name of its shingle set, minwise hashes and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in sub_batches(np.array([len(t) for t in texts])):
                grams, first = shingle_sets(texts[a:b], width)
                counts = np.diff(first)
                hashes = minwise(grams, first)
                full = np.flatnonzero(counts)
                names = np.zeros((2, b - a), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        for row, salt in enumerate((0x51ED270B, 0xA0761D64)):
                            names[row, full] = np.add.reduceat(mix(grams + np.uint64(salt)), first[full])
                flat = pa.array(np.ascontiguousarray(hashes[:, :PATHS]).view(np.int32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * PATHS), flat)
                low = (hashes ^ (hashes >> 8) ^ (hashes >> 16) ^ (hashes >> 24)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), lists, pa.array([r.tobytes() for r in low], pa.binary())],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "minwise", "bytes"],
                )
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE)


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many coordinates agree, for all rows of x with all rows of y."""
    out = np.empty((len(x), len(y)), np.int16)
    step = max(1, (1 << 22) // max(1, len(y) * COORDINATES))
    for i in range(0, len(x), step):
        out[i : i + step] = (x[i : i + step, None] == y[None]).sum(2)
    return out


def candidates_of(ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(a, b, agreeing coordinates) of a node's candidate pairs, and whether the node ends.

    A spanning forest of the sure pairs goes first, then all others between its
    trees. Where these are more than CROWD a set, the node gives a spanning
    forest of all and ends: its other links are sought on full sets later.
    """
    same = equal_bytes(rows, rows)
    fits = np.minimum(sizes[:, None], sizes) * 100 >= percent * np.maximum(sizes[:, None], sizes)
    i, j = np.nonzero(np.triu((same >= CANDIDATE) & fits, 1))
    score = same[i, j]
    order = np.lexsort((j, i, -score))
    i, j, score = i[order], j[order], score[order]
    tree = np.arange(len(ids))

    def joins(pairs: range) -> list[int]:
        """The pairs that join two trees."""
        out = []
        for k in pairs:
            x, y = tree[i[k]], tree[j[k]]
            if x != y:
                tree[tree == max(x, y)] = min(x, y)
                out.append(k)
        return out

    n_sure = int((score >= SURE).sum())
    sure = joins(range(n_sure))
    between = np.flatnonzero(tree[i] != tree[j])
    ends = len(between) > CROWD * len(ids)
    keep = np.array(sure + (joins(range(n_sure, len(i))) if ends else between.tolist()), np.int64)
    a, b = ids[i[keep]], ids[j[keep]]
    return np.minimum(a, b), np.maximum(a, b), score[keep], ends


def _arrays(row_ids: pa.Array, row_bytes: pa.Array, row_sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(row_bytes.to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return row_ids.to_numpy(zero_copy_only=False), rows, row_sizes.to_numpy(zero_copy_only=False)


PAIRS = "a long, b long, same int"


def _pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]).astype(np.int32))], ["a", "b", "same"])


def compare_nodes(blocks: DataFrame, percent: int) -> DataFrame:
    """Candidates a, b, same within each row's sets (columns node, and id, bytes, n as lists); the sets of a node that ends follow as node, id, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                ids, rows, sizes = _arrays(*(batch.column(c)[i].values for c in (1, 2, 3)))
                *pairs, ends = candidates_of(ids, rows, sizes, percent)
                found.append(tuple(pairs))
                if ends:
                    found.append((np.full(len(ids), batch.column(0)[i].as_py()), ids, np.full(len(ids), -1)))
            if found:
                yield _pairs(found)

    return blocks.select("node", "id", "bytes", "n").mapInArrow(run, PAIRS)


def compare_pivots(blocks: DataFrame) -> DataFrame:
    """node, id, and the pivot that shares the most coordinates with it: a, b, same (columns node, id, bytes, n and p_id, p_bytes as lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, _ = _arrays(*(batch.column(c)[i].values for c in (1, 2, 3)))
                p_ids, p_rows, _ = _arrays(*(batch.column(c)[i].values for c in (4, 5, 6)))
                same = equal_bytes(rows, p_rows)
                same[ids[:, None] == p_ids] = -1
                best = same.argmax(1)
                p = p_ids[best]
                node = pa.array(np.full(len(ids), batch.column(0)[i].as_py()))
                yield pa.RecordBatch.from_arrays([node, pa.array(ids), pa.array(np.minimum(ids, p)), pa.array(np.maximum(ids, p)), pa.array(same[np.arange(len(ids)), best].astype(np.int32))], ["node", "id", "a", "b", "same"])

    return blocks.select("node", "id", "bytes", "n", "p_id", "p_bytes", "p_n").mapInArrow(run, "node long, id long, a long, b long, same int")


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.collect_list(F.struct("id", "bytes", "n")).alias("_rows"))
    return out.select(*by, *[F.col("_rows")[c].alias(c) for c in ("id", "bytes", "n")])


def salt(c: str, blocks) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(7), c), blocks).cast("int")


def branch(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Children of the placed sets (node, id): the node's path chooses two coordinates for each."""
    at = placed.join(sets.select("id", "minwise"), "id").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(CHOICES - 1))))
    pick = [F.pmod(F.xxhash64("node", F.lit(s), F.col("j")), F.lit(PATHS)).cast("int") for s in (1, 2)]
    tokens = [F.element_at("minwise", c + 1) for c in pick]
    return at.select(F.xxhash64("node", *pick, *tokens).alias("node"), "id")


def chosen_paths(sets: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidates a, b, same; the large nodes that ended: node, id)."""
    roots = F.explode(F.array(*[F.lit(k) for k in range(TREES * ROOT_CHOICES)]))
    # the trees' roots take coordinates of their own
    nodes = sets.select("id", "minwise", roots.alias("c")).select(F.xxhash64("c", F.element_at("minwise", F.col("c") + 1)).alias("node"), "id")
    found, ended = [], []
    for depth in range(1, DEPTH + 1):
        counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        held = scratch.table(nodes.join(counts, "node").join(sets.select("id", "bytes", "n"), "id"), f"held{depth}")
        small = scratch.table(compare_nodes(packed(held.where(F.col("size") <= SMALL), ["node"]), percent), f"small{depth}")
        found.append(small.where("same >= 0"))
        ended.append(small.where("same < 0").select(F.col("a").alias("node"), F.col("b").alias("id")))
        large = held.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        # the pivots: the first PIVOTS sets of each node by hash, which each task limits for itself before they meet;
        # a node of any size is dealt over the cluster in blocks
        first = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(3), "node", "id"), "id")
        pick = large.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS)
        blocks = F.ceil(F.col("size") / 1024).cast("int")
        pivots = packed(pick, ["node", "size"]).select("node", *[F.col(c).alias(f"p_{c}") for c in ("id", "bytes", "n")], F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        spread = packed(large.withColumn("block", salt("id", blocks)), ["node", "block"])
        near = scratch.table(compare_pivots(spread.join(pivots, ["node", "block"])), f"near{depth}")
        found.append(near.where(F.col("same") >= CANDIDATE).select("a", "b", "same"))
        ends = near.groupBy("node").agg(F.avg((F.col("same") >= ALIKE).cast("int")).alias("alike")).where((F.col("alike") >= 0.7) | F.lit(depth == DEPTH)).select("node")
        ends = scratch.table(ends, f"ends{depth}")
        ended.append(large.select("node", "id").join(ends, "node", "left_semi"))
        rest = large.select("node", "id").join(ends, "node", "left_anti")
        if depth == DEPTH or rest.isEmpty():
            break
        nodes = branch(rest, sets)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    pairs = scratch.table(pairs.groupBy("a", "b").agg(F.max("same").alias("same")), "candidates")
    last = ended[0] if ended else sets.select(F.col("id").alias("node"), "id").limit(0)
    for x in ended[1:]:
        last = last.unionByName(x)
    last = scratch.table(last, "ended")
    scratch.release(*[f"{n}{d}" for n in ("held", "small", "near", "ends") for d in range(1, DEPTH + 1)])
    return pairs, last


def shingles_again(docs: DataFrame, wanted: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """id and set (sorted 64-bit hashes) of the wanted documents: a written table with the column id."""
    found = IdFilter(wanted, "id")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.withColumn("place", found.place("id"))
    with found.shared() as shared:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for batch in batches:
                batch = batch.take(pa.array(in_filter(bits, batch.column(2).to_numpy())))
                texts = utf8(batch.column(1))
                for a, b in sub_batches(np.array([len(t) for t in texts])):
                    grams, first = shingle_sets(texts[a:b], width)
                    sets = [grams[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["id", "set"])

        return scratch.table(rows.mapInArrow(run, "id long, set binary").join(wanted, "id", "left_semi"), name)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(both) - inter) and len(both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    with_a = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    la = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    out = pairs.join(la, "a", "left").join(lb, "b", "left")
    return out.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def overlaps(x: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set x each of the sets has."""
    sizes = np.array([len(m) for m in members], np.int64)
    if not len(x) or not sizes.sum():
        return np.zeros(len(members), np.int64)
    every = np.concatenate(members)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def outside_links(docs: DataFrame, ended: DataFrame, labels: DataFrame, signed: DataFrame, width: int, scratch: Scratch, percent: int) -> DataFrame:
    """Links between the sets of an ended node that are outside its largest component and any of its sets, on full sets.

    Full sets are compared where the minwise bytes (of `signed`) make a candidate.
    Of the links of one set with one component within a block, one is enough.
    """
    rows = ended.distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = scratch.table(rows, "placed")
    sizes = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("size"), (F.sum("k") - F.max("k")).alias("outside"))
    main = scratch.table(main.where("outside > 0"), "main")
    none = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if main.isEmpty():
        return none
    rows = rows.join(main, "node")
    wanted = scratch.table(rows.select("id").distinct(), "outside-ids")
    sets = shingles_again(docs, wanted, width, scratch, "outside-sets")
    rows = rows.join(sets.join(signed.select("id", "bytes"), "id"), "id")
    # blocks of 32 outsiders meet blocks of 256 sets of their node
    left = rows.where("label <> main").withColumn("part", salt("id", F.ceil(F.col("outside") / 32).cast("int"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / 256).cast("int") - 1)))
    left = left.groupBy("node", "part", "block").agg(F.collect_list(F.struct("id", "label", "set", "bytes")).alias("x"))
    right = rows.withColumn("block", salt("id", F.ceil(F.col("size") / 256).cast("int")))
    right = right.groupBy("node", "block").agg(F.collect_list(F.struct("id", "label", "set", "bytes")).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                xs, ys = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                members = [np.frombuffer(y["set"], np.uint64) for y in ys]
                names = np.array([y["label"] for y in ys])
                rows = [np.frombuffer(b"".join(z["bytes"] for z in side), np.uint8).reshape(-1, COORDINATES) for side in (xs, ys)]
                for x, same in zip(xs, equal_bytes(*rows), strict=True):
                    own = np.frombuffer(x["set"], np.uint64)
                    near = np.flatnonzero((same >= CANDIDATE) & (names != x["label"]))
                    both = overlaps(own, [members[j] for j in near])
                    sizes = np.array([len(members[j]) for j in near], np.int64)
                    linked = near[(100 * both >= percent * (sizes + len(own) - both)) & (sizes > 0)]
                    _, once = np.unique(names[linked], return_index=True)
                    for j in linked[once]:
                        a.append(min(x["id"], ys[j]["id"]))
                        b.append(max(x["id"], ys[j]["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return scratch.table(left.join(right, ["node", "block"]).select("x", "y").mapInArrow(run, "a long, b long").distinct(), "outside-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs other than white space; a document's set is
    its distinct `width`-word shingles, or its whole word sequence if it has
    fewer words. Documents link at a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id reachable, kept says that it is the
    document's own. Null and empty texts have no shingles and link with nothing.
    Rows without a doc_id take part in nothing: their component_id is null and
    they are kept. Rows that share a doc_id are one document of the graph.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "minhash")
    signed = scratch.table(signatures(docs, width), "signatures")
    name = ["set_hi", "set_lo", "n_shingles"]
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one set, named by its smallest document
    classes = full.groupBy(*name).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("minwise").alias("minwise"), F.first("bytes").alias("bytes"))
    classes = scratch.table(classes.withColumn("n", F.col("n_shingles").cast("int")), "sets")
    signed = scratch.table(signed.select("doc_id", *name), "names")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    scratch.release("signatures")
    pairs, ended = chosen_paths(classes, scratch, percent)
    wanted = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = shingles_again(docs, wanted, width, scratch, "full-sets")
    # first each set's likeliest candidate, then whatever still crosses
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.struct("same", "a", "b").alias("p")).groupBy("id").agg(F.max("p").alias("p"))
    links = scratch.table(confirmed(ends.select("p.a", "p.b").distinct(), sets, percent), "links0")
    labels = components(links, scratch, "labels0")
    more = scratch.table(confirmed(crossing(pairs, labels), sets, percent), "links1")
    scratch.release("full-sets", "candidates")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links, scratch, "labels1")
    if not ended.isEmpty():
        last = outside_links(docs, ended, labels, classes, width, scratch, percent)
        if not last.isEmpty():
            labels = components(links.unionByName(last), scratch, "labels2")
        scratch.release("outside-sets")
    classes = scratch.table(classes.select(*name, "id", "copies"), "classes")
    scratch.release("sets")

    named = classes.select(*name, "id", "copies").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # rows that share a doc_id are one document: the classes it is in meet
    repeated = full.groupBy("doc_id").agg(F.count_distinct("set_hi", "set_lo").alias("k")).where("k > 1").select("doc_id")
    if not repeated.isEmpty():
        meets = full.join(repeated, "doc_id", "left_semi").join(named, name).select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
        own = named.select(F.col("id").alias("a"), F.col("label").alias("b"))
        joined = components(scratch.table(meets.unionByName(own), "meets"), scratch, "labels3")
        named = named.join(joined.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")
    # a set with very many copies is dealt over blocks of about 4096 of them
    parts = F.ceil(F.col("copies") / 4096).cast("int")
    spread = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(parts, F.lit(64)) - 1))).select(*name, "part", "label")
    heavy = named.where("copies > 4096").select(*name, F.least(parts, F.lit(64)).alias("parts"))
    rows = full.select("doc_id", *name)
    if heavy.isEmpty():
        placed = rows.join(named.select(*name, "label"), name)
    else:
        placed = rows.join(heavy, name, "left").withColumn("part", salt("doc_id", F.coalesce("parts", F.lit(1)))).join(spread, [*name, "part"])
    rest = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("label"))
    out = placed.select("doc_id", "n_shingles", "label").unionByName(rest)
    return out.select("doc_id", "n_shingles", F.col("label").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("label"), F.lit(True)).alias("kept"))


#: The same rows by joining shingles: every pair of distinct sets that share one is compared, and components grow by recursion.
#: Words are those of width 2 and 80 percent; A-Z alone are lower-cased.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \\t\\n\\x0B\\x0C\\r]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT id, n, unnest(s) AS g FROM classes),
shared AS (SELECT a.id AS a, b.id AS b, a.n AS n, b.n AS m, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (n + m - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, low) AS (
  SELECT id, id FROM classes UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.id WHERE r.low < e.b),
low AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.low, d.doc_id) AS component_id, coalesce(l.low, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN low l ON l.id = c.id
"""
