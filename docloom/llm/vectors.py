"""What the two vector searches share: checked vectors, packed blocks, and searches of query blocks in vector blocks.

Vectors that belong together (a bucket, a subtree) are packed into blocks of a
bounded number of rows; queries that visit the same group are packed too. A
search joins query blocks with vector blocks, so one group that holds a large
part of the table is many blocks, dealt over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors, and queries, in one block at most (on average, by hash).
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def usable(rows: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and v (array<double>) of the rows whose vectors are not null, nor empty, nor hold null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def groups_of_width(column: pa.Array):
    """(width, rows) for each vector length in a batch: only vectors of one length are comparable."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        yield int(w), np.flatnonzero(widths == w)


def salted(rows: DataFrame, group: list[str], size: int, key: Column) -> DataFrame:
    """`rows` with `block`: each group dealt by `key` over as many blocks as its count asks for.

    The counts are broadcast, a row for each group (callers bound the groups), so
    that a group is never gathered on its way to its blocks.
    """
    counts = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("blocks"))
    return rows.join(F.broadcast(counts), group).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")


def pack(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for each block, with the rows' columns as lists of equal order."""
    packed = rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return packed.select(*by, *[F.col("_rows")[c].alias(c) for c in columns])


def best_of(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k of each query's distinct candidates, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_copies(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the rows without repeated ones: equal id, equal vector."""
    order = np.lexsort((*v.T[::-1], ids))
    same = (ids[order][1:] == ids[order][:-1]) & (v[order][1:] == v[order][:-1]).all(1)
    return np.sort(order[np.concatenate(([True], ~same))]) if len(ids) else order


def smallest(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest of `values`, ties to the smaller id, ascending."""
    if len(values) > k:
        cut = np.partition(values, k - 1)[k - 1]
        near = np.flatnonzero(values <= cut)
    else:
        near = np.arange(len(values))
    return near[np.lexsort((ids[near], values[near]))][:k]
