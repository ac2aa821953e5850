"""Connected components by hooking and pointer jumping, without collecting links or labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

#: Links that one task contracts at a time: a bound on its memory, whatever the input.
PART_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes that are not the smallest."""
    ids, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    parent = np.arange(len(ids))
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]]


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, each partition's reduced to stars in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate((a, batch.column(0).to_numpy()))
            b = np.concatenate((b, batch.column(1).to_numpy()))
            if len(a) > 2 * PART_LINKS:
                a, b = forest(a, b)
                if len(a) > PART_LINKS:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id and label, the smallest id reachable, of the nodes of links (a, b) that are not the smallest themselves.

    Partitions contract what they hold to stars; while more links are left than
    one task may hold, hooking and pointer jumping go on over the cluster.
    """
    links = scratch.table(contract(links.where("a <> b").select("a", "b")), f"{name}-links")
    n = links.count()
    if n <= PART_LINKS:
        return scratch.table(contract(links.coalesce(1)).select(F.col("a").alias("id"), F.col("b").alias("label")), name)
    both = scratch.table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = scratch.table(jumped, f"{name}-{turn}")
        changed = not new.where("label <> old").isEmpty()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("id", "label")
        if not changed:
            scratch.drop(f"{name}-both", f"{name}-links")
            return labels.where("id <> label")
