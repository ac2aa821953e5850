"""Operator 7: consistent-hash ring with virtual nodes and bounded loads.

Every document has a place on a ring, every shard `vnodes` of them. A document
goes to the first virtual node clockwise whose shard still has room; with the
capacities set to the even split of the rows, counts end at most one apart,
and only documents whose own shard is full move on.

The ring is cut into a fixed number of slots. One narrow aggregation counts
the documents of each slot, the ring walk runs over those counts alone (a table
whose size is bounded by `slots`, whatever the input), and each document finds
its shard by its rank within its slot. Rows that agree in doc_id and text are
ranked together, as one row with a count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_BITS = 14
#: Copies of one row that are told apart at a time.
RUN = 4096


def ring(n_shards: int, vnodes: int, slots: int) -> list[np.ndarray]:
    """For each slot, the shards in the order in which a clockwise walk first meets them."""
    places = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") * slots >> 64, s, v)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    at = np.array([p for p, _, _ in places])
    owners = [s for _, s, _ in places]
    orders: dict[int, np.ndarray] = {}
    out = []
    for slot in range(slots):
        first = int(np.searchsorted(at, slot)) % len(owners)
        if first not in orders:
            walk = owners[first:] + owners[:first]
            orders[first] = np.array(list(dict.fromkeys(walk)))
        out.append(orders[first])
    return out


def walk(counts: dict[int, int], n_shards: int, vnodes: int, slots: int, slack: float) -> pd.DataFrame:
    """Which ranks of each slot go to which shard: slot, shard, lo, hi, base (the shard's rows before lo)."""
    total = sum(counts.values())
    if slack:
        room = [int(np.ceil((1 + slack) * total / n_shards))] * n_shards
    else:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    orders = ring(n_shards, vnodes, slots)
    used, taken, rows = [0] * n_shards, dict.fromkeys(counts, 0), []
    for step in range(n_shards):
        for slot in sorted(counts):
            shard = int(orders[slot][step])
            n = min(counts[slot] - taken[slot], room[shard] - used[shard])
            if n > 0:
                rows.append((slot, shard, taken[slot], taken[slot] + n, used[shard]))
                taken[slot] += n
                used[shard] += n
    return pd.DataFrame(rows, columns=["ring_slot", "shard", "lo", "hi", "base"])


def assign_shards(docs: DataFrame, n_shards: int = 8, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs` (doc_id, text).

    `slack` 0 fills the shards exactly evenly; a larger one is the usual bounded
    load of (1 + slack) times the mean, which moves fewer documents on.
    A null text counts as empty. Null doc_ids are placed by their text; repeated
    rows are placed one by one. An empty table gives no rows. Other columns of
    `docs` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("ring_key", F.xxhash64("doc_id", "text_crc32", "size"))
    base = base.withColumn("ring_slot", F.shiftrightunsigned("ring_key", 64 - SLOT_BITS).cast("int"))
    row = ["ring_slot", "ring_key", "doc_id", "size", "text_crc32"]
    # equal rows are one with a count, combined where they are read, so that no repeated row fills a slot
    rows = base.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["ring_slot"]: r["n"] for r in rows.groupBy("ring_slot").agg(F.sum("n").alias("n")).collect()}  # at most 2**SLOT_BITS rows
    plan = walk(counts, n_shards, vnodes, 1 << SLOT_BITS, slack)
    schema = "ring_slot int, shard int, lo long, hi long, base long"
    plan_df = spark.createDataFrame(plan.astype({"shard": "int32", "ring_slot": "int32"}), schema) if len(plan) else spark.createDataFrame([], schema)
    order = Window.partitionBy("ring_slot").orderBy("ring_key", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("to", F.sum("n").over(order)).withColumn("at", F.col("to") - F.col("n"))
    # bounded: at most n_shards rows for each of the fixed number of slots
    placed = ranked.join(F.broadcast(plan_df), "ring_slot").where("to > lo AND at < hi")
    placed = placed.select(*row[2:], "shard", F.greatest("at", "lo").alias("a"), F.least("to", "hi").alias("b"), (F.col("base") - F.col("lo")).alias("by"))
    # the copies of a row come in runs of bounded length
    runs = placed.withColumn("a", F.explode(F.sequence("a", F.col("b") - 1, F.lit(RUN).cast("long")))).withColumn("b", F.least("b", F.col("a") + RUN))
    each = runs.withColumn("at", F.explode(F.sequence("a", F.col("b") - 1)))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("by")).alias("slot"))
