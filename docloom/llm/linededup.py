"""Operator 5: line dedup by a suffix array over line-ID sequences.

Every document is the sequence of its lines' IDs. Prefix doubling ranks the
suffixes: the rank for depth 2h of a position is the rank of the pair (its rank
for depth h, the rank for depth h of the position h lines on). Suffixes of equal
rank for depth h are one interval of the suffix array whose longest common
prefix is at least h lines. A suffix that shares its prefix with no other is in
its final place and takes no further part, so the work shrinks with each doubling
to what really repeats; it ends when every suffix is told apart.

On the way back from the deepest ranks to depth 1 the intervals are split to
their exact longest common prefixes: the members of an interval of length l
that agree in the rank of the next h lines are an interval of length l + h below
it. Of that, the first member in (doc_id, line) order also stays in the upper
interval, for all of its members share the same with those outside; the others
leave it. In the end every suffix that is not the first of its interval is a
later copy of a maximal repeated run of l lines, and goes, if the run holds at
least `min_words` words.

Only line IDs and positions move; the texts are read twice and joined once with
the deletions of their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, prepare, quoted, split_by_filter, trim, unused

MIN_WORDS = 10
_SPACE = b" \t\n\x0b\x0c\r"
_LINES = "doc_id long, text_id long, pos int, hi long, lo long, least int"
KEY = ["doc_id", "text_id"]


def shortest_runs(words: np.ndarray, least: int) -> np.ndarray:
    """For each line, how many lines from it on hold `least` words; 0 if the document ends before."""
    total = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(total, total[:-1] + least)
    return np.where(stop <= len(words), np.maximum(stop - np.arange(len(words)), 1), 0).astype(np.int32)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line: its document, position, 128-bit ID and shortest run of `min_words` words. Nulls and empty texts have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            owners = []
            for k, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                lines = text.split(b"\n")
                ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), "<i8").reshape(-1, 2)
                least = shortest_runs(np.array([len(x.split(None)) for x in lines]), min_words)
                for p, v in zip(parts, (np.arange(len(lines), dtype=np.int32), ids[:, 0], ids[:, 1], least), strict=True):
                    p.append(v)
                owners.append(np.full(len(lines), k))
            if owners:
                at = pa.array(np.concatenate(owners))
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(p)) for p in parts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "pos", "hi", "lo", "least"])
        trim()

    return docs.mapInArrow(run, _LINES)


def ranked(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """`rows` whose `by` occurs at least twice, with its rank: ordered like `by`, equal where `by` is equal.

    Ranks come from a range partitioning of the distinct repeated keys alone:
    the partition's number, then the place in it.
    """
    repeated = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by)
    order = repeated.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_rank", F.monotonically_increasing_id())
    order = scratch.table(order, f"{name}-order")
    # one row a key: a key that holds a large part of the rows is split by the adaptive join
    return rows.join(order, by).drop(*by).withColumnRenamed("_rank", "rank")


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For k = 0, 1, ...: document, pos, least and rank of every suffix that shares its first 2**k lines with another one."""
    level = scratch.table(ranked(lines, ["hi", "lo"], scratch, "rank0"), "rank0")
    levels: list[DataFrame] = []
    while not level.isEmpty():
        k = len(levels)
        levels.append(level)
        ahead = level.select(*KEY, (F.col("pos") - 2**k).alias("pos"), F.col("rank").alias("next"))
        pairs = level.join(ahead, [*KEY, "pos"])
        level = scratch.table(ranked(pairs, ["rank", "next"], scratch, f"rank{k + 1}"), f"rank{k + 1}")
    return levels


def lcp_intervals(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """node, n_lines (the longest common prefix of its members), document, pos, least and later (false for a node's first member).

    A suffix is in one node as a later member at most, and may be the first one of
    several nested nodes. Suffixes whose repeated prefix is shorter than `least`
    lines are left out, as far as the depth of a level shows it.
    """
    here = ["node", "n_lines", *KEY, "pos", "least", "later"]
    place = F.struct(*KEY, "pos")
    nodes: DataFrame | None = None
    moved: DataFrame | None = None  # suffixes that are no longer in the root, where all begin
    for j in range(len(levels) - 1, -1, -1):
        ranks = levels[j]
        root = ranks.where((F.col("least") > 0) & (F.floor(F.log2(F.col("least") + F.lit(0.5))) <= j))
        if moved is not None:
            root = root.join(moved, [*KEY, "pos"], "left_anti")
        at = root.select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("n_lines"), *KEY, "pos", "least", F.lit(False).alias("later"), "rank")
        if nodes is not None:
            ahead = nodes.withColumn("at", F.col("pos") + F.col("n_lines"))
            next_ = ranks.select(*KEY, F.col("pos").alias("at"), "rank")
            at = at.unionByName(ahead.join(next_, [*KEY, "at"], "left").drop("at"))
        at = scratch.table(at, f"at{j}")
        found = at.where("rank IS NOT NULL")
        groups = found.groupBy("node", "rank").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found = found.join(groups, ["node", "rank"], "left").withColumn("goes", place != F.col("first"))
        # in the new interval: all of a group; in the old one: all but those that go on
        below = F.struct(F.xxhash64("node", "rank", F.lit(j)).alias("node"), (F.col("n_lines") + 2**j).alias("n_lines"), F.col("goes").alias("later"))
        stays = F.struct("node", "n_lines", "later")
        both = F.when(F.col("goes").isNull(), F.array(stays)).when(F.col("goes"), F.array(below)).otherwise(F.array(stays, below))
        found = found.select(*KEY, "pos", "least", F.explode(both).alias("x")).select(*KEY, "pos", "least", "x.*")
        stay = at.where("rank IS NULL").select(*here)
        out = scratch.table(found.where("node <> 0").select(*here).unionByName(stay), f"nodes{j}")
        nodes = out
        # no suffix comes back to the root: those that have left it are later members now
        moved = nodes.where("later").select(*KEY, "pos")
        scratch.drop(f"at{j}", f"nodes{j + 1}")
    return nodes


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """The later copies of maximal repeated passages: doc_id, text_id, pos (first line), n_lines."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    # rows that agree in doc_id and text are one document here
    lines = line_table(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_id"), "text"), min_words)
    lines = scratch.table(lines.dropDuplicates([*KEY, "pos"]), "lines")
    levels = suffix_ranks(lines, scratch)
    if not levels:
        return lines.select(*KEY, "pos", F.col("least").alias("n_lines")).limit(0)
    return lcp_intervals(levels, scratch).where("later AND n_lines >= least").select(*KEY, "pos", "n_lines")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies of repeated passages deleted, and n_lines, n_deleted.

    docs has doc_id and text. A passage is a run of lines of one document with at
    least `min_words` words; its first occurrence in (doc_id, line) order stays,
    all later ones are deleted, in the same document too. Lines end at a newline;
    shorter repeated lines stay unless they lie in a repeated passage. Rows that
    agree in doc_id and text count as one document and come out alike; rows that
    share a doc_id alone are different documents. Null doc_ids come first. Null
    and empty texts are left as they are, with no lines. Other columns pass
    unchanged; n_lines and n_deleted replace columns of those names.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lines")
    # a null doc_id has a key of its own, before all others
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), "text").where("text <> ''")
    runs = repeated_runs(keyed, min_words, scratch)
    cuts = runs.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "n_lines")).alias("cuts"))  # at most one a line of one document
    cuts = scratch.table(cuts, "cuts")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    own = quoted(names)
    doc, text_id, runs_of, new = unused(names, "in_doc", "text_id", "cuts", "rest")
    rows = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), least).alias(doc), F.xxhash64("text").alias(text_id))
    # only documents that a filter of fixed size lets through are shuffled to their deletions
    quiet, touched = split_by_filter(rows, cuts.select(F.xxhash64(*KEY).alias("k")), F.xxhash64(doc, text_id), "k")
    n_lines = F.when(F.col("text") != "", F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    quiet = quiet.select(*own, n_lines.cast("int").alias("n_lines"), F.lit(0).alias("n_deleted"))
    touched = touched.join(cuts.toDF(doc, text_id, runs_of), [doc, text_id], "left")
    touched = touched.withColumn(new, F.arrow_udf(without, "text string, n_lines int, n_deleted int")("text", runs_of))
    rest = [F.col(f"{new}.text").alias(c) if c.lower() == "text" else F.col(q) for c, q in zip(names, own, strict=True)]
    touched = touched.select(*rest, F.col(f"{new}.n_lines").alias("n_lines"), F.col(f"{new}.n_deleted").alias("n_deleted"))
    return quiet.unionByName(touched)


def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """The text without its cut runs of lines, how many lines it had, how many went."""
    texts, n_lines, n_deleted = [], [], []
    for t, c in zip(text.to_pylist(), cuts, strict=True):
        lines = t.split("\n") if t else []
        gone = np.zeros(len(lines) + 1, np.int64)
        runs = c.values if c.is_valid else None
        if runs is not None and len(runs):
            start = runs.field("pos").to_numpy().astype(np.int64)
            np.add.at(gone, start, 1)
            np.add.at(gone, start + runs.field("n_lines").to_numpy(), -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_lines.append(len(lines))
        n_deleted.append(int(gone.sum()))
        texts.append(t if not n_deleted[-1] else "\n".join([x for x, g in zip(lines, gone, strict=True) if not g]))
    arrays = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_deleted, pa.int32())]
    return pa.StructArray.from_arrays(arrays, ["text", "n_lines", "n_deleted"])


#: The same rows by brute force over pairs of equal lines: for small tables.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text <> ''),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d),
counted AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\x0C\\r]+'), lambda w: w <> '')) AS words,
    row_number() OVER (ORDER BY doc_id, text, pos) + dense_rank() OVER (ORDER BY doc_id, text) AS spot FROM lines),
pairs AS (SELECT p.doc_id, p.text, p.pos, p.spot, p.spot - q.spot AS shift, p.words FROM counted p JOIN counted q ON p.line = q.line AND q.spot < p.spot),
runs AS (SELECT *, spot - row_number() OVER (PARTITION BY shift ORDER BY spot) AS run FROM pairs),
long AS (SELECT shift, run FROM runs GROUP BY shift, run HAVING sum(words) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, text, pos FROM runs JOIN long USING (shift, run)),
kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_deleted,
    string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS rest
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.text = l.text AND g.pos = l.pos GROUP BY l.doc_id, l.text)
SELECT x.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted,
  CASE WHEN k.doc_id IS NULL THEN x.text ELSE coalesce(k.rest, '') END AS text
FROM documents x LEFT JOIN kept k ON k.doc_id = x.doc_id AND k.text = x.text
"""
