"""Operator 4: byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task pre-splits its texts by the pattern, keeps the distinct words it has
not met before, and gives them to DuckDB as rows (word, position, token). The
recursive query joins neighbouring tokens with the merge table, contracts each
word's leftmost pair of minimum rank and goes on until no pair merges. Decoding
joins the ids with the vocabulary and aggregates the bytes in order. Texts are
then put together from the ids and bytes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import prepare
from docloom.llm.tokenizers import public, public_pattern, ranks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Words known to a worker process, at most; beyond that the cache starts anew.
CACHE_WORDS = 600_000
#: Text bytes that are split and encoded together.
RUN_BYTES = 4 << 20
#: Bytes of new words that go to one recursive query.
QUERY_BYTES = 1 << 20
#: Longer words contract all their leftmost non-overlapping minimum-rank pairs at a time.
LONG_WORD = 256

# A pair's merge rank, position and next position share one integer: its minimum
# is the leftmost pair of the lowest rank. 17 bits of rank, 23 of each position.
_MASK = (1 << 23) - 1
_PAIRS = """
  SELECT s.w, s.pos, s.nxt_pos, m.merged FROM (
    SELECT w, pos, tok, lead(tok) OVER win AS nxt, lead(pos) OVER win AS nxt_pos
    FROM step WHERE NOT done WINDOW win AS (PARTITION BY w ORDER BY pos)) s
  JOIN merges m ON m.l = s.tok AND m.r = s.nxt"""
_SHORT = f"""
WITH RECURSIVE step(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM symbols
  UNION ALL (
  WITH best AS (
    SELECT w, min((merged::BIGINT << 46) | (pos::BIGINT << 23) | nxt_pos) AS b FROM ({_PAIRS}) GROUP BY w)
  SELECT s.w, s.pos, CASE WHEN s.pos = (b >> 23) & {_MASK} THEN (b >> 46)::INT ELSE s.tok END, b IS NULL
  FROM step s LEFT JOIN best ON best.w = s.w
  WHERE NOT s.done AND (b IS NULL OR s.pos <> (b & {_MASK}))))
SELECT w, pos, tok FROM step WHERE done ORDER BY w, pos"""
# In a run of overlapping pairs of the same rank (as in aaaa), every second one contracts.
_LONG = f"""
WITH RECURSIVE step(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM symbols
  UNION ALL (
  WITH pairs AS MATERIALIZED ({_PAIRS}),
  low AS (SELECT w, min(merged) AS merged FROM pairs GROUP BY w),
  runs AS (
    SELECT p.*, sum(CASE WHEN before = p.pos THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY pos) AS run FROM (
      SELECT p.w, p.pos, p.nxt_pos, p.merged, lag(p.nxt_pos) OVER (PARTITION BY p.w ORDER BY p.pos) AS before
      FROM pairs p JOIN low ON low.w = p.w AND low.merged = p.merged) p),
  hits AS MATERIALIZED (
    SELECT w, pos, nxt_pos, merged FROM (
      SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1)
  SELECT s.w, s.pos, coalesce(h.merged, s.tok), low.w IS NULL
  FROM step s
  LEFT JOIN low ON low.w = s.w
  LEFT JOIN hits h ON h.w = s.w AND h.pos = s.pos
  LEFT JOIN hits g ON g.w = s.w AND g.nxt_pos = s.pos
  WHERE NOT s.done AND g.w IS NULL))
SELECT w, pos, tok FROM step WHERE done ORDER BY w, pos"""
_DECODE = """
SELECT i.w AS w, string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM ids i JOIN vocabulary v ON v.id = i.tok GROUP BY i.w ORDER BY i.w"""


def merge_table(vocabulary: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: l, r, merged (that token's id, its rank)."""
    left, right, merged = [], [], []
    for token, rank in vocabulary.items():
        for k in range(1, len(token)):
            a, b = vocabulary.get(token[:k]), vocabulary.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return pa.table({n: pa.array(x, pa.int32()) for n, x in (("l", left), ("r", right), ("merged", merged))})


class Codec:
    """One worker's DuckDB connection and the words it knows."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        vocabulary = ranks(path)
        self.byte_ids = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        # regex's \s also takes the controls 0x1C-0x1F, which the property leaves out
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("merge_rows", merge_table(vocabulary))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.unregister("merge_rows")
        self.con.register("vocabulary_rows", pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "hex": [t.hex() for t in vocabulary]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.con.unregister("vocabulary_rows")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _query(self, words: list[bytes], sql: str) -> list[tuple[bytes, bytes]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self.con.register("symbols", pa.table({"w": w, "pos": pos, "tok": tok}))
        ids = self.con.sql(sql).to_arrow_table()
        self.con.unregister("symbols")
        self.con.register("ids", ids)
        decoded = self.con.sql(_DECODE).to_arrow_table().column("hex").to_pylist()
        self.con.unregister("ids")
        flat = ids.column("tok").to_numpy().astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(ids.column("w").to_numpy(), minlength=len(words))) * 4
        return [(flat[a:b], bytes.fromhex(h)) for a, b, h in zip([0, *ends[:-1]], ends, decoded, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Encode and decode words that are not known yet."""
        for long in (False, True):
            todo: list[str] = []
            size = 0
            for word in [*words, None]:
                raw = word.encode() if word is not None else b""
                if word is not None and (len(raw) > LONG_WORD) != long:
                    continue
                if todo and (word is None or size + len(raw) > QUERY_BYTES):
                    found = self._query([x.encode() for x in todo], _LONG if long else _SHORT)
                    self.known.update(zip(todo, found, strict=True))
                    todo, size = [], 0
                if word is not None:
                    todo.append(word)
                    size += len(raw)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded bytes) of each text."""
        split = [self.split(t) for t in texts]
        needed = set().union(*split) if split else set()
        if len(self.known) + len(needed) > CACHE_WORDS:
            new = needed.difference(self.known)
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
        self.learn([w for w in needed if w not in self.known])
        known = self.known
        out = []
        for words in split:
            found = [known[w] for w in words]
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with `keep` also ids (array) and decoded (binary).

    Null and empty texts have no ids. Rows are independent: repeated rows and
    null doc_ids give rows of their own; other columns are ignored; an empty
    table gives no rows. A text is never cut, however long.
    """
    prepare(docs.sparkSession)
    path = path or public("byte_bpe_multi_50k.tiktoken")
    pattern = pattern or public_pattern()
    schema = SCHEMA + (", ids array<long>, decoded binary" if keep else "")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in runs of about RUN_BYTES: a query for each small one would cost more than its words."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= RUN_BYTES:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in together(batches):
            coded = c.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in coded], pa.string()),
            }
            if keep:
                columns["ids"] = pa.array([np.frombuffer(i, "<u4").astype("int64") for i, _ in coded], pa.list_(pa.int64()))
                columns["decoded"] = pa.array([d for _, d in coded], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
