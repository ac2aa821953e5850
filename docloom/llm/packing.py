"""Operator 2: cost-balanced packing.

Each document's ids, with the end id, are cut into full pieces of the sequence
length, which fill a sequence each, and a tail. The tails of a run of documents
share sequences: in descending order of their estimated attention cost (linear
plus quadratic in the length) each goes to the sequence of lowest cost that
still has room. A tail that fits nowhere is cut over the room that is left, so
a run fills its sequences to the last id; what cannot fill one more sequence
goes to sequences whose lengths are powers of two, which need no padding.

A run is at most `run_docs` documents of one input partition, packed in the
task that encodes them: nothing is shuffled, and memory is bounded by the run.
The sequence of lowest cost with room is found in a tree over the room that is
left, without a limit on the search.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import prepare
from docloom.llm.tokenizers import encode, public, public_pattern

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def cost(length: int, linear: float, quadratic: float) -> float:
    """Estimated cost of attending within a piece: the projections are linear in its length, the scores quadratic."""
    return linear * length + quadratic * length * length


def powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1 / 512) -> list[Piece]:
    """Pieces of documents of these lengths; sequences are numbered from 0 without gaps."""
    pieces: list[Piece] = []
    n_sequences = 0
    tails = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            pieces.append((doc, start, size, n_sequences, 0))
            n_sequences += 1
        if n % size:
            tails.append((n % size, doc, n - n % size))
    total = sum(t[0] for t in tails)
    room = [size] * (total // size) + powers(total % size)
    used, costs = [0] * len(room), [0.0] * len(room)
    tails.sort(key=lambda t: (-cost(t[0], linear, quadratic), t[1]))
    open_ = ByRoom(room, size)
    left = []
    for length, doc, start in tails:
        s = open_.cheapest(length)
        if s < 0:
            left.append((length, doc, start))
            continue
        pieces.append((doc, start, length, n_sequences + s, used[s]))
        used[s] += length
        costs[s] += cost(length, linear, quadratic)
        open_.put(room[s] - used[s], costs[s], s)
    rest = sorted((s for s in range(len(room)) if used[s] < room[s]), key=lambda s: (costs[s], s))
    k = 0
    for length, doc, start in left:
        while length:
            s = rest[k]
            n = min(length, room[s] - used[s])
            pieces.append((doc, start, n, n_sequences + s, used[s]))
            used[s] += n
            start, length = start + n, length - n
            k += used[s] == room[s]
    return pieces


class ByRoom:
    """Sequences by the room that is left in them: a heap of (cost, sequence, room) for each room, and a tree of the heaps' least entries."""

    NONE = (float("inf"), -1, -1)

    def __init__(self, room: list[int], size: int):
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(size + 1)]
        for s, r in enumerate(room):
            self.heaps[r].append((0.0, s, r))  # ascending, so a heap
        self.leaves = 1 << size.bit_length()
        self.least = [self.NONE] * (2 * self.leaves)
        for r, h in enumerate(self.heaps):
            if h:
                self._update(r)

    def _update(self, r: int) -> None:
        least, k = self.least, self.leaves + r
        least[k] = self.heaps[r][0] if self.heaps[r] else self.NONE
        while k > 1:
            k >>= 1
            least[k] = min(least[2 * k], least[2 * k + 1])

    def cheapest(self, length: int) -> int:
        """Take out the sequence of lowest cost, then lowest number, among those with room for `length`; -1 if none has."""
        k = self.leaves + length
        best = self.least[k]
        while k > 1:
            if not k & 1:
                best = min(best, self.least[k + 1])
            k >>= 1
        if best[1] < 0:
            return -1
        heapq.heappop(self.heaps[best[2]])  # the least of its heap, as it is the least of several
        self._update(best[2])
        return best[1]

    def put(self, room: int, cost: float, s: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, s, room))
            self._update(room)


def pack_documents(
    docs: DataFrame,
    size: int = 1024,
    end_id: int = 0,
    json_path: str | None = None,
    rank_path: str | None = None,
    pattern: str | None = None,
    run_docs: int = 4096,
    run_tokens: int = 4 << 20,
) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text).

    Null and empty texts are the end id alone. Repeated rows are packed one by
    one, null doc_ids are kept, other columns are ignored, an empty table gives
    no rows. A run closes at `run_docs` documents or `run_tokens` ids, whichever
    comes first; the bounds only say how many documents share sequences.
    Sequence ids are unique: the input partition's number, then a count.
    """
    prepare(docs.sparkSession)
    json_path = json_path or public("byte_bpe_50k.json")
    rank_path = rank_path or public("byte_bpe_50k.tiktoken")
    pattern = pattern or public_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        next_sequence = 0
        ids_of: list[int | None] = []
        arrays: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            lengths = [len(a) for a in arrays]
            rows = pack(lengths, size)
            out = {
                "doc_id": pa.array([ids_of[d] for d, *_ in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(arrays[d][s : s + n]) for d, s, n, _, _ in rows], pa.int64()),
                "doc_tokens": pa.array([lengths[d] for d, *_ in rows], pa.int64()),
                "sequence_id": pa.array([base + next_sequence + r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
            next_sequence += max((r[3] for r in rows), default=-1) + 1
            ids_of.clear()
            arrays.clear()
            return pa.RecordBatch.from_pydict(out)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_of.append(doc_id)
                arrays.append(np.array([*encode(text or "", json_path, rank_path, pattern), end_id], "<u4"))
                held += len(arrays[-1])
                if len(arrays) >= run_docs or held >= run_tokens:
                    yield flush()
                    held = 0
        if arrays:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
