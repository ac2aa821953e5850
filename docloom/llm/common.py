"""What the operators share: scratch tables, batch sizes, hashing kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold: long texts must not pile up in a worker.
BATCH_ROWS, BATCH_BYTES = "256", "4194304"
#: Text bytes that a numpy kernel takes at a time.
KERNEL_BYTES = 1 << 19


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; the core's parsers set the same bounds, so the order of calls is of no matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


# ------------------------------------------------------------------ scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, where that is unset, gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Scratch folders that are still there; they go when the driver ends.
_ROOTS: set[str] = set()


@atexit.register
def _delete_roots() -> None:
    spark = SparkSession.getActiveSession()
    for root in _ROOTS if spark else ():
        try:
            delete_path(spark, root)
        except Exception:  # the session may be gone by then
            return


def trim_driver(spark: SparkSession) -> None:
    """Let the driver's JVM give freed native memory back: its compiler leaves much of it. A JVM without that command is left alone."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:
        # the server's class is not public, its interface is
        types = [jvm.java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *types))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        empty = array(jvm.java.lang.Object), array(jvm.java.lang.String)
        invoke.invoke(server, array(jvm.java.lang.Object, name, "systemTrimNativeHeap", *empty))
    except Py4JError:
        return


def shrink_driver(spark: SparkSession) -> None:
    """Where the driver's heap has grown beyond half of its limit, collect it: it shrinks, and Spark removes broadcasts and shuffles that nothing refers to."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


class Scratch:
    """Written tables that cut lineage: each survives the loss of any executor.

    `table` writes and rereads; `drop` removes one as soon as nothing reads it.
    What a returned DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        self.kept: set[str] = set()
        _ROOTS.add(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.kept.add(name)
        shrink_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.kept:
                delete_path(self.spark, f"{self.root}/{n}")
                self.kept.discard(n)

    def release(self, *names: str) -> None:
        """Drop, and let Spark remove the shuffle files of plans that nothing refers to any more."""
        self.drop(*names)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def lang_of(docs: DataFrame) -> Column:
    """The language column; null where the table has none."""
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def sub_batches(sizes: np.ndarray, limit: int = KERNEL_BYTES):
    """(start, stop) runs of rows whose sizes sum to at most `limit`; a larger row stands alone."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield start, len(sizes)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The column's texts as bytes; null becomes empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def unused(taken: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column of `taken` has (Spark compares names without case)."""
    seen, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        out.append(n)
    return out


def quoted(columns: list[str]) -> list[str]:
    """Column names as Spark reads them back, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


# ------------------------------------------------------------------ a bitmap of wanted ids

#: Bits for each id, and of the whole bitmap at least and at most (2**28 bits are 32 MB, broadcast once).
ID_BITS, LEAST_BITS, MOST_BITS = 16, 16, 28
#: 32-bit words in one row of the bitmap's table.
BLOCK_WORDS = 2048


def filter_place(c: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - bits)


class IdFilter:
    """A bitmap that holds every id of a written table, and others by chance: it spares a shuffle most of what a join drops.

    Its size follows the number of ids. Beyond 2**MOST_BITS bits it fills up and
    lets more rows through, which the join behind it then drops.
    """

    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, (ID_BITS * n).bit_length()))
        words = ids.select(filter_place(column, self.bits).alias("p")).select(
            F.shiftright("p", 5).alias("w"), F.expr("shiftleft(1, cast(p & 31L as int))").alias("b")
        )
        every = ids.sparkSession.range(1 << (self.bits - 5)).select(F.col("id").alias("w"), F.lit(0).alias("b"))
        words = words.unionByName(every).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
        blocks = words.groupBy((F.col("w") / BLOCK_WORDS).cast("long").alias("block"))
        #: block and its BLOCK_WORDS words in order: 2**(bits - 5) words in all
        self.table = blocks.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x")).select("block", F.col("x.b").alias("words"))

    def place(self, c: str) -> Column:
        return filter_place(c, self.bits)

    @contextmanager
    def shared(self):
        """The bitmap as a broadcast numpy array, destroyed at the end: what reads it must be written by then."""
        got = self.table.orderBy("block").toArrow().column("words")
        words = np.concatenate([c.flatten().to_numpy() for c in got.chunks]).view(np.uint32)
        out = self.table.sparkSession.sparkContext.broadcast(words)
        del got, words
        try:
            yield out
        finally:
            out.destroy()


def in_filter(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[places >> 5] >> (places & 31).astype(np.uint32) & 1)


def split_by_filter(docs: DataFrame, ids: DataFrame, key: Column, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly not in the written table `ids`, the other rows), both as `docs`; nothing is shuffled."""
    found = IdFilter(ids, column)
    own = quoted(docs.columns)
    k, p, at, words = unused(docs.columns, "key", "place", "block", "words")
    rows = docs.select(*own, key.alias(k)).select(*own, found.place(k).alias(p))
    rows = rows.withColumn(at, F.shiftright(p, 5 + BLOCK_WORDS.bit_length() - 1))
    # the bitmap: at most 2**MOST_BITS bits
    rows = rows.join(F.broadcast(found.table.withColumnsRenamed({"block": at, "words": words})), at, "left")
    word = F.get(words, (F.shiftright(p, 5) % BLOCK_WORDS).cast("int"))
    rows = rows.withColumn(words, word.cast("long")).withColumn(words, F.expr(f"shiftright({words}, cast({p} & 31L as int)) & 1L = 1L"))
    return rows.where(~F.col(words)).select(*own), rows.where(F.col(words)).select(*own)


def without_rows(docs: DataFrame, bad: DataFrame, scratch: Scratch, **keys: Column) -> DataFrame:
    """`docs` without the rows whose keys are a row of `bad` (columns named like `keys`, not null); only suspects are shuffled."""
    names = list(keys)
    bad = scratch.table(bad.select(*names).distinct(), "gone")
    clear, suspects = split_by_filter(docs, bad.select(F.xxhash64(*names).alias("k")), F.xxhash64(*keys.values()), "k")
    own, fresh = quoted(docs.columns), unused(docs.columns, *names)
    marked = suspects.select(*own, *[c.alias(n) for c, n in zip(keys.values(), fresh, strict=True)])
    marked = marked.join(bad.toDF(*fresh), fresh, "left_anti")
    return clear.unionByName(marked.select(*own))


# ------------------------------------------------------------------ hashing

_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: A-Z to a-z; all other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << math.ceil(math.log2(n))
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _R_INV)):
                steps = np.full(size, r, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def words_of(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash of each word, its text's index, first word of each text and the end, hash of each prefix).

    Words are the runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased.
    A word's hash is a polynomial in its bytes modulo 2**64, mixed. For each of
    `prefixes` follow the hashes of the words' first so many bytes, 0 where a
    word is no longer than that.
    """
    joined = b"\n".join(texts).translate(LOWER)
    buf = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends_of_text = np.cumsum(sizes)
    if not len(buf):
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes))
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * power[: len(buf)], dtype=np.uint64)))
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        parts = []
        for n in prefixes:
            stop = np.minimum(starts + n, ends)
            parts.append(np.where(stop < ends, mix((sums[stop] - sums[starts]) * inverse[starts] + np.uint64(n << 32)), np.uint64(0)))
    owner = np.searchsorted(ends_of_text, starts, side="right")
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return hashes, owner, first, *parts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, where each text's begin, and the end).

    A text with fewer words than `width` has its whole word sequence as its one
    shingle; a text without words has none.
    """
    hashes, owner, first = words_of(texts)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        if len(hashes):
            grams = np.zeros(len(hashes), np.uint64)
            for k in range(width):
                ahead = np.zeros(len(hashes), np.uint64)
                ahead[: len(hashes) - k] = hashes[k:]
                index = np.arange(len(hashes)) + k
                valid = index < first[owner + 1]
                grams = np.where(valid, mix(grams * np.uint64(0xD6E8FEB86659FD93) + ahead + np.uint64(1)), grams)
            at = np.arange(len(hashes)) - first[owner]
            keep = at <= np.maximum(counts[owner] - width, 0)
            grams, owner = grams[keep], owner[keep]
        else:
            grams = hashes
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        fresh = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
        grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(texts) + 1))
