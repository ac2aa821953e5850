"""Operator 6: quality by an interpolated modified Kneser-Ney model of trusted text.

The model's units are bytes, its order is 5: junk of any script shows in the
byte sequence, and one model serves all languages. Counting, continuation
counts, discounts and back-off weights are aggregations and joins of count
tables that are dealt (sharded) by n-gram; nothing of the model is broadcast.

Scoring deals the distinct texts to buckets of a bounded number of bytes; repeated
texts meet before that, in a combining aggregation. A bucket asks the model's
shards for its distinct n-grams only, all orders at once, and puts each text's
perplexity together from the answers. Requests and shards meet in turns of a
bounded size, for each of which the shards are sent once. A language's
threshold is a quantile of the perplexities of trusted documents that the model
has not seen; documents above it are rejected. A language with few of them adds
its other trusted documents, each scored by a model of the same size without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import KERNEL_BYTES, IdFilter, Scratch, in_filter, lang_of, prepare, split_by_filter, sub_batches, trim, utf8, without_rows

ORDER = 5
PAD = b"\n" * (ORDER - 1)
#: Folds of the trusted documents; the first only calibrates.
HELD_OUT = 5
QUANTILE = 0.99
#: Text bytes in a bucket of documents, and n-grams in a shard of the model, on average.
BUCKET_BYTES, SHARD_ROWS = 8 << 20, 150_000
#: Counts that a task holds before it passes them on.
HELD_ROWS = 500_000
#: Shards at most (a bucket's request to one should be worth a row), and buckets whose requests visit a shard together, at least.
MOST_SHARDS, TOGETHER = 400, 32
#: Text bytes that a turn has at least for each byte of the model, which is sent once a turn.
MODEL_SHARE, MODEL_ROW = 16, 24
#: A language with fewer held-out trusted rows calibrates on all its trusted documents, out of fold.
LEAST = 30


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER-gram that ends at each byte, as an integer; where each text's begin, and the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(PAD.join([b"", *texts]), np.uint8).astype(np.uint64)
    codes = np.zeros(max(0, len(buf) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        codes = (codes << np.uint64(8)) | buf[k : k + len(codes)]
    # a window belongs to the text of its last byte; windows that end in a padding go
    at = np.arange(int(first[-1])) + np.repeat(np.arange(len(texts)) * len(PAD), sizes)
    return codes[at], first


def lower(codes: np.ndarray, n: int) -> np.ndarray:
    """The distinct (n-1)-grams that n-grams begin and end with."""
    return np.unique(np.concatenate((codes >> np.uint64(8), codes & np.uint64((1 << 8 * (n - 1)) - 1))))


def tagged(codes: np.ndarray, n: int) -> np.ndarray:
    """n-grams of all orders as keys of one space."""
    return codes | np.uint64(n << 8 * ORDER)


def count_table(docs: DataFrame) -> DataFrame:
    """x (ORDER-gram) and c (occurrences) over the whole texts of `docs` (one binary column of compressed texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        x, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(c)], ["x", "c"])

        for batch in batches:
            texts = [d.decompress(b) for b in batch.column(0).to_pylist()]
            for a, b in sub_batches(np.array([len(t) for t in texts])):
                new, n = np.unique(ngrams(texts[a:b])[0], return_counts=True)
                x, at = np.unique(np.concatenate((x, new)), return_inverse=True)
                c = np.bincount(at, np.concatenate((c, n)), len(x)).astype(np.int64)
                if len(x) > HELD_ROWS:
                    yield counted()
                    x, c = x[:0], c[:0]
        yield counted()
        trim()

    return docs.mapInArrow(run, "x long, c long").groupBy("x").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The discounts of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n = {r["k"]: r["n"] for r in counts.where("c <= 4").groupBy(F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def model_table(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """key, own, rest for every n-gram: its discounted probability after its context, and the weight that it, as a context, leaves to the lower order.

    Each order is written by itself: all in one plan would have the driver hold the tasks and shuffles of some twenty stages at once.
    """
    parts = []
    for n in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(counts)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = counts.select("x", "c", F.shiftright("x", 8).alias("h"), cut.alias("d"))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        own = rows.join(contexts, "h").select((F.col("x").bitwiseOR(F.lit(n << 8 * ORDER))).alias("key"), ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), F.lit(None).cast("double").alias("rest"))
        rest = contexts.select((F.col("h").bitwiseOR(F.lit((n - 1) << 8 * ORDER))).alias("key"), F.lit(None).cast("double").alias("own"), (F.col("left") / F.col("total")).alias("rest"))
        parts.append(scratch.table(own.unionByName(rest), f"order{n}"))
        if n > 1:
            # lower orders count the distinct n-grams that end with them
            suffix = F.col("x").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            counts = scratch.table(counts.groupBy(suffix.alias("x")).agg(F.count(F.lit(1)).alias("c")), f"counts{n - 1}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.max("own").alias("own"), F.max("rest").alias("rest"))


def probabilities(codes: np.ndarray, keys: np.ndarray, own: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log p of distinct ORDER-grams from the answers (sorted keys; own 0 and rest 1 where unseen)."""

    def at(codes: np.ndarray, n: int) -> np.ndarray:
        return np.searchsorted(keys, tagged(codes, n))

    def p(codes: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(codes), 1 / 256)
        shorter, back = np.unique(codes & np.uint64((1 << 8 * (n - 1)) - 1), return_inverse=True)
        return own[at(codes, n)] + rest[at(codes >> np.uint64(8), n - 1)] * p(shorter, n - 1)[back]

    return np.log(p(codes, ORDER))


def steps() -> list[str]:
    """The scratch tables that `model_table` leaves."""
    return [f"counts{n}" for n in range(1, ORDER)] + [f"order{n}" for n in range(1, ORDER + 1)]


def prime(n: int) -> int:
    n = max(3, n | 1)
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def compressed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns of `docs` (text first) with the text compressed: it is shuffled as such."""
    schema = docs.select(F.lit(b"").alias("packed"), *keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(3)
        for batch in batches:
            packed = pa.array([c.compress(t) for t in utf8(batch.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], ["packed", *keep])
        trim()

    return docs.select("text", *keep).mapInArrow(run, schema)


#: What names a text: rows with equal texts are scored once.
TEXT = ["text_id", "text_bytes"]


def text_key() -> list:
    return [F.xxhash64("text").alias("text_id"), F.octet_length("text").alias("text_bytes")]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, fold and held (1 where it only calibrates) of the trusted documents: good quality, not toxic."""
    rows = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    fold = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)).cast("int")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("fold", fold)
    return rows.withColumn("held", (F.col("fold") == 0).cast("int"))


def train(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """The model table from all trusted documents (a written table) that do not calibrate, whole texts; their counts stay in scratch's `counts`."""
    learn = trusted.where("held = 0").select("doc_id")
    wanted = IdFilter(learn, "doc_id")
    rows = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select("text", F.col("doc_id").cast("long").alias("doc_id"))
    with wanted.shared() as shared:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = zstandard.ZstdCompressor(3)
            for batch in batches:
                batch = batch.take(pa.array(in_filter(shared.value, batch.column(2).to_numpy())))
                packed = pa.array([c.compress(t) for t in utf8(batch.column(0))], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(1)], ["packed", "doc_id"])
            trim()

        passed = rows.withColumn("place", wanted.place("doc_id")).mapInArrow(run, "packed binary, doc_id long")
        counts = scratch.table(count_table(passed.join(learn, "doc_id", "left_semi").select("packed")), "counts")
    model = scratch.table(model_table(counts, scratch), "model")
    del passed, counts
    scratch.release(*steps())
    return model


def out_of_fold(docs: DataFrame, ids: DataFrame, counts: DataFrame, scratch: Scratch) -> dict[int, DataFrame]:
    """For each fold of `ids` (a written table of doc_id, fold) but the first: the texts' perplexities by a model without that fold.

    The documents are in `counts`. Such a model takes the first fold of `ids` in
    place of the fold it leaves out.
    """
    key = F.col("doc_id").cast("long")
    mine = split_by_filter(docs.select("doc_id", "text").where(F.col("text") != ""), ids.select("doc_id"), key, "doc_id")[1]
    mine = scratch.table(mine.select(key.alias("doc_id"), "text").join(ids, "doc_id"), "small")
    folds = sorted(r["fold"] for r in mine.select("fold").distinct().collect())  # at most HELD_OUT
    own = scratch.table(count_table(compressed(mine.where("fold = 0"), [])), "small0")
    out = {}
    for fold in (f for f in folds if f):
        rows = mine.where(F.col("fold") == fold)
        less = count_table(compressed(rows, [])).withColumn("c", -F.col("c"))
        c = counts.unionByName(own).unionByName(less).groupBy("x").agg(F.sum("c").alias("c")).where("c > 0")
        model = scratch.table(model_table(scratch.table(c, "fold_counts"), scratch), "fold_model")
        out[fold] = scratch.table(perplexities(rows, model, scratch), f"out{fold}")
        del rows, less, c, model
        scratch.release("fold_counts", "fold_model", *steps())
    del mine, own
    scratch.release("small", "small0")
    return out


def perplexities(docs: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """text_id, text_bytes and perplexity of every distinct non-empty text: exp of the mean -log p of its bytes."""
    texts = docs.where(F.col("text") != "").select("text", *text_key())
    seen = scratch.table(texts.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n")), "seen")
    size = seen.agg(F.sum("text_bytes").alias("b")).first()["b"] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    model_rows = model.count()
    shards = prime(min(MOST_SHARDS, -(-model_rows // SHARD_ROWS)))
    together = min(max(TOGETHER, MODEL_SHARE * MODEL_ROW * model_rows // BUCKET_BYTES), max(TOGETHER, 20 * shards))
    turns = -(-buckets // together)
    # only texts that may be repeated are shuffled to meet their copies
    once, repeated = split_by_filter(texts, seen.where("n > 1").select(F.xxhash64(*TEXT).alias("k")), F.xxhash64(*TEXT), "k")
    repeated = compressed(repeated, TEXT).groupBy(*TEXT).agg(F.first("packed").alias("packed"))
    rows = compressed(once, TEXT).unionByName(repeated).withColumn("bucket", F.pmod(F.xxhash64(*TEXT), F.lit(buckets)).cast("int"))
    rows = rows.select("packed", *TEXT, "bucket").repartition(buckets, "bucket")

    def ask(table: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        codes = np.zeros(0, np.uint64)
        texts = (d.decompress(b.as_py()) for chunk in table.column("packed").chunks for b in chunk)
        held: list[bytes] = []
        while True:
            t = next(texts, None)
            if t is not None:
                held.append(t)
            if t is None or sum(map(len, held)) > KERNEL_BYTES:
                codes = np.unique(np.concatenate((codes, np.unique(ngrams(held)[0])))) if held else codes
                held = []
            if t is None:
                break
        keys = [tagged(codes, ORDER)]
        for n in range(ORDER, 0, -1):
            codes = lower(codes, n)
            keys.append(tagged(codes, n - 1))
        keys = np.concatenate(keys)
        shard = (keys % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        parts = np.split(keys, at[1:])
        bucket = table.column("bucket")[0].as_py()
        trim()
        return pa.table({"bucket": pa.array([bucket] * len(parts), pa.int32()), "shard": pa.array(shard[at]), "keys": pa.array([_pack(p) for p in parts], pa.binary())})

    asked = rows.groupBy("bucket").applyInArrow(ask, "bucket int, shard int, keys binary")
    asked = asked.withColumn("turn", (F.col("bucket") / together).cast("int"))
    asked = asked.groupBy("shard", "turn").agg(F.collect_list(F.struct("bucket", "keys")).alias("asked"))  # at most `together` rows each
    held = model.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int")).groupBy("shard").agg(F.collect_list(F.struct("key", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("rest", F.lit(1.0)).alias("rest"))).alias("rows"))
    held = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), *[F.col("rows")[c].alias(c) for c in ("key", "own", "rest")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                empty = batch.column(1)[i].as_py() is None  # no n-gram of the model is in this shard
                key, own, rest = (np.zeros(0) if empty else batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                order = np.argsort(key)
                key, own, rest = key[order].astype(np.uint64), own[order], rest[order]
                out: dict[str, list] = {"bucket": [], "keys": [], "own": [], "rest": []}
                for row in batch.column(0)[i].as_py():
                    want = _unpack(row["keys"], np.uint64)
                    if len(key):
                        k = np.minimum(np.searchsorted(key, want), len(key) - 1)
                        hit = key[k] == want
                        a, b = np.where(hit, own[k], 0.0), np.where(hit, rest[k], 1.0)
                    else:
                        a, b = np.zeros(len(want)), np.ones(len(want))
                    for n, v in (("bucket", row["bucket"]), ("keys", row["keys"]), ("own", _pack(a.astype(np.float32))), ("rest", _pack(b.astype(np.float32)))):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), **{n: pa.array(out[n], pa.binary()) for n in ("keys", "own", "rest")}})

    answers = asked.join(held, ["shard", "turn"], "left").select("asked", "key", "own", "rest").mapInArrow(answer, "bucket int, keys binary, own binary, rest binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"text_id": pa.array([], pa.int64()), "text_bytes": pa.array([], pa.int32()), "perplexity": pa.array([], pa.float64())})
        keys = np.concatenate([_unpack(b, np.uint64) for b in right.column("keys").to_pylist()])
        own, rest = (np.concatenate([_unpack(b, np.float32) for b in right.column(c).to_pylist()]).astype(np.float64) for c in ("own", "rest"))
        order = np.argsort(keys)
        keys, own, rest = keys[order], own[order], rest[order]
        top = keys[keys >= np.uint64(ORDER << 8 * ORDER)] & np.uint64((1 << 8 * ORDER) - 1)
        logs = probabilities(top, keys, own, rest)
        d = zstandard.ZstdDecompressor()
        out = []
        for chunk in left.column("packed").chunks:
            for b in chunk:
                x = ngrams([d.decompress(b.as_py())])[0]
                out.append(float(np.exp(-logs[np.searchsorted(top, x)].mean())))
        trim()
        return pa.table({"text_id": left.column("text_id"), "text_bytes": left.column("text_bytes"), "perplexity": pa.array(out, pa.float64())})

    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "text_id long, text_bytes int, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, q: float = QUANTILE) -> DataFrame:
    """doc_id, text_id, text_bytes, lang, perplexity, threshold, rejected for every row of docs (doc_id, text, lang).

    The model is trained on labels' trusted documents (quality 1, not toxic),
    but for one in HELD_OUT, whose q-quantile of perplexities is their language's
    threshold. A language with fewer than LEAST of them takes the quantile over
    all its trusted documents, the others scored out of fold; null is a language
    like others, and the only one where the table has no such column. A document
    above its threshold is rejected. Null and empty texts have no perplexity and
    are not rejected; a language without trusted text has no threshold, and
    nothing of it is rejected. Equal texts have one perplexity; rows with a null
    doc_id are scored and never trusted. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "kneserney")
    trusted = scratch.table(trusted_ids(labels), "trusted")
    model = train(docs, trusted, scratch)
    scored = scratch.table(perplexities(docs, model, scratch), "scored")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), lang_of(docs))
    # a text that a large part of the rows share is split by the adaptive join
    rows = scratch.table(rows.join(scored, TEXT, "left").select("doc_id", *TEXT, "lang", "perplexity"), "rows")
    known = rows.where("perplexity IS NOT NULL").join(trusted, "doc_id").select("doc_id", *TEXT, "lang", "perplexity", "fold", "held")
    known = scratch.table(known, "known")
    few = known.groupBy("lang").agg(F.sum("held").alias("n")).where(F.col("n") < LEAST).select(F.col("lang").alias("few"))
    small = scratch.table(known.join(few, F.col("lang").eqNullSafe(F.col("few"))).drop("few"), "few")
    seen = known.where("held = 1").select("lang", "perplexity")
    if small.where("held = 0").limit(1).count():
        ids = scratch.table(small.select("doc_id", "fold").distinct(), "few_ids")
        for fold, scores in out_of_fold(docs, ids, spark.read.parquet(f"{scratch.root}/counts"), scratch).items():
            unseen = small.where((F.col("held") == 0) & (F.col("fold") == fold)).select(*TEXT, "lang")
            seen = seen.unionByName(unseen.join(scores, TEXT).select("lang", "perplexity"))
    scratch.release("counts", "model", "scored", "seen")
    cut = seen.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("perplexity", F.lit(q), F.lit(10_000)).alias("threshold"))
    rows = rows.join(F.broadcast(scratch.table(cut, "cut")), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row for each language
    return rows.select("doc_id", *TEXT, "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)).alias("rejected"))


def good_documents(docs: DataFrame, labels: DataFrame, q: float = QUANTILE) -> DataFrame:
    """The rows of `docs` that the model does not reject, unchanged. Cases are as `quality` defines them."""
    lang = lang_of(docs)
    lang = F.xxhash64(lang, lang.isNull())
    bad = quality(docs, labels, q).where("rejected").select(*TEXT, F.xxhash64("lang", F.col("lang").isNull()).alias("in_lang"))
    text_id, text_bytes = text_key()
    return without_rows(docs, bad, Scratch(docs.sparkSession, "kneserney"), text_id=text_id, text_bytes=text_bytes, in_lang=lang)
