"""Operator 9: convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed rows for the word and for its first
few bytes, so that inflected forms share a stem's row. Filters of several
widths slide over the words, each keeps its maximum over the whole text, and a
logistic layer scores the maxima. Rows that too few training texts hold stay
zero: an unknown word says nothing.

The fit takes a sample of the labelled rows, bounded in rows and in bytes, and
runs in one executor task, which returns the model; the driver holds no texts.
Scoring runs over every text in Arrow batches. Thresholds for keeping documents are calibrated for each
language on all labelled rows that the fit leaves out, and, where these are few,
on its rows scored out of fold; the language chooses a threshold and never
enters a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, lang_of, prepare, quoted, sub_batches, trim, unused, utf8, without_rows, words_of

PREFIXES = (4, 5, 6, 8)
SLOT_BITS, DIM, FILTERS, WIDTHS = 19, 6, 4, (1, 2, 3)
#: Labelled rows that the fit takes at most: of each class, the first by a hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: Text bytes that the fit takes at most: a task's memory is a few times as much.
MAX_BYTES = 48 << 20
#: Training texts that must hold a word or prefix before it gets an embedding.
MIN_TEXTS = 4
#: Folds of the sample; the fit leaves the last out.
FOLDS = 5
#: A language with fewer left-out rows of a class also calibrates on the sample's rows, out of fold.
LEAST = 15
#: Steps of the scores in the histograms that calibrate.
STEPS = 10_000


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each feature of each word, first word of each text and the end); row 0 is none."""
    words, _, first, *parts = words_of(texts, PREFIXES)
    shift = np.uint64(64 - SLOT_BITS)
    columns = [np.maximum(words >> shift, 1), *(np.where(p == 0, 0, np.maximum(p >> shift, 1)) for p in parts)]
    return np.stack(columns, 1).astype(np.int32), first


@dataclass
class Model:
    table: np.ndarray
    weights: list[np.ndarray]  # for each width: (width * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    threshold: float = 0.7

    def __getstate__(self) -> dict:
        """All but a few rows of the table are zero, and only the others travel."""
        at = np.flatnonzero(self.table.any(1))
        return {**self.__dict__, "table": (len(self.table), at, self.table[at])}

    def __setstate__(self, state: dict) -> None:
        n, at, rows = state["table"]
        self.__dict__.update(state)
        self.table = np.zeros((n, rows.shape[1]), np.float32)
        self.table[at] = rows

    def pooled(self, rows: np.ndarray, first: np.ndarray, where: bool = False):
        """The filters' maxima for each text (0 for a text shorter than a filter); with `where` also the words that made them."""
        n, k = len(first) - 1, len(WIDTHS) * FILTERS
        best, at = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        if len(rows):
            x = self.table[rows[:, 0]]
            for j in range(1, rows.shape[1]):
                x += self.table[rows[:, j]]
            # one product for all filters' parts, then each width adds its parts
            parts = x @ np.concatenate([w[j * DIM : (j + 1) * DIM] for w, width in zip(self.weights, WIDTHS, strict=True) for j in range(width)], 1)
            at_part = 0
            for i, width in enumerate(WIDTHS):
                mine = [parts[:, (at_part + j) * FILTERS : (at_part + j + 1) * FILTERS] for j in range(width)]
                at_part += width
                inside = np.flatnonzero(np.diff(first) >= width)
                if not len(inside):
                    continue
                m = len(rows) - width + 1
                s = mine[0][:m].copy()
                for j in range(1, width):
                    s += mine[j][j : j + m]
                s += self.bias[i * FILTERS : (i + 1) * FILTERS]
                spans = np.stack([first[inside], first[inside + 1] - width + 1], 1).ravel()
                # each text's windows end before the next text's first word
                spans = spans[:-1] if spans[-1] >= m else spans
                top = np.maximum.reduceat(s, spans)[::2]
                best[inside, i * FILTERS : (i + 1) * FILTERS] = np.maximum(top, 0)
                if where:
                    for d, (a, b, t) in zip(inside, zip(first[inside], first[inside + 1] - width + 1, top, strict=True), strict=True):
                        hit = a + np.argmax(s[a:b], 0)
                        at[d, i * FILTERS : (i + 1) * FILTERS] = np.where(t > 0, hit, -1)
        return (best, at) if where else best

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in sub_batches(np.array([len(t) for t in texts])):
            z = self.pooled(*slots(texts[a:b])) @ self.out + self.out_bias
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 11) -> Model:
    """Train on whole texts. The first embedding dimension starts at the smoothed log odds of its row."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    size = 1 << SLOT_BITS
    held = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
    kept = []
    for text, label in zip(texts, y, strict=True):
        rows, first = slots([text])
        kept.append(rows)
        held[int(label)][np.unique(rows)] += 1
    n_pos, n_neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    frequent = held[0] + held[1] >= MIN_TEXTS
    frequent[0] = False
    odds = np.log((held[1] + 0.5) / (n_pos + 1)) - np.log((held[0] + 0.5) / (n_neg + 1))
    table = (rng.standard_normal((size, DIM)) * 0.02).astype(np.float32)
    table[:, 0] = np.clip(odds, -4, 4) * 0.5
    table[~frequent] = 0
    k = len(WIDTHS) * FILTERS
    weights = [(rng.standard_normal((w * DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    for w, width in zip(weights, WIDTHS, strict=True):
        w[np.arange(width) * DIM, :] += 1 / width
    model = Model(table, weights, np.full(k, -0.5, np.float32), np.full(k, 1 / k), -2.0)
    state = [np.zeros_like(a, np.float32) for a in (*weights, model.bias)] + [np.zeros(k), 0.0]
    table_state = np.zeros(size, np.float32)
    rate = 0.1
    weight = np.where(y == 1, 0.5 * len(y) / n_pos, 0.5 * len(y) / n_neg)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            rows = np.concatenate([kept[d] for d in chosen])
            first = np.concatenate(([0], np.cumsum([len(kept[d]) for d in chosen])))
            best, at = model.pooled(rows, first, where=True)
            p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30)))
            g = (p - y[chosen]) * weight[chosen] / len(chosen)
            g_out, g_best = best.T @ g, g[:, None] * model.out
            g_bias = np.where(at >= 0, g_best, 0).sum(0)
            g_weights = [np.zeros_like(w) for w in weights]
            touched, grads = [], []
            for i, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    col = i * FILTERS + f
                    live = np.flatnonzero(at[:, col] >= 0)
                    for j in range(width):
                        r = rows[at[live, col] + j]
                        x = table[r].sum(1)
                        part = slice(j * DIM, (j + 1) * DIM)
                        g_weights[i][part, f] += x.T @ g_best[live, col]
                        touched.append(r.ravel())
                        grads.append(np.repeat(g_best[live, col][:, None] * weights[i][part, f], r.shape[1], 0))
            for w, gw, s in zip([*weights, model.bias], [*g_weights, g_bias], state, strict=False):
                s += gw * gw
                w -= (rate * gw / (np.sqrt(s) + 1e-6)).astype(np.float32)
            state[-2] += g_out * g_out
            model.out -= rate * g_out / (np.sqrt(state[-2]) + 1e-6)
            state[-1] += g.sum() ** 2
            model.out_bias -= rate * g.sum() / (np.sqrt(state[-1]) + 1e-6)
            if touched:
                at_rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(at_rows), DIM))
                np.add.at(total, inverse, np.concatenate(grads))
                total[~frequent[at_rows]] = 0
                table_state[at_rows] += (total * total).mean(1)
                table[at_rows] -= (rate * total / (np.sqrt(table_state[at_rows])[:, None] + 1e-6)).astype(np.float32)
    return model


def threshold_of(scores: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float | None:
    """Midway in the widest gap of best F1, from the distinct scores and how many toxic and clean rows have each; None without both classes."""
    if not toxic.sum() or not clean.sum():
        return None
    order = np.argsort(scores)
    s, t, c = scores[order], toxic[order], clean[order]
    cuts = np.append(s, 1.0)
    hits, all_above = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (t, t + c))
    f1 = 2 * hits / np.maximum(1, all_above + t.sum())
    top = np.flatnonzero(f1 == f1.max())
    cut = (cuts[top[-1]] + s[top[0] - 1]) / 2 if top[0] else cuts[0]
    return float(np.clip(cut, 0.3, 0.9))


def nothing_learnt() -> Model:
    """The model where a class has no rows: every text gets the same low score."""
    k = len(WIDTHS) * FILTERS
    zero = [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS]
    return Model(np.zeros((1 << SLOT_BITS, DIM), np.float32), zero, np.zeros(k, np.float32), np.zeros(k), -3.0)


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled documents that may teach: crc32(doc_id as text) mod 3 is not 1. A document with both labels is toxic."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


SAMPLE = "doc_id long, text string, toxic int, lang string, fold int"


def sample_of(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows that a fit may take, written, with the fold of each: doc_id, text, toxic, lang, fold.

    At most `max_toxic` and `max_clean` learnable rows and `max_bytes` of whole
    texts, the first by a hash of doc_id. Null texts count as empty. Rows of one
    doc_id share a fold.
    """
    chosen = learnable(labels).withColumn("o", F.xxhash64("doc_id"))
    first = [chosen.where(F.col("toxic") == t).orderBy("o", "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    sample = F.broadcast(first[0].unionByName(first[1]))  # at most max_toxic + max_clean rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang_of(docs)).join(sample, "doc_id")
    # a repeated doc_id must not widen the bound
    rows = rows.orderBy("o", "doc_id", "text").limit(max_toxic + max_clean).select("doc_id", "text", "toxic", "lang")

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, held = None, -1, 0
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), [len(t) for t in utf8(batch.column(1))]
            fold = []
            for i, size in zip(ids, sizes, strict=True):
                held += size
                if held > max_bytes:
                    break
                n, last = n + (i != last), i
                fold.append(n % FOLDS)
            part = batch.slice(0, len(fold))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fold, pa.int32())], ["doc_id", "text", "toxic", "lang", "fold"])
            if held > max_bytes:
                return

    prepare(docs.sparkSession)
    return scratch.table(rows.coalesce(1).mapInArrow(folds, SAMPLE), "sample")


def fitted(sample: DataFrame, without: int = FOLDS - 1) -> Model:
    """A model of all folds but one, fitted in one executor task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _fit_rest(batches, without)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})
        trim()

    # the rows of the table that are not zero: bounded by the sample, and by 2**SLOT_BITS in any case
    return pickle.loads(sample.coalesce(1).mapInArrow(run, "model binary").first()["model"])


def out_of_fold(sample: DataFrame, folds: list[int]) -> DataFrame:
    """lang, toxic and toxicity of the sample's rows in these folds, each scored by a model fitted without its fold: a task for each fold."""
    parts = []
    for fold in folds:

        def run(batches: Iterator[pa.RecordBatch], fold: int = fold) -> Iterator[pa.RecordBatch]:
            model, (texts, toxic, langs) = _fit_rest(batches, fold)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "toxic": pa.array(toxic, pa.int32()), "toxicity": pa.array(model.score(texts), pa.float64())})
            trim()

        parts.append(sample.coalesce(1).mapInArrow(run, "lang string, toxic int, toxicity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fit_rest(batches: Iterator[pa.RecordBatch], without: int) -> tuple[Model, tuple[list[bytes], list[int], list[str | None]]]:
    """A model of the rows outside a fold, and the fold's texts, labels and languages."""
    own, rest = ([], [], []), ([], [])
    for batch in batches:
        for text, toxic, lang, fold in zip(utf8(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            for part, x in zip(own if fold == without else rest, (text, toxic, lang), strict=False):
                part.append(x)
    texts, labels = rest
    model = fit(texts, np.array(labels)) if 0 < sum(labels) < len(labels) else nothing_learnt()
    return model, own


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model of labels.toxic, fitted on all folds of the sample but the last."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = fitted(sample_of(docs, labels, scratch, max_toxic, max_clean))
    scratch.drop("sample")
    return model


def calibrate(model: Model, scored: DataFrame, sample: DataFrame, labels: DataFrame) -> None:
    """The model's thresholds, for each language (null is one) with labelled rows of both classes.

    They come from every learnable row of `scored` (doc_id, lang, toxicity) that
    the model was not fitted on. A language with fewer than LEAST of them of a
    class adds the fitted rows, each scored by a model fitted without its fold.
    """
    step = F.floor(F.col("toxicity") * STEPS).cast("int").alias("step")
    sums = (F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    used = sample.where(F.col("fold") != FOLDS - 1).select("doc_id").distinct()
    rest = learnable(labels).join(F.broadcast(used), "doc_id", "left_anti")  # at most the sample
    bars: dict[str | None, list[tuple[float, int, int]]] = {}

    def add(counts: DataFrame) -> None:
        for r in counts.groupBy("lang", step).agg(*sums).collect():  # at most STEPS + 1 rows a language
            bars.setdefault(r["lang"], []).append((r["step"] / STEPS, r["toxic"], r["clean"]))

    add(scored.join(rest, "doc_id"))
    found: dict[str | None, set[int]] = {}
    for r in sample.where(F.col("fold") != FOLDS - 1).select("lang", "fold").distinct().collect():  # at most the sample
        found.setdefault(r["lang"], set()).add(r["fold"])
    few = [x for x in found if min(sum(b[k] for b in bars.get(x, [])) for k in (1, 2)) < LEAST]
    if few:
        rows = out_of_fold(sample, sorted(set().union(*(found[x] for x in few))))
        in_few = F.lit(False)
        for x in few:
            in_few |= F.col("lang").eqNullSafe(F.lit(x))
        add(rows.where(in_few))
    for lang, counts in bars.items():
        s, back = np.unique([b[0] for b in counts], return_inverse=True)
        t = threshold_of(s, *(np.bincount(back, [b[k] for b in counts]) for k in (1, 2)))
        if t is not None:
            model.thresholds[lang] = t


def score_documents(docs: DataFrame, model: Model | Broadcast, columns: list[str]) -> DataFrame:
    """`columns` of every row and its `toxicity` (0 to 1), from the whole text; null and empty texts get the bias alone.

    Repeated rows and null doc_ids are scored like others; an empty table gives
    no rows. Columns that are not asked for are ignored, whatever their names;
    one that is asked for must not be called `toxicity`.
    """
    spark = docs.sparkSession
    prepare(spark)
    # a fixed number of rows, whatever the corpus
    shared = model if isinstance(model, Broadcast) else spark.sparkContext.broadcast(model)
    source = docs.select(*quoted(columns), F.col("text").alias(unused(columns, "text")[0]))
    at = len(columns)
    schema = docs.select(*quoted(columns), F.lit(0.0).cast("double").alias("toxicity")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(shared.value.score(utf8(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], score], [*columns, "toxicity"])
        trim()

    return source.mapInArrow(run, schema)


def harmless_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang if there is one) below their language's threshold, unchanged.

    Rows that agree in doc_id, text and language share their fate; rows without a
    doc_id or text are judged by their score like others. An empty table gives no
    rows. Other columns pass unchanged, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = sample_of(docs, labels, scratch)
    model = fitted(sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", lang_of(docs), F.xxhash64("text").alias("text_id"), "text")
    scored = scratch.table(score_documents(rows, shared, ["doc_id", "lang", "text_id"]), "scored")
    shared.destroy()
    calibrate(model, scored, sample, labels)
    lang = lang_of(docs)
    doc, lang = F.xxhash64("doc_id", F.col("doc_id").isNull()), F.xxhash64(lang, lang.isNull())
    bad = scored.where(rejected(model)).select(doc.alias("doc"), "text_id", lang.alias("in_lang"))
    out = without_rows(docs, bad, scratch, doc=doc, text_id=F.xxhash64("text"), in_lang=lang)
    scratch.drop("sample", "scored")
    return out


def rejected(model: Model):
    """The column that says whether a scored document goes: its language's threshold decides."""
    cut = F.lit(float(model.threshold))
    for lang, t in model.thresholds.items():
        cut = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(t)).otherwise(cut)
    return F.col("toxicity") >= cut
