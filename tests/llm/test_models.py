import math
import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import kneserney, sharding, toxicity
from docloom.llm.common import LOWER, IdFilter, Scratch, split_by_filter, without_rows
from pyspark.sql import functions as F


# ------------------------------------------------------------------ sharding


def test_shards_are_even_and_gapless(table, odd, empty):
    import zlib

    docs = table("documents")
    rows = sharding.assign_shards(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    got = sharding.assign_shards(odd).collect()
    assert len(got) == odd.count() and sorted(Counter(r.shard for r in got).values()) == [2] * 8
    assert [r.size for r in got if r.doc_id == 3] == [1]
    assert sharding.assign_shards(empty).collect() == []


def test_one_more_shard_moves_little(table):
    docs = table("documents")
    before = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 8, slack=0.25).collect()}
    after = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 9, slack=0.25).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.35 * len(before)


def test_rows_against_a_plain_clockwise_walk(table, odd):
    """Shards of rows placed one by one: each tries the shards that it meets clockwise, first choices before second ones."""
    import hashlib

    for docs in (table("documents"), odd):
        keyed = docs.select("doc_id", F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")).alias("k")).collect()
        slots = 1 << sharding.SLOT_BITS
        rows = sorted(((r.k % 2**64) * slots >> 64, r.k, r.doc_id or -1) for r in keyed)
        ring = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") * slots >> 64, s, v) for s in range(8) for v in range(64))
        room = [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)]
        shard = {}
        for choice in range(8):
            for n, (slot, _, _) in enumerate(rows):
                if n not in shard:
                    met = []
                    for _, s, _ in [x for x in ring if x[0] >= slot] + [x for x in ring if x[0] < slot]:
                        if s not in met:
                            met.append(s)
                    if room[met[choice]]:
                        room[met[choice]] -= 1
                        shard[n] = met[choice]
        want = Counter((rows[n][2], s) for n, s in shard.items())
        assert Counter((r.doc_id or -1, r.shard) for r in sharding.assign_shards(docs).collect()) == want


def test_copies_of_one_row_fill_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.assign_shards(docs).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [12] * 4 + [13] * 4
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(8))


def test_walk_fills_clockwise():
    plan = sharding.walk({0: 10, 5: 10}, 2, 4, 16, 0.0)
    assert plan.groupby("shard").apply(lambda g: (g.hi - g.lo).sum(), include_groups=False).tolist() == [10, 10]


# ------------------------------------------------------------------ toxicity


def held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, model, ["doc_id"]).collect()}
    test = [(r.toxic, scores[r.doc_id]) for r in labels.collect() if held(r.doc_id)]
    bad, good = [s for t, s in test if t], [s for t, s in test if not t]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.93
    assert np.mean([s < 0.7 for s in good]) > 0.97 and np.mean([s >= 0.7 for s in bad]) > 0.8
    assert all(0 <= s <= 1 for s in scores.values())


def test_toxicity_learns_from_its_own_rows_only(spark, table):
    labels = table("labels")
    docs = table("documents")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.table, b.table) and np.array_equal(a.out, b.out)


def test_toxicity_of_odd_rows(spark, odd, empty, table):
    model = toxicity.train(table("documents"), table("labels"))
    rows = toxicity.score_documents(odd, model, ["doc_id", "rank"]).collect()
    assert len(rows) == odd.count() and len({r.toxicity for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score_documents(empty, model, ["doc_id"]).collect() == []
    nothing = toxicity.train(empty, table("labels"))
    assert all(r.toxicity == pytest.approx(1 / (1 + math.exp(3))) for r in toxicity.score_documents(odd, nothing, ["doc_id"]).collect())
    kept = toxicity.harmless_documents(odd, table("labels"))
    assert kept.columns == odd.columns and kept.count() == odd.count()
    plain = odd.drop("lang")
    assert toxicity.harmless_documents(plain, table("labels")).columns == plain.columns


def test_thresholds_cover_all_labelled_rows(spark):
    learn = [i for i in range(1000) if not held(i)]
    rows, labels = [], []
    # 10 toxic rows of fi and null each: under the old least number of rows in the part left out
    for k, i in enumerate(learn[:400]):
        lang = "fi" if k % 8 == 1 else None if k % 8 == 2 else "en"
        bad = k // 8 % 5 == 0
        rows.append((i, f"word{k % 7} nice calm text {'vile brute ' if bad else 'kind friend '} end{k % 5}", lang))
        labels.append((i, int(bad)))
    rows.append((5000, "kind calm text", "sv"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.sample_of(docs, marks, Scratch(spark, "test"), 30, 60)
    model = toxicity.fitted(sample)
    scored = toxicity.score_documents(docs, model, ["doc_id", "lang"]).cache()
    toxicity.calibrate(model, scored, sample, marks)
    assert set(model.thresholds) == {"en", "fi", None}
    # en has enough rows left out, many beyond the sample: its threshold is theirs
    used = {r.doc_id for r in sample.collect() if r.fold != toxicity.FOLDS - 1}
    toxic = dict(labels)
    left = [(math.floor(r.toxicity * toxicity.STEPS) / toxicity.STEPS, toxic[r.doc_id]) for r in scored.collect() if r.lang == "en" and r.doc_id not in used]
    s, y = (np.array(x) for x in zip(*left, strict=True))
    assert len(used) < 80 and len(left) > 200
    assert model.thresholds["en"] == pytest.approx(toxicity.threshold_of(s, y, 1 - y))
    kept = {r.doc_id for r in toxicity.harmless_documents(docs, marks).collect()}
    assert kept == {i for i, _, _ in rows if not toxic.get(i)}


def test_toxicity_sample_is_not_lowered():
    assert toxicity.MAX_TOXIC >= 3000 and toxicity.MAX_CLEAN >= 6000


def slow_score(model, text):
    """The network word by word and filter by filter."""
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text.translate(LOWER)) if w]
    vectors = []
    for w in words:
        rows, _ = toxicity.slots([w])
        vectors.append(sum(model.table[r].astype(float) for r in rows[0]))
    z, k = float(model.out_bias), 0
    for width, weights in zip(toxicity.WIDTHS, model.weights, strict=True):
        for f in range(toxicity.FILTERS):
            found = [sum(float(vectors[i + j] @ weights[j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(width)) + float(model.bias[k]) for i in range(len(words) - width + 1)]
            z += max([0.0, *found]) * float(model.out[k])
            k += 1
    return 1 / (1 + math.exp(-z))


def test_scores_against_a_loop(spark, table, odd):
    model = toxicity.train(table("documents"), table("labels"))
    for df in (table("documents").where("doc_id < 40"), odd.where("doc_id <> 8 OR doc_id IS NULL")):
        texts = {r.k: r.text or "" for r in df.select(F.xxhash64("text").alias("k"), "text").collect()}
        rows = df.select(F.xxhash64("text").alias("k"), "text")
        for r in toxicity.score_documents(rows, model, ["k"]).collect():
            assert r.toxicity == pytest.approx(slow_score(model, texts[r.k].encode()), abs=1e-4)


def test_a_model_travels_without_its_empty_rows(table):
    model = toxicity.train(table("documents"), table("labels"))
    packed = pickle.dumps(model)
    assert len(packed) < 2_000_000 < model.table.nbytes
    assert np.array_equal(pickle.loads(packed).table, model.table)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, table):
    docs, labels = table("documents"), table("labels")
    rows = toxicity.sample_of(docs, labels, Scratch(spark, "test"), max_bytes=30_000).collect()
    whole = toxicity.sample_of(docs, labels, Scratch(spark, "test")).collect()
    assert 0 < sum(len(r.text.encode()) for r in rows) <= 30_000 and set(rows) < set(whole)
    # a document with both labels is toxic, one row each
    i = next(r.doc_id for r in whole if not r.toxic)
    both = labels.unionByName(labels.where(F.col("doc_id") == i).withColumn("toxic", F.lit(1).cast("int")))
    assert [r.toxic for r in toxicity.sample_of(docs, both, Scratch(spark, "test")).collect() if r.doc_id == i] == [1]


def test_filters_see_whole_texts():
    texts = [("nice words here " * 30 + ("vile brute " if k % 2 else "") + "more of it " * 200).encode() for k in range(80)]
    model = toxicity.fit(texts, np.array([k % 2 for k in range(80)]))
    scores = model.score([b"nice words here " * 5000 + b"vile brute", b"nice words here " * 5000])
    assert scores[0] > 0.7 > 0.4 > scores[1]


# ------------------------------------------------------------------ quality


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: text -> perplexity."""
    n = kneserney.ORDER
    top = Counter()
    for t in texts:
        padded = kneserney.PAD + t
        top.update(padded[i : i + n] for i in range(len(t)))
    counts = {n: top}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        h = Counter(c.values())
        n1, n2, n3, n4 = (h[i] for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0.5, 0.75, 0.9
        y = n1 / (n1 + 2 * n2)
        return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))

    cut = {k: discounts(c) for k, c in counts.items()}
    total, left = defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        for g, v in c.items():
            total[k, g[:-1]] += v
            left[k, g[:-1]] += cut[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        h = (k, g[:-1])
        if h not in total:
            return p(g[1:])
        v = counts[k][g]
        return (v - cut[k][min(v, 3) - 1] if v else 0) / total[h] + left[h] / total[h] * p(g[1:])

    def perplexity(t):
        padded = kneserney.PAD + t
        return math.exp(-sum(math.log(p(padded[i : i + n])) for i in range(len(t))) / len(t))

    return perplexity


def test_perplexity_against_dictionaries(spark):
    train = [(i, f"the cat {i} sat on the mat and the dog ran {i * i}") for i in range(40)]
    other = [(100, "the dog sat"), (101, "ZZZ!! ###"), (102, "é"), (103, ""), (104, None), (None, "the dog sat"), (105, "the cat " * 20000)]
    docs = spark.createDataFrame(train + other, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    trusted = scratch.table(spark.createDataFrame([(i, 0) for i, _ in train], "doc_id long, held int"), "trusted")
    model = kneserney.train(docs, trusted, scratch)
    want = brute_model([t.encode() for _, t in train])
    got = kneserney.perplexities(docs, model, scratch).collect()
    # equal texts are scored once
    assert len(got) == len(train) + 4
    texts = {r.k: r.text for r in docs.select(F.xxhash64("text").alias("k"), "text").collect()}
    for r in got:
        assert r.perplexity == pytest.approx(want(texts[r.text_id].encode()), rel=1e-5)


def test_quality_separates_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in kneserney.quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    good = [rows[r.doc_id] for r in labels.collect() if r.quality == 1]
    bad = [rows[r.doc_id] for r in labels.collect() if r.quality == 0]
    assert np.mean([[b.perplexity > g.perplexity for g in good] for b in bad]) > 0.95
    assert np.mean([g.rejected for g in good]) < 0.06 and np.mean([b.rejected for b in bad]) > 0.6


def test_quality_of_odd_rows(spark, odd, empty, table):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 0, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = kneserney.quality(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r.perplexity is None and not r.rejected for r in rows if r.doc_id in (3, 4))
    assert len({r.perplexity for r in rows if r.doc_id == 1}) == 1
    assert kneserney.good_documents(odd, labels).columns == odd.columns
    assert kneserney.quality(empty, labels).collect() == []
    plain = odd.drop("lang")
    assert kneserney.good_documents(plain, labels).columns == plain.columns
    rows = kneserney.quality(plain, labels).collect()
    assert len(rows) == odd.count() and {r.lang for r in rows} == {None}
    assert kneserney.quality(odd, labels.limit(0)).where("rejected").count() == 0


def test_small_languages_have_their_own_threshold(spark):
    rng = np.random.default_rng(5)
    words = {"en": "the cat sat on a mat and saw some dog run".split(), "fi": "kissa istui matolla ja koira juoksi pois talon".split(), None: "0110 1001 1100 0011 1010".split(), "sv": "katten satt på mattan och såg hunden".split()}
    sizes = {"en": 400, "fi": 40, None: 40, "sv": 20}
    rows, labels = [], []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i, " ".join(rng.choice(words[lang], 12)), lang))
            labels += [] if lang == "sv" else [(i, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneserney.quality(docs, trusted).collect()}
    fold = {r.doc_id: r.fold for r in kneserney.trusted_ids(trusted).collect()}
    assert len(got) == len(rows)
    texts = {i: t.encode() for i, t, _ in rows}
    lang = {i: x for i, _, x in rows}
    few = [i for i in fold if lang[i] != "en"]
    for x in ("fi", None):
        unseen = []
        for f in {fold[i] for i in few}:
            out = {i for i in few if fold[i] == f} | {i for i in fold if lang[i] == "en" and fold[i] == 0}
            want = brute_model([texts[i] for i in fold if i not in out])
            unseen += [want(texts[i]) for i in few if fold[i] == f and lang[i] == x]
        q = sorted(unseen)[math.ceil(0.99 * len(unseen)) - 1]
        assert len(unseen) == 40
        assert all(r.threshold == pytest.approx(q, rel=1e-5) for i, r in got.items() if lang[i] == x)
    # no trusted text: no threshold, nothing goes
    assert all(r.threshold is None and not r.rejected and r.perplexity > 1 for i, r in got.items() if lang[i] == "sv")


def test_rows_without_others(spark, odd):
    bad = spark.createDataFrame([(1,), (8,)], "_doc long")
    rest = without_rows(odd, bad, Scratch(spark, "test"), _doc=F.col("doc_id"))
    assert rest.columns == odd.columns
    assert sorted(map(repr, rest.collect())) == sorted(repr(r) for r in odd.collect() if r.doc_id not in (1, 8))


def test_filter_holds_every_id(spark):
    scratch = Scratch(spark, "test")
    ids = scratch.table(spark.range(0, 30_000, 3), "ids")
    for n in (0, 1, 10_000):
        some = scratch.table(ids.limit(n), f"ids{n}")
        clear, hit = split_by_filter(spark.range(30_000), some, F.col("id"), "id")
        assert clear.count() + hit.count() == 30_000 and clear.join(some, "id").count() == 0
        assert hit.count() <= n + 0.08 * 30_000
    found = IdFilter(ids, "id")
    with found.shared() as bits:
        places = np.array([r[0] for r in ids.select(found.place("id")).collect()])
        assert len(np.flatnonzero(bits.value[places >> 5] >> (places & 31).astype(np.uint32) & 1)) == 10_000


def test_orders_of_the_model_are_planned_apart(spark, table):
    """The driver holds the stages of one order at a time, and the last plan only reads what they wrote."""
    scratch = Scratch(spark, "test-orders")
    counts = scratch.table(spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 5 + 1).alias("c")), "counts")
    plan = kneserney.model_table(counts, scratch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {f"order{n}" for n in range(1, kneserney.ORDER + 1)} < scratch.kept
    scratch.release("counts", *kneserney.steps())
    assert not scratch.kept


def test_a_grown_heap_is_collected(monkeypatch):
    """The driver's heap is collected after a written table once it takes more than half of its limit."""
    from types import SimpleNamespace as S

    from docloom.llm import common

    monkeypatch.setattr(common, "trim_driver", lambda spark: None)
    done = []
    for total in (400, 600):
        runtime = S(totalMemory=lambda total=total: total, maxMemory=lambda: 1000)
        jvm = S(java=S(lang=S(Runtime=S(getRuntime=lambda r=runtime: r))), System=S(gc=lambda total=total: done.append(total)))
        common.shrink_driver(S(sparkContext=S(_jvm=jvm)))
    assert done == [600]
