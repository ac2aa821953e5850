import corpus_pipeline
from docloom.llm import minhash


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] > sizes[3]
    left = {r.doc_id for r in docs.collect()}
    toxic = [i for i, r in labels.items() if r.toxic == 1]
    clean = [i for i, r in labels.items() if r.toxic == 0 and r.quality == 1]
    assert len(left & set(toxic)) < 0.4 * len(toxic) and len(left & set(clean)) > 0.7 * len(clean)
    assert minhash.near_duplicates(docs.select("doc_id", "text")).where("NOT kept").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left


def test_odd_documents(spark, odd, empty):
    d = "/root/testdata/sf0.001"
    for df in (odd, empty):
        docs = df.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, d)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[0] == "doc_id"


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 < r.length <= 1024 for r in rows)
