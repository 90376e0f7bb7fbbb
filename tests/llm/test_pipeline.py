import corpus_pipeline
from tonewheel.llm import bpe, decontamination, ngram_join, toxicity


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = corpus_pipeline.without_toxic(spark, docs, sf)
    assert toxic.columns == docs.columns
    left = {r.doc_id for r in toxic.select("doc_id").collect()}
    told = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(told[i] == 0 and i not in left for i in told) <= 0.01 * len(told)
    assert sum(told[i] == 1 and i in left for i in told) <= 0.1 * sum(told.values())
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r.doc_id for r in got.collect()]
    leaked = {r.doc_id for r in decontamination.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    copies = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs.filter(docs.doc_id.isin(list(left))), 5, 80).collect()}
    assert set(ids) == {i for i in left if copies[i] == i} - leaked and len(ids) == len(set(ids))


def test_chain_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, toxicity.with_categories(labels), ["low_quality", "toxic"])
    assert chain is None and [r.is_toxic for r in toxicity.score(docs, chain).collect()] == [False, False]
    assert bpe.CHUNK > bpe.OVERLAP
