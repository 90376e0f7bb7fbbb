"""The classifier chain: held-out accuracy, out-of-fold training, and rows of every odd kind."""

from pyspark.sql import functions as F

from tonewheel.llm import toxicity

CATEGORIES = ["low_quality", "toxic"]


def test_held_out_accuracy(spark):
    """Fitted on the labels of four fifths of the documents, asked about the last fifth.

    Measured: 86 of 99 found. The bound lies a little below; it is no aim, and more labels find more.
    """
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5))
    chain = toxicity.fit(docs, toxicity.with_categories(labels.filter(fifth != 0)), CATEGORIES)
    held = labels.filter(fifth == 0)
    told = toxicity.score(docs.join(held, "doc_id", "left_semi"), chain).join(held, "doc_id").select("is_toxic", "toxic").collect()
    toxic = [r.is_toxic for r in told if r.toxic == 1]
    clean = [r.is_toxic for r in told if r.toxic == 0]
    print(f"held out: missed {toxic.count(False)} of {len(toxic)} toxic, rejected {clean.count(True)} of {len(clean)} clean")
    assert len(toxic) > 30 and sum(toxic) >= 0.8 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_later_models_see_earlier_probabilities(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = toxicity.with_categories(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    chain = toxicity.fit(docs, labels, CATEGORIES)
    first, second = (m.coefficients.size for m in chain.models)
    assert second == first + 1

    odd = [
        (1, None, 1.0), (2, "", 2.0), (None, "some words here", 3.0), (2, "", 2.0), (4, "word " * 200_000, 4.0), (5, "#$%! ?", 5.0),
    ]
    rows = spark.createDataFrame(odd, "doc_id long, text string, words double").withColumn("p_toxic", F.lit("old")).withColumn("bag", F.lit(1))
    got = toxicity.score(rows, chain)
    assert [c for c in got.columns if c in ("doc_id", "text", "words", "bag")] == ["doc_id", "text", "words", "bag"]
    assert got.columns.count("p_toxic") == 1 and dict(got.dtypes)["p_toxic"] == "double"
    found = got.collect()
    assert len(found) == len(odd) and all(0 <= r.p_toxic <= 1 and r.is_toxic is not None for r in found)
    assert {r.words for r in found} == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert not any(r.is_toxic for r in found if not r.text)
    assert toxicity.score(rows.limit(0), chain).collect() == []


def test_repeated_and_null_labels(spark):
    docs = spark.createDataFrame([(k, f"good plain words {k}" if k % 2 else f"vile words {k}") for k in range(60)], "doc_id long, text string")
    rows = [(k, 1, 1 - k % 2) for k in range(60)] + [(k, 0, 0) for k in range(0, 60, 6)] + [(None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, toxicity.with_categories(labels), CATEGORIES)
    found = {r.doc_id: r.is_toxic for r in toxicity.score(docs, chain).collect()}
    assert all(found[k] == (k % 2 == 0) for k in range(60))


def test_a_category_without_two_classes_is_left_out(spark):
    docs = spark.createDataFrame([(k, f"good plain words {k}" if k % 2 else f"vile words {k}") for k in range(60)], "doc_id long, text string")
    for quality in (lambda k: 1, lambda k: None, lambda k: k if k < 2 else None):
        labels = spark.createDataFrame([(k, quality(k), 1 - k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
        chain = toxicity.fit(docs, toxicity.with_categories(labels), CATEGORIES)
        found = toxicity.score(docs, chain).collect()
        assert all(r.is_toxic == (r.doc_id % 2 == 0) and r.p_toxic is not None for r in found) and len(found) == 60
        assert quality(0) == 0 or all(r.p_low_quality is None and not r.is_low_quality for r in found)


def test_words_of_a_fold_are_chosen_without_its_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VOCABULARY", 3)
    rows = [(k, k % 2, [f"w{k % 7}", f"v{k % 5}"], float(k % 3 == 0)) for k in range(80)]
    facts = spark.createDataFrame(rows, "doc_id long, fold long, words array<string>, toxic double")
    moved = facts.withColumn("toxic", F.when(F.col("fold") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain, other = toxicity.telling_words(facts, ["toxic"]), toxicity.telling_words(moved, ["toxic"])
    assert plain[0] == other[0] and len(plain[0]) == 3 and plain[1:] != other[1:]


def test_few_labels_are_said_to_be_in_fold(spark):
    docs = spark.createDataFrame([(k, f"words {k}") for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k == 3)) for k in range(12)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, toxicity.with_categories(labels), CATEGORIES).in_fold == ["toxic"]
