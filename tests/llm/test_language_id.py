import unicodedata
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.llm import language_id as module
from tonewheel.llm.language_id import BUCKETS, LONGEST, SPREAD, clustered, fit, gram_counts, predict, weights


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2



def plain_counts(text):
    """N-grams one by one."""
    letters = "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text)
    words = letters.split(" ")
    line = " " + " ".join(w for w in words if w) + " "
    counts = np.zeros(BUCKETS, np.int64)
    for n in range(1, LONGEST + 1):
        for i in range(len(line) - n + 1):
            gram = line[i: i + n]
            if gram == " ":
                continue
            code = 0
            for c in gram:
                code = (code << 21) ^ ord(c)
            counts[((code * SPREAD[n - 1]) % 2**64) >> (64 - 14)] += 1
    return counts


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_counts_agree_with_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(module, "PIECE", piece)
    for text in ["a", "Ab", " É  cole, 1x2!", "ÄÖ\n\n\nß日本 한국 İx", "नमस्ते दुनिया", "-- x --", "word " * 30, "\U0001d400 A"]:
        assert (gram_counts(text) == plain_counts(text)).all()
    assert gram_counts("") is None and gram_counts("12 ... \n") is None


def test_held_out_accuracy_and_cosine_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, ~held_out())
    assert sorted(set(model.languages)) == ["de", "en", "es", "fr"] and Counter(model.languages).most_common(1)[0][1] > 1
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held")).collect()
    learnt = [plain_counts(r.text) > 0 for r in rows if not r.held]
    idf = np.array([log((1 + len(learnt)) / (1 + n)) + 1 for n in np.sum(learnt, 0)])
    assert np.allclose(idf, model.idf)
    got = {r.doc_id: r for r in predict(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows if r.held]
    assert len(held) > 200 and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.98
    assert np.mean([got[r.doc_id].rejected for r in held]) < 0.05
    for r in rows[:25]:
        c = plain_counts(r.text)
        v = np.array([(1 + log(n)) * w if n else 0 for n, w in zip(c, idf)])
        near = model.centroids @ (v / np.linalg.norm(v))
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(near))] and abs(got[r.doc_id].score - near.max()) < 1e-9
    far = spark.createDataFrame([(1, "私は猫です。名前はまだ無い。どこで生れたか頓と見当がつかぬ。")], "doc_id long, text string")
    assert predict(far, model, ["doc_id"]).first().rejected
    assert predict(far, model, ["doc_id"], reject=True).first().lang_pred == "und"


def test_clusters():
    draw = np.random.default_rng(1)
    at = np.eye(3)[draw.integers(0, 3, 300)] + draw.normal(0, 0.05, (300, 3))
    found = clustered((at / np.linalg.norm(at, axis=1, keepdims=True)).astype(np.float32), 3)
    assert sorted(np.argmax(found, 1).tolist()) == [0, 1, 2] and found.max(1).min() > 0.99
    assert len(clustered(np.ones((5, 4), np.float32) / 2, 4)) == 1


def test_odd_rows(spark):
    rows = [(1, "aaa bbb", "x", "p"), (2, "aab bba", "x", "p"), (3, "zzz yyy", "y", "p"), (3, "zzz yyy", "y", "p"), (4, None, "x", "p"),
            (5, "", "x", "p"), (6, "12 !", "y", "p"), (None, "zzy yyz", None, None), (7, "yyz zz", None, "p"), (8, "bab " * 600_000, "x", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = predict(docs, fit(docs, F.lit(True)), ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [
        (0, "y"), (1, "x"), (2, "x"), (3, "y"), (3, "y"), (4, "und"), (5, "und"), (6, "und"), (7, "y"), (8, "x")]
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 for r in out)
    assert fit(docs, F.lit(None).cast("boolean")) is None and fit(docs.limit(0), F.lit(True)) is None
    assert {tuple(r)[1:] for r in predict(docs, None, ["doc_id"]).collect()} == {("und", 0.0, False)}
    assert predict(docs.limit(0), fit(docs, F.lit(True)), ["doc_id"]).collect() == []


def test_copies_do_not_fill_the_sample_beyond_its_bound(spark):
    docs = spark.range(3000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("one text again and again").alias("text"), F.lit("x").alias("lang"))
    model = fit(docs, F.lit(True), sample=50)
    assert model.languages == ["x"] and weights(gram_counts("one"), model.idf)[1].size > 0
