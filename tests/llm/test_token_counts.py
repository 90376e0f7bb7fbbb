import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tonewheel.llm.bpe import Codec
from tonewheel.llm.token_counts import CountTree, edited_counts, sample_edits

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return Codec(PATH, public_tokenizers.PATTERN)


def test_any_edits_agree_with_a_full_count(coder):
    draw = random.Random(11)
    alphabet = ["a", "B", "é", "7", " ", "  ", "\n", "'re", "'", "!", "日", "word ", "x. "]
    for _ in range(150):
        tree = CountTree(coder, "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 5, 300, 3000]))))
        for _ in range(12):
            size = len(tree.text)
            start = draw.randint(0, size)
            end = min(size, start + draw.choice([0, 0, 1, 3, 40, 700]))
            tree.edit(start, end, "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 2, 9, 200]))))
            assert tree.tokens == len(coder.encode(tree.text))
            assert tree.sums[1][0] == len(tree.text) and tree.pieces == sum(len(leaf[0]) for leaf in tree.leaves)


def test_only_touched_regions_are_encoded(coder):
    tree = CountTree(coder, "some words here. " * 5000)
    tree.edit(40_000, 40_004, "new")
    assert tree.encoded < 400 and tree.tokens == len(coder.encode(tree.text))


def test_documents(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in edited_counts(docs, sample_edits(docs["text"]), PATH, public_tokenizers.PATTERN).collect()}
    for r in docs.select("doc_id", "text").collect():
        n, t = len(r.text), r.text
        t = t[: n // 2] + " [edited]" + t[n // 2:]
        t = "Revised.\n" + t[: n * 3 // 4] + t[n * 3 // 4 + 10:]
        assert got[r.doc_id] == (len(coder.encode(r.text)), len(coder.encode(t)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "ab ՘ cd", 3), (2, "ab ՘ cd", 3)], "doc_id long, text string, n_tokens int")
    got = edited_counts(docs, F.lit(None).cast("array<struct<start:int,end:int,put:string>>"), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens == r.n_tokens_edited) for r in got) == [(0, True), (1, True), (2, True), (2, True)]
    assert edited_counts(docs.limit(0), sample_edits(docs["text"]), PATH, public_tokenizers.PATTERN).collect() == []
