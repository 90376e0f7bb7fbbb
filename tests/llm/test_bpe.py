import hashlib
import random

import public_tokenizers
import pytest

from tonewheel.llm import bpe
from tonewheel.llm.bpe import Codec, round_trip, stitched

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return Codec(PATH, public_tokenizers.PATTERN)


def wanted(coder, text):
    ids = coder.coder.encode_ordinary(text or "")
    return (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def hard_texts():
    draw = random.Random(3)
    alphabet = ["a", "B", "ß", "é", "7", "²", " ", "  ", "\n", "\t", "　", "'s", "'", "!", "😀", "日", "՘", "\x1c", "don't"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    return texts + [None, "", " ", "\n" * 300, "x" * 500, " " * 300 + "x" * 300, "ab " * 200, "'s" * 150, "\n \n" * 90 + "z"]


def test_chunks_of_any_size_agree_with_the_library(spark, coder):
    texts = hard_texts()
    rows = [(k, t, "noise", 1) for k, t in enumerate(texts)] + [(None, texts[0], "noise", 1), (3, texts[3], "noise", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    for chunk, overlap in ((16, 8), (50, 20), (10_000, 100)):
        got = sorted(map(tuple, round_trip(docs, PATH, public_tokenizers.PATTERN, chunk, overlap).collect()), key=str)
        assert got == sorted(((i, *wanted(coder, t)) for i, t, *_ in rows), key=str)


def test_stretches_and_texts_out_of_step(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 3)
    texts = ["one two, three. " * 40, "x" * 300, "y" * 90 + " z" * 200, "\U0001fae9 " * 80]
    docs = spark.createDataFrame([(str(k), k, t) for k, t in enumerate(texts)], "_row string, doc_id long, text string")
    got = {r.doc_id: r.ids for r in stitched(docs, PATH, public_tokenizers.PATTERN, 32, 16).collect()}
    assert got[0] == coder.encode(texts[0]) and got[1] is None
    assert all(ids is None or ids == coder.encode(texts[k]) for k, ids in got.items())
    ends = {r.doc_id: tuple(r)[1:] for r in round_trip(docs, PATH, public_tokenizers.PATTERN, 32, 16).collect()}
    assert ends == {k: wanted(coder, t) for k, t in enumerate(texts)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_decoding_joins_bytes(coder):
    for text in ("😀é\u0000 日本", "plain"):
        assert coder.decode(coder.encode(text)) == text.encode()


def test_documents(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in round_trip(docs, PATH, public_tokenizers.PATTERN, 900, 200).collect()}
    assert got == {r.doc_id: wanted(coder, r.text) for r in docs.select("doc_id", "text").collect()}
