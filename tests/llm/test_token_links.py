import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tonewheel.llm import token_links as module
from tonewheel.llm.token_links import Csr, Pair, aligned, overlap_links, row_products, row_sizes, units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "a", "  two  spaces  ", "\n\nline\r\n\tx ", "<|endoftext|> <s> </s> <unk>", "a▁b", "▁", "日本語 の 文 です", "naïve café ½ × ÷",
    "a" * 3000, "🙂🙂 🙂", "\x00 \x01", "I'll we've can't 's", "x " * 50, "ﬁ Å", "a b 　 c", "1234567 8,9", "  ", "end ", " .", "a  b c   d",
]


@pytest.fixture(scope="module")
def pair():
    return Pair(A, B)


def brute(texts):
    """From the two libraries and byte offsets alone."""
    p = Pair(A, B)
    spans = []
    for text in texts:
        a = p.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.b.encode(text) if text else []
        if text and not (b"".join(p.bytes_a[i] for i in a) == (" " + text).encode() == b"".join(p.bytes_b[i] for i in b)):
            a, b = [], []
        ends = [np.cumsum([len(by[i]) for i in ids]).astype(int).tolist() for ids, by in ((a, p.bytes_a), (b, p.bytes_b))]
        links, j = [], 0
        for i, e in enumerate(ends[0]):
            s = ends[0][i - 1] if i else 0
            while j and (ends[1][j - 1] > s):
                j -= 1
            while ends[1][j] <= s:
                j += 1
            k = j
            while k < len(b) and (ends[1][k - 1] if k else 0) < e:
                links.append((a[i], b[k]))
                k += 1
        both = sorted(set(ends[0]) & set(ends[1]))
        at = {e: k for k, e in enumerate(both)}
        groups = [([], []) for _ in both]
        for side, (ids, stops) in enumerate(((a, ends[0]), (b, ends[1]))):
            k = 0
            for i, e in zip(ids, stops):
                groups[k][side].append(i)
                k += e in at
        spans.append((a, b, groups, links))
    count = Counter(x for s in spans for x in s[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for a, b, groups, links in spans:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(count[x] == top[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


def test_products_agree_with_dense_ones():
    draw = np.random.default_rng(3)
    for block in (1, 7, 1000):
        x, y = (draw.integers(0, 3, s) * (draw.random(s) < 0.3) for s in ((9, 14), (14, 11)))
        def csr(m):
            return Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], m.shape[1])
        dense = np.zeros((9, 11), int)
        for r, c, v in row_products(csr(x), csr(y), block):
            dense[r, c] = v
        assert (dense == x @ y).all()
        back = csr(x).transposed()
        assert (back.indptr == csr(x.T).indptr).all() and (back.indices == csr(x.T).indices).all()
    one = Csr.members(np.array([0, 0, 1, 2]), 3)
    assert row_sizes(one, Csr.members(np.array([0, 1, 1, 2]), 3).transposed()).tolist() == [1, 1, 2, 1]


def test_documents_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "some text"), (5, "some text"), (5, "some text")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, a int, n string").repartition(3)
    got = sorted((tuple(r) for r in aligned(frame, A, B).select(*COLUMNS).collect()), key=str)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute([t for _, t in rows]))), key=str)


def test_segments_agree_with_whole_texts(pair):
    draw = random.Random(2)
    bits = ["a", "Word", " ", "  ", "\n", "'s", "é", "日", "▁", "9", ".", "!?", "the", "\t", "ß", " ", "<s>", "🙂"]
    for _ in range(400):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 60)))
        a, b = pair.tokens([text])
        pieces = pair.tokens(module.CUT.split(text))
        assert a[0] == [i for x in pieces[0] for i in x] and b[0] == [i for x in pieces[1] for i in x]


def test_long_texts_and_little_memory(spark, monkeypatch, pair):
    text = "many words of one kind, then others. " * 4000
    truth = brute([text, text + "x"])
    monkeypatch.setattr(module, "UNIT", 1000)
    monkeypatch.setattr(module, "MEMORY", 3)
    assert " ".join(units(text)) == text
    small = Pair(A, B)
    for whole, want in zip([text, text + "x"], truth):
        told = module.Told()
        for unit in units(whole):
            module._take_in(small, [(told, module.CUT.split(unit))])
        row = told.row()
        assert row[:5] == want[:5] and row[5] == want[7] and sum(row[8]) == want[3]


def test_links_with_places(spark):
    frame = spark.createDataFrame([(1, "naïve tokens 日本"), (2, None), (3, "a▁b")], "doc_id long, text string")
    links = overlap_links(frame, A, B).collect()
    p = Pair(A, B)
    assert {r.doc_id for r in links} == {1}
    assert sum(r.n_bytes for r in links) == len(" naïve tokens 日本".encode())
    a, b = p.tokens(["naïve tokens 日本"])
    assert all(a[0][r.a_place] == r.a_id and b[0][r.b_place] == r.b_id for r in links)
    assert len(links) == brute(["naïve tokens 日本"])[0][3] and max(r.grp for r in links) + 1 == brute(["naïve tokens 日本"])[0][2]


def test_no_rows(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
