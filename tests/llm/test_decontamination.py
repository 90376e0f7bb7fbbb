import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tonewheel.llm import decontamination
from tonewheel.llm.decontamination import leaks, without_leaks


def plain(text):
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def test_whole_items_are_found_and_nothing_else(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = {(i, r.item_id) for r in items.collect() for i, t in texts if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == want and want
    assert without_leaks(docs, items).count() == docs.count() - len({i for i, _ in want})


def test_question_alone_is_no_leak_and_odd_rows_say_nothing(spark):
    question = "which of these old rivers runs through seven large towns and two small ones"
    answer = "the slow green one that turns twice."
    items = spark.createDataFrame([(1, f"{question}? {answer}"), (2, None), (3, " "), (None, "lost item here"), (1, f"{question}? {answer}")], "item_id long, text string")
    rows = [(1, f"Pad words. {question}? {answer} More."), (2, f"{question}?"), (3, None), (4, ""), (None, f"{question}? {answer}"), (5, ("filler word " * 3000) + f"{question}, {answer}")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items).collect()) == [(1, 1), (5, 1)]
    assert leaks(docs, items.limit(0)).collect() == [] and leaks(docs.limit(0), items).collect() == []


def test_shards_find_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {tuple(r) for r in leaks(docs, items).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 7)
    assert {tuple(r) for r in leaks(docs, items).select("doc_id", "item_id").collect()} == one and one


def test_memory_is_bounded_for_many_blocks_and_long_texts(monkeypatch):
    draw = np.random.default_rng(5)
    items = [" ".join(f"w{k}" for k in draw.integers(0, 3000, draw.integers(5, 40))) for _ in range(800)]
    texts = ["", "w1 " * 3, " ".join(f"w{k}" for k in draw.integers(0, 3000, 60_000)) + " " + items[7], "none known", f"{items[1]} x {items[2]}", items[3]]

    def hashed(texts):
        words, _, _, bounds = decontamination.word_hashes(*decontamination.joined_bytes(decontamination.letters(pa.array(texts))))
        return words, bounds

    words, bounds = hashed(items)
    said = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    held = dict(zip(*map(np.ndarray.tolist, np.unique(np.concatenate(said), return_counts=True)), strict=True))
    index = decontamination.built(list(range(800)), items, (800, held, len(words) / 800))
    words, bounds = hashed(texts)
    tracemalloc.start()
    try:
        found = decontamination._answers(index, words, bounds, 0.6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want, half = {}, index.window // 2
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for lo in range(a, max(b - half, min(a + 1, b)), half):
            known = np.isin(index.terms, words[lo: min(lo + index.window, b)])
            for k, score in enumerate(index.impact[known].sum(axis=0)):
                if score >= 0.6:
                    want[t, k] = max(want.get((t, k), 0.0), float(score))
    assert {(t, k) for t, k, _ in found} == set(want) and {(4, 1), (5, 3)} <= {(t, int(index.ids[k])) for t, k in want}
    assert all(abs(want[t, k] - score) < 1e-5 for t, k, score in found)
    assert peak < 30e6
    monkeypatch.setattr(decontamination, "CELLS", 700)  # strips and gathers of seven
    assert sorted(decontamination._answers(index, words, bounds, 0.6)) == sorted(found)
