"""Benchmark decontamination: a BM25 index of test items with block maxima, asked by every passage of every text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.prints import joined_bytes, run_hashes, text_shingles, word_hashes
from tonewheel.llm.shared import frugal, maybe_broadcast
from tonewheel.session import settle

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: Items of one index: its dense block maxima stay below some tens of megabytes. More items make more indexes.
SHARD_ITEMS = 2_048
SHINGLE = 5
TEXTS_BYTES = 1 << 18
#: Block maxima, or their sums, that a worker holds at a time.
CELLS = 1 << 19
# Ends of sentences.
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Index:
    """One shard: per term its impact on each item over the item's own score, and the greatest of each block of items.

    An item asked for its own text scores 1, so one threshold fits items of any length.
    """

    ids: np.ndarray
    terms: np.ndarray
    impact: np.ndarray
    block_max: np.ndarray
    window: int
    question: list[np.ndarray]
    answer: list[np.ndarray]


def halves(text: str) -> tuple[str, str]:
    """Question and answer of an item: all but the last sentence, and the last; of a single sentence the last third."""
    parts = [p for p in SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def letters(texts: pa.Array) -> pa.Array:
    """Texts in lower case in which ASCII characters other than letters and digits are blanks: punctuation parts no words."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ")


def built(ids: list[int], texts: list[str], counted: tuple[int, dict[int, int], float]) -> Index:
    """``counted``: items in all shards, items by term, and the mean number of words."""
    total, by_term, mean = counted
    words, _, _, bounds = word_hashes(*joined_bytes(letters(pa.array(texts))))
    length = np.diff(bounds)
    order = np.argsort(length, kind="stable")  # blocks of alike items have tight maxima
    terms = np.unique(words)
    impact = np.zeros((len(terms), len(ids)), dtype=np.float32)
    for place, item in enumerate(order):
        own, times = np.unique(words[bounds[item]: bounds[item + 1]], return_counts=True)
        held = np.array([by_term[int(t)] for t in own.tolist()])
        idf = np.log1p((total - held + 0.5) / (held + 0.5))
        score = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * length[item] / mean))
        impact[np.searchsorted(terms, own), place] = score / max(score.sum(), 1e-9)
    block_max = np.maximum.reduceat(impact, np.arange(0, max(len(ids), 1), BLOCK_ITEMS), axis=1)
    sides = [halves(texts[k]) for k in order]
    question, answer = (
        [np.unique(s) for s in text_shingles(letters(pa.array([s[k] for s in sides], pa.string())), SHINGLE)] for k in (0, 1)
    )
    return Index(
        np.array(ids)[order], terms, impact, block_max, int(2 * max(length.max(), 16)), question, answer
    )


def _counted_words(items: DataFrame) -> DataFrame:
    """``word, held, said``: in how many items a word is; the row without a word counts the items and all their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, _, bounds = word_hashes(*joined_bytes(letters(batch.column(0))))
            own = [np.unique(words[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            full = sum(len(o) > 0 for o in own)
            terms, times = np.unique(np.concatenate(own), return_counts=True) if own else (words, words.astype(np.int64))
            yield pa.record_batch([
                pa.array([None, *terms.view(np.int64).tolist()], pa.int64()), pa.array([full, *times.tolist()], pa.int64()),
                pa.array([len(words), *[0] * len(terms)], pa.int64()),
            ], names=["word", "held", "said"])

    made = items.select("text").mapInArrow(frugal(run), "word long, held long, said long")
    return made.groupBy("word").agg(F.sum("held").alias("held"), F.sum("said").alias("said"))


def indexes(items: DataFrame) -> Iterator[Index]:
    """The index of all items, a shard of about SHARD_ITEMS at a time, so that the driver never holds more than one.

    Items are dealt by a hash; words are counted over all shards, and only a shard's own words are fetched with it.
    """
    rows = items.filter("item_id is not null and length(trim(text)) > 0").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = settle(rows)
    every = settle(_counted_words(rows))
    total = every.filter("word is null").first()
    count, said = (total["held"], total["said"]) if total else (0, 0)
    shards = -(-count // SHARD_ITEMS)
    for shard in range(shards):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        held = mine.toArrow().to_pydict()
        order = sorted(range(len(held["item_id"])), key=lambda k: (held["item_id"][k], held["text"][k]))
        ids, texts = ([held[c][k] for k in order] for c in ("item_id", "text"))
        _, _, _, bounds = word_hashes(*joined_bytes(letters(pa.array(texts, pa.string()))))
        full = np.flatnonzero(np.diff(bounds) > 0).tolist()
        if full:
            terms = every.join(_counted_words(mine).select("word"), "word", "left_semi").select("word", "held").toArrow()
            words = terms.column("word").to_numpy().view(np.uint64).tolist()
            by_term = dict(zip(words, terms.column("held").to_pylist(), strict=True))
            yield built([ids[k] for k in full], [texts[k] for k in full], (count, by_term, said / count))


def _half_sums(block_max: np.ndarray, place: np.ndarray, half_of: np.ndarray, halves: int) -> np.ndarray:
    """Block maxima added up over the words of each half window, CELLS of them at a time."""
    sums = np.zeros((halves, block_max.shape[1]), dtype=np.float64)
    step = max(1, CELLS // block_max.shape[1])
    for lo in range(0, len(place), step):
        own = half_of[lo: lo + step]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(block_max[place[lo: lo + step]], first, axis=0, dtype=np.float64)
    return sums


def _answers(index: Index, words: np.ndarray, bounds: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """``text, item, score`` of all passages at or over the threshold, the best passage of each text and item.

    Passages are windows of twice the longest item's words, half a window apart, so every item that a text holds lies
    whole in one. First the block maxima of a passage's words are added up for many passages and all blocks at once, an
    upper bound of every item in the block; only blocks over the threshold have their items scored. Memory is a few
    numbers a word and a bounded part, whatever the number of blocks.
    """
    place = np.searchsorted(index.terms, words)
    place[place == len(index.terms)] = 0
    at = np.flatnonzero(index.terms[place] == words)
    if not len(at):
        return []
    place = place[at]
    half = index.window // 2
    length = np.diff(bounds)
    count = np.where(length > 0, np.maximum(1, -(-(length - half) // half)), 0)
    text = np.repeat(np.arange(len(length)), count)
    # a text has one half window more than passages: a passage is a half window and the next
    begin = np.cumsum(count + (count > 0)) - count - (count > 0)
    owner = np.searchsorted(bounds, at, side="right") - 1
    half_of = begin[owner] + (at - bounds[owner]) // half
    first_half = np.arange(len(text)) + np.cumsum(count > 0)[text] - 1
    lo, hi = np.searchsorted(half_of, first_half), np.searchsorted(half_of, first_half + 2)
    best: dict[tuple[int, int], float] = {}
    step = max(1, CELLS // index.block_max.shape[1])
    for begun in range(0, len(text), step):
        mine = first_half[begun: begun + step]
        a, b = lo[begun], hi[min(begun + step, len(text)) - 1]
        sums = _half_sums(index.block_max, place[a:b], half_of[a:b] - mine[0], mine[-1] - mine[0] + 2)
        passage, block = np.nonzero(sums[mine - mine[0]] + sums[mine - mine[0] + 1] >= threshold - 1e-6)
        for p in np.unique(passage).tolist():
            asked = np.unique(place[lo[begun + p]: hi[begun + p]])
            for k0 in (block[slice(*np.searchsorted(passage, (p, p + 1)))] * BLOCK_ITEMS).tolist():
                scores = index.impact[asked, k0: k0 + BLOCK_ITEMS].sum(axis=0)
                for k in np.flatnonzero(scores >= threshold).tolist():
                    key = int(text[begun + p]), k0 + k
                    best[key] = max(best.get(key, 0.0), float(scores[k]))
    return [(t, k, s) for (t, k), s in best.items()]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every document that holds a test item.

    A document is reported with an item if one of its passages scores at least ``threshold`` of the item's own BM25
    score and the document holds at least ``overlap`` of the shingles of five words of both the item's question and its
    answer (a side shorter than five words is one shingle and is looked for as that run of words).
    Documents with a null doc_id cannot be named and are not reported; null and blank texts and items match nothing;
    repeated rows give one row; no documents or no items give no rows. Other columns are not read.

    Each task holds an index shard of bounded size and passes over its rows once; nothing of the documents is shuffled
    but the findings. More items than a shard holds are asked shard by shard, one after the other: the findings of each
    are written before the next index is made, so memory doesn't grow with the benchmark, but the passes do.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        "doc_id is not null and text is not null"
    )
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def asked(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for part in _parts(batch):
                    texts = letters(part.column(1))
                    words, _, _, bounds = word_hashes(*joined_bytes(texts))
                    found = _answers(index, words, bounds, threshold)
                    for t, k, score in found:
                        sides = [index.question[k], index.answer[k]]
                        there = [np.zeros(len(side), dtype=bool) for side in sides]
                        for size in range(1, SHINGLE + 1):
                            runs = run_hashes(words[bounds[t]: bounds[t + 1]], size, SHINGLE)
                            there = [known | np.isin(side, runs) for side, known in zip(sides, there, strict=True)]
                        held = [float(known.mean()) if len(known) else 1.0 for known in there]
                        if min(held) >= overlap:
                            out.append((part.column(0)[t].as_py(), int(index.ids[k]), score, *held))
                yield pa.record_batch(
                    [pa.array([o[k] for o in out], type=pa.int64() if k < 2 else pa.float64()) for k in range(5)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        return rows.mapInArrow(frugal(run), schema)

    found = None
    for index in indexes(items):
        one = settle(asked(index))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        *[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about TEXTS_BYTES of text, or one longer text."""
    import pyarrow.compute as pc

    sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()])
    row = 0
    while row < batch.num_rows:
        upto = max(row + 1, int(np.searchsorted(sizes, sizes[row] + TEXTS_BYTES, side="right")) - 1)
        yield batch.slice(row, upto - row)
        row = upto


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a test item; documents without an id stay."""
    gone = settle(leaks(docs, items).select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(maybe_broadcast(gone), docs["doc_id"] == F.col("_leak"), "left_anti")
