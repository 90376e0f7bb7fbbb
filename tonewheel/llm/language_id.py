"""Language identification: TF-IDF vectors of letter n-grams against several clustered centroids of every language."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.shared import kept
from tonewheel.operators.skew import top_k
from tonewheel.session import settle

#: N-grams of one to so many letters are hashed into so many buckets (a power of two).
LONGEST, BUCKETS = 3, 1 << 14
#: Centroids of a language, and documents of a language that they are fitted on (drawn by a hash); document frequencies
#: and predictions read every document.
CENTROIDS, SAMPLE = 4, 1024
ROUNDS = 12
#: Share of a language's calibration documents that lie no farther from it than its limit.
WITHIN = 0.995
#: A model of more languages is refused: it would be over 500 MB.
MAX_LANGUAGES = 2000
#: Code points of a text that are looked at in one go.
PIECE = 1 << 20
UNKNOWN = "und"
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd numbers, one for each length


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower form if it is a letter or mark, else a space; and whether it is a letter."""
    lower, letter = np.full(0x110000, 32, np.uint64), np.zeros(0x110000, bool)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        if kind in "LM":
            lower[k], letter[k] = ord(chr(k).lower()[0]), kind == "L"
    return lower, letter


def gram_counts(text: str) -> np.ndarray | None:
    """How often n-grams fall into each bucket; None if the text has no letter.

    Letters in lower case; what lies between words is one space, which takes part in n-grams but is none itself. The
    text is read in pieces; the last letters of one stand before the next.
    """
    lower, letter = kept("letters", _letters)
    counts, tail, any_letter = np.zeros(BUCKETS, np.int64), np.array([32], np.uint64), False
    for start in range(0, len(text) + 1, PIECE):
        piece = text[start: start + PIECE]
        if start + PIECE >= len(text):
            piece += " "
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter = any_letter or bool(letter[points].any())
        codes = np.concatenate([tail, lower[points]])
        old = len(tail)
        apart = np.ones(len(codes), bool)
        apart[old:] = (codes[old:] != 32) | (codes[old - 1: -1] != 32)
        codes = codes[apart]
        for n in range(1, LONGEST + 1):
            ends = len(codes) - n + 1
            if ends <= 0:
                continue
            mixed = np.zeros(ends, np.uint64)
            for k in range(n):
                mixed = (mixed << np.uint64(21)) ^ codes[k: k + ends]
            # only those that end in this piece
            mixed = mixed[max(0, old - n + 1):]
            if n == 1:
                mixed = mixed[mixed != 32]
            bucket = ((mixed * np.uint64(SPREAD[n - 1])) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
            counts += np.bincount(bucket, minlength=BUCKETS)
        tail = codes[-(LONGEST - 1):]
    return counts if any_letter else None


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and entries of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    w = (1 + np.log(counts[at])) * idf[at]
    return at, w / np.linalg.norm(w)


@dataclass
class Model:
    """``centroids`` (one a row, of length one) with the language and the distance limit of each, languages in order."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    limits: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[int, float]:
        at, w = weights(counts, self.idf)
        near = w @ self.centroids.T[at]
        best = int(np.argmax(near))
        return best, float(min(max(near[best], 0.0), 1.0))


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length one by rounds of nearest-centroid means; begun at the mean and the farthest rows."""
    def unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size == 0, 1, size)

    at = unit(x.mean(0, keepdims=True))
    while len(at) < min(k, len(x)):
        near = (x @ at.T).max(1)
        if near.min() > 1 - 1e-6:  # no row unlike the centroids is left
            break
        at = np.vstack([at, x[np.argmin(near)]])
    for _ in range(ROUNDS):
        own = np.argmax(x @ at.T, 1)
        new = unit(np.vstack([x[own == c].mean(0) if (own == c).any() else at[c] for c in range(len(at))]))
        if np.abs(new - at).max() < 1e-7:
            break
        at = new
    return at[np.unique(np.argmax(x @ at.T, 1))]


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, tuple[int, int]]]:
    """Inverse document frequency of each bucket, and the documents and the least draw of each language, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, least = np.zeros(BUCKETS, np.int64), defaultdict(int), {}
        for batch in batches:
            for lang, text, draw in zip(*batch.columns, strict=True):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    found += counts > 0
                    docs[lang.as_py()] += 1
                    least[lang.as_py()] = min(draw.as_py(), least.get(lang.as_py(), draw.as_py()))
        at = np.flatnonzero(found)
        yield pa.record_batch([
            pa.array([None] * len(at) + list(docs), pa.string()), pa.array([*at.tolist(), *[None] * len(docs)], pa.int32()),
            pa.array([*found[at].tolist(), *docs.values()], pa.int64()), pa.array([None] * len(at) + [least[k] for k in docs], pa.int64()),
        ], names=["lang", "bucket", "n", "draw"])

    summed = settle(rows.select("lang", "text", "draw").mapInArrow(run, "lang string, bucket int, n long, draw long")
                    .groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.min("draw").alias("draw")))
    docs = {r.lang: (r.n, r.draw) for r in summed.filter("bucket is null").limit(MAX_LANGUAGES + 1).collect()}
    if len(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = np.zeros(BUCKETS)
    for r in summed.filter("bucket is not null").collect():  # a row for each bucket at most
        found[r.bucket] = r.n
    return np.log((1 + sum(n for n, _ in docs.values())) / (1 + found)) + 1, docs


def fit(docs: DataFrame, learn: Column, lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Centroids of every language of the rows that ``learn`` lets in; None if there is nothing to learn from.

    Rows without a language, without text or without a letter teach nothing. Document frequencies come from all other
    rows. The centroids of a language are clustered from about ``sample`` of its documents at most, drawn by a hash of
    the row, and its distance limit comes from every fourth of those, which the clusters don't see (from all, if there
    are fewer than eight). Repeated rows count as often as they come.
    """
    draw = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if kind in ("string", "bigint", "int")])
    rows = docs.filter(F.coalesce(learn, F.lit(False))).select(
        F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), draw.alias("draw")
    ).filter("lang is not null and text is not null")
    idf, known = _frequencies(rows)
    if not known:
        return None
    share = F.create_map(*[F.lit(x) for k, (n, _) in known.items() for x in (k, ceil(min(1.0, 1.2 * sample / n) * 1_000_003))])
    least = F.create_map(*[F.lit(x) for k, (_, d) in known.items() for x in (k, d)])
    # the least draw as well: with many copies of one row, no other may fall into the share
    drawn = rows.filter((F.pmod("draw", F.lit(1_000_003)) < F.element_at(share, F.col("lang"))) | (F.col("draw") == F.element_at(least, F.col("lang"))))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_counts(t.as_py()) for t in batch.column(1)]
            use = [k for k, c in enumerate(found) if c is not None]
            vectors = [weights(found[k], idf) for k in use]
            yield pa.record_batch([
                batch.column(0).take(pa.array(use, pa.int64())), batch.column(2).take(pa.array(use, pa.int64())),
                pa.array([a.astype(np.int32) for a, _ in vectors], pa.list_(pa.int32())),
                pa.array([w.astype(np.float32) for _, w in vectors], pa.list_(pa.float32())),
            ], names=["lang", "draw", "at", "w"])

    # the draw is over a share of the rows; copies of one row could still be many
    vectors = top_k(drawn.mapInArrow(entries, "lang string, draw long, at array<int>, w array<float>"),
                    ["lang"], [F.col("draw"), F.xxhash64("w")], sample)

    def cluster(group: pa.Table) -> pa.Table:
        order = group.sort_by([("rank", "ascending")])
        x = np.zeros((len(order), BUCKETS), np.float32)
        for k, (at, w) in enumerate(zip(order["at"], order["w"], strict=True)):
            x[k, at.values.to_numpy()] = w.values.to_numpy()
        held = np.arange(len(x)) % 4 == 3 if len(x) >= 8 else np.ones(len(x), bool)
        at = clustered(x[~held] if len(x) >= 8 else x, centroids)
        near = np.sort(1 - (x[held] @ at.T).max(1))
        limit = float(near[min(len(near) - 1, ceil(WITHIN * len(near)) - 1)])
        return pa.table({
            "lang": pa.array([order["lang"][0].as_py()] * len(at)), "place": pa.array(range(len(at)), pa.int32()),
            "limit": pa.array([limit] * len(at), pa.float64()), "at": pa.array(list(at.astype(np.float32)), pa.list_(pa.float32())),
        })

    found = vectors.groupBy("lang").applyInArrow(cluster, "lang string, place int, limit double, at array<float>")
    rows = sorted(settle(found).collect(), key=lambda r: (r.lang, r.place))  # a few rows a language
    return Model(idf, [r.lang for r in rows], np.array([r["at"] for r in rows], np.float64).reshape(-1, BUCKETS), np.array([r.limit for r in rows]))


def predict(docs: DataFrame, model: Model | None, keep: list[str | Column], reject: bool = False) -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score, rejected`` of every row; only ``text`` is looked at.

    ``lang_pred`` is the language of the nearest centroid by cosine and ``score`` that cosine (0 to 1). ``rejected`` says
    that the text lies farther off than the language's limit; with ``reject`` it then counts as unknown. A null text, a
    text without a letter, and any text if nothing was learnt, are ``und`` with score 0, not rejected. Equally near
    languages: the first by name. Rows come back as often as they come in; no rows give no rows. Map-only.
    """
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                counts = gram_counts(text.as_py()) if model and text.is_valid else None
                if counts is None:
                    out.append((UNKNOWN, 0.0, False))
                    continue
                best, near = model.nearest(counts)
                far = 1 - near > model.limits[best]
                out.append((UNKNOWN if far and reject else model.languages[best], near, bool(far)))
            lang, score, far = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                names=["_row", "lang_pred", "score", "rejected"],
            )

    made = rows.mapInArrow(run, f"_row {kind}, lang_pred string, score double, rejected boolean")
    return made.select("_row.*", "lang_pred", "score", "rejected")
