"""Edit-aware token counts: a segment tree of pre-tokens per text; an edit re-encodes only what it touches."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.bpe import Codec, codec

#: Pieces of a leaf, at first; and code points that are split at a time when looking for common ground.
LEAF, STRIDE = 64, 256
#: A piece owes nothing to what lies this far behind its end: the pattern looks ahead no farther.
REACH = 2


class CountTree:
    """Piece lengths and token counts in leaves, their sums in a binary tree above."""

    def __init__(self, coder: Codec, text: str):
        self.coder, self.text, self.encoded = coder, text, 0
        sizes, counts = self._pieces(text)
        self.pieces = len(sizes)
        self.leaves = [[sizes[k: k + LEAF], counts[k: k + LEAF]] for k in range(0, len(sizes), LEAF)] or [[[], []]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.base)
        for k, (a, b) in enumerate(self.leaves):
            self.sums[self.base + k] = sum(a), sum(b)
        for k in range(self.base - 1, 0, -1):
            self.sums[k] = self._both(k)
        self.encoded = 0

    def _both(self, k: int) -> tuple[int, int]:
        (a, b), (c, d) = self.sums[2 * k], self.sums[2 * k + 1]
        return a + c, b + d

    def _pieces(self, text: str) -> tuple[list[int], list[int]]:
        found = [m[0] for m in self.coder.find(text)]
        self.encoded += len(found)
        return list(map(len, found)), [self.coder.count(p) for p in found]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and where it begins."""
        k, begin = 1, 0
        while k < self.base:
            k *= 2
            if place >= begin + self.sums[k][0] and self.sums[k + 1][0]:
                begin += self.sums[k][0]
                k += 1
        return k - self.base, begin

    def _set(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = [sizes, counts]
        k = self.base + leaf
        self.sums[k] = sum(sizes), sum(counts)
        while k > 1:
            k //= 2
            self.sums[k] = self._both(k)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replaces code points [start, end) (cut to the text) and updates the sums on the way to the root.

        Splitting begins at the last piece that cannot owe itself to the edited places and stops at the first old piece
        beginning behind them at which a new piece begins too: from there on both splits are alike.
        """
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        old_size, shift = len(self.text), len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        first, begin = self._leaf_at(max(0, start - REACH))
        if first:  # a leaf more of context, so that a piece begins far enough before
            first, begin = self._leaf_at(max(0, begin - 1))
        last, tail = self._leaf_at(end)
        while True:
            stop = tail + self.sums[self.base + last][0]
            sizes = [s for leaf in self.leaves[first: last + 1] for s in leaf[0]]
            counts = [c for leaf in self.leaves[first: last + 1] for c in leaf[1]]
            ends = list(accumulate(sizes, initial=begin))
            keep = max(0, bisect_right(ends, start - REACH) - 1)
            from_ = ends[keep]
            wanted = {e + shift: k for k, e in enumerate(ends) if e >= end}
            met, fresh, at = None, [], from_
            for m in self.coder.find(self.text, from_):
                if m.start() in wanted and (m.start() < stop + shift or stop == old_size):
                    met = wanted[m.start()]
                    break
                if m.start() >= stop + shift:
                    break
                fresh.append(m[0])
                at = m.end()
            if met is None and at == len(self.text) and stop == old_size:
                met = len(sizes)
            if met is not None:
                break
            if last + 1 < len(self.leaves):
                tail, last = stop, last + 1
            elif stop == old_size:
                met = len(sizes)
                break
        self.encoded += len(fresh)
        self.pieces += len(fresh) - (met - keep)
        self._set(first, sizes[:keep] + list(map(len, fresh)) + sizes[met:], counts[:keep] + [self.coder.count(p) for p in fresh] + counts[met:])
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [], [])


def edited_counts(docs: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """Token counts before and after the edits of each row of ``docs`` (``doc_id``, ``text``).

    ``edits`` is an ``array<struct<start:int,end:int,put:string>>`` column, applied in order; each edit's places are
    code points of the text as the edits before left it. Returns ``doc_id, n_tokens, n_tokens_edited, n_pieces,
    n_reencoded``: counts of the vocabulary without special tokens, pre-tokens after the edits, and how many pre-tokens
    the edits had encoded again. Null texts count as empty, null edits as none, null places as nothing to do; a null
    ``put`` deletes. Texts that the pattern library splits by another Unicode table than the coder are counted whole.
    Rows come back as often as they come in; other columns are not read; no rows give no rows. Map-only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(1), batch.column(2), strict=True):
                text, changes = text.as_py(), [c for c in changes.as_py() or [] if c and c["start"] is not None and c["end"] is not None]
                tree = CountTree(coder, text)
                before = tree.tokens
                for c in changes:
                    tree.edit(c["start"], c["end"], c["put"] or "")
                if coder.pieces_known(text) and coder.pieces_known(tree.text):
                    out.append((before, tree.tokens, tree.pieces, tree.encoded))
                else:
                    out.append((len(coder.encode(text)), len(coder.encode(tree.text)), tree.pieces, tree.pieces))
            columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_reencoded long")


def sample_edits(text: Column) -> Column:
    """Three edits for each text: a word put in at the middle, ten code points out at three quarters, a new first line."""
    size = F.char_length(F.coalesce(text, F.lit("")))

    def one(start: Column, end: Column, put: str) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(put).alias("put"))

    return F.array(
        one(F.floor(size / 2), F.floor(size / 2), " [edited]"), one(F.floor(size * 3 / 4), F.floor(size * 3 / 4) + 10, ""),
        one(F.lit(0), F.lit(0), "Revised.\n"),
    )
