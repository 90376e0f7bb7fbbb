"""Word and shingle hashes of whole texts, a block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BLANKS = (9, 10, 11, 12, 13, 32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE_VALUE = _stream(256, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[list(BLANKS)] = True


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry than texts). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def _blocks(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about a megabyte that end after a blank or where a text ends."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + BLOCK_BYTES, n)
        while hi < n:
            following = starts[np.searchsorted(starts, hi)]
            step = data[hi - 1: min(hi + 4095, following)]
            blank = np.flatnonzero(IS_BLANK[step])
            if following == hi or len(blank):
                hi += 0 if following == hi else int(blank[0])
                break
            hi = int(min(hi + 4096, following))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word (no blank in it, A-Z in lower case): hash, first byte, end byte; and each text's first word."""
    hashes, firsts, ends = [], [], []
    for lo, hi in _blocks(data, starts):
        block = LOWER[data[lo:hi]]
        cut = np.zeros(hi - lo + 1, dtype=bool)
        inner = starts[np.searchsorted(starts, lo): np.searchsorted(starts, hi, side="right")] - lo
        cut[inner] = True
        cut[0] = cut[-1] = True
        full = ~IS_BLANK[block]
        begins = full.copy()
        begins[1:] &= ~full[:-1] | cut[1:-1]
        first = np.flatnonzero(begins)
        if not len(first):
            continue
        last = full.copy()
        last[:-1] &= ~full[1:] | cut[1:-1]
        end = np.flatnonzero(last) + 1
        at = np.flatnonzero(full)
        length = end - first
        begin_at = np.cumsum(length) - length
        place = np.arange(len(at)) - np.repeat(begin_at, length)
        with np.errstate(over="ignore"):
            value = BYTE_VALUE[block[at]] * _stream(int(length.max()), 977)[place]
            hashes.append(mixed(np.add.reduceat(value, begin_at) + length.astype(np.uint64)))
        firsts.append(first + lo)
        ends.append(end + lo)
    if not hashes:
        zero = np.zeros(0, dtype=np.int64)
        return zero.astype(np.uint64), zero, zero, np.zeros(len(starts), dtype=np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, starts)


def run_hashes(words: np.ndarray, run: int, size: int) -> np.ndarray:
    """Of every run of ``run`` words, as the whole of a text that has fewer words than ``size`` is hashed."""
    weight = _stream(size, 5003)
    with np.errstate(over="ignore"):
        total = np.full(max(len(words) - run + 1, 0), 0 if run == size else 7919 * run, dtype=np.uint64)
        for k in range(run if len(total) else 0):
            total += words[k: len(words) - run + 1 + k] * weight[k]
    return mixed(total)


def text_shingles(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text: the hash of every run of ``size`` words; of the whole sequence if it has fewer; none without words."""
    data, starts = joined_bytes(texts)
    row = 0
    while row < len(starts) - 1:  # texts of about four megabytes at a time
        upto = max(row + 1, int(np.searchsorted(starts, starts[row] + 4 * BLOCK_BYTES, side="right")) - 1)
        words, _, _, bounds = word_hashes(data[starts[row]: starts[upto]], starts[row: upto + 1] - starts[row])
        runs = run_hashes(words, size, size)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b == a:
                yield words[:0]
            else:
                yield runs[a: b - size + 1] if b - a >= size else run_hashes(words[a:b], b - a, size)
        row = upto
