"""Signals as stored blocks: no row holds more than a block, whatever the length of the signal.

A block table has the key columns, ``start`` (place of the first sample), ``n`` (samples of the whole signal), ``rate``
(samples a second) and ``x``. Blocks of a signal lie end to end. Windows are cut where they lie; only the parts of
windows that cross a border are shuffled. Resampling is linear, so each block is resampled by itself and the few outputs
that two blocks reach are added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewheel.functions import spectral
from tonewheel.operators.features import _lists
from tonewheel.operators.knn import matrix

BLOCK = 1 << 16
FACTS = ["start", "n", "rate", "x"]


def blocks_of_arrays(signals: DataFrame, keys: Sequence[str], rate: str, x: str = "x", size: int = BLOCK) -> DataFrame:
    """Rows that hold a signal each, cut into blocks. A null or empty signal has no block."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0)))
    parts = F.transform(starts, lambda b: F.struct(
        (b.cast("long") * size).alias("start"), F.slice(F.transform(x, lambda v: v.cast("double")), b * size + 1, F.lit(size)).alias("x")))
    cut = signals.filter(F.size(x) > 0).select(*keys, F.col(rate).cast("int").alias("rate"), F.size(x).cast("long").alias("n"), F.explode(parts).alias("_p"))
    return cut.select(*keys, F.col("_p.start").alias("start"), "n", "rate", F.col("_p.x").alias("x"))


def blocks_of_samples(
    samples: DataFrame, keys: Sequence[str], rate: Column, value: str = "value", pos: str = "pos", count: str = "pos_n", size: int = BLOCK
) -> DataFrame:
    """One row per sample (place from 0, and the signal's count) folded into blocks: one group a block, never a signal."""
    first = F.floor(F.col(pos) / size) * size
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).cast("double").alias("v"))))
    made = samples.groupBy(*keys, first.alias("start")).agg(F.max(count).alias("n"), F.max(rate).cast("int").alias("rate"), rows.alias("_r"))
    return made.select(*keys, "start", "n", "rate", F.transform("_r", lambda r: r["v"]).alias("x"))


def reblocked(blocks: DataFrame, keys: Sequence[str], size: int = BLOCK) -> DataFrame:
    """Pieces of any size laid out anew on the grid of blocks."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("x") - 1) / size)

    def part(b: Column) -> Column:
        low, high = F.greatest(b * size, F.col("start")), F.least((b + 1) * size, F.col("start") + F.size("x"))
        return F.struct(b.alias("b"), low.alias("at"), F.slice("x", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("x"))

    cut = blocks.filter("size(x) > 0").select(*keys, "n", "rate", F.explode(F.transform(F.sequence(first, last), part)).alias("_p"))
    whole = cut.groupBy(*keys, F.col("_p.b").alias("_b")).agg(
        F.max("n").alias("n"), F.max("rate").alias("rate"), F.array_sort(F.collect_list(F.struct("_p.at", "_p.x"))).alias("_r"))
    return whole.select(*keys, (F.col("_b") * size).alias("start"), "n", "rate", F.flatten(F.transform("_r", lambda r: r["x"])).alias("x"))


def windows_of_blocks(blocks: DataFrame, keys: Sequence[str], win: int, hop: int) -> DataFrame:
    """``(keys, seg, offset, n, x)``: the sliding windows of every signal, as samples, not centred or padded.

    The windows are those of ``segments.sliding_offsets``: every ``hop``, and one right-aligned if the rest is at least
    5 % of a window; a signal shorter than a window is one window. A window inside a block is cut there. One that
    crosses a border is put together from its parts, which are all that is shuffled. Reads ``blocks`` twice, so give it
    a stored table.
    """
    n, start, end = F.col("n"), F.col("start"), F.col("start") + F.size("x")
    last = F.greatest(F.floor((n - win) / F.lit(hop)), F.lit(0))
    low = F.greatest(F.floor((start - win) / F.lit(hop)) + 1, F.lit(0))
    high = F.least(F.floor((end - 1) / F.lit(hop)), last)
    none = F.array().cast("array<struct<seg:bigint,offset:bigint>>")

    def seg(i: Column, offset: Column) -> Column:
        return F.struct(i.cast("bigint").alias("seg"), offset.cast("bigint").alias("offset"))

    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(high, low)), lambda i: seg(i, i * hop))).otherwise(none)
    has_rest = (n > win) & ((last + 1) * hop + 0.05 * win <= n) & (end > n - win)
    rest = F.when(has_rest, F.array(seg(last + 1, n - win))).otherwise(none)

    def part(w: Column) -> Column:
        begin, stop = F.greatest(w["offset"], start), F.least(w["offset"] + win, end)
        return F.struct(
            w["seg"].alias("seg"), w["offset"].alias("offset"), begin.alias("at"),
            F.slice("x", (begin - start + 1).cast("int"), (stop - begin).cast("int")).alias("x"),
        )

    parts = blocks.filter("size(x) > 0").select(*keys, "n", F.explode(F.transform(F.concat(regular, rest), part)).alias("_w")).select(*keys, "n", "_w.*")
    full = F.size("x") == F.least(F.lit(win), n)
    across = parts.filter(~full).groupBy(*keys, "seg", "offset").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("_r")
    ).select(*keys, "seg", "offset", "n", F.flatten(F.transform("_r", lambda r: r["x"])).alias("x"))
    return parts.filter(full).select(*keys, "seg", "offset", "n", "x").unionByName(across)


def _steps(rate: int, target: int) -> tuple[int, int, int]:
    """Rates without their common divisor, and how many samples away from its time an output can see."""
    common = gcd(rate, target)
    rate, target = rate // common, target // common
    return rate, target, ceil(spectral.ZEROS * rate / (min(rate, target) * spectral.ROLLOFF))


def _border(at: int, n: int, rate: int, target: int, reach: int) -> tuple[int, int]:
    """Outputs that may see samples on both sides of a border; none at the ends of the signal."""
    out = -(-n * target // rate)
    if at <= 0 or at >= n:
        return (0, 0) if at <= 0 else (out, out)
    return max(0, (at - reach) * target // rate), min(out, (at + reach) * target // rate + 1)


def resampled_pieces(x: np.ndarray, starts: np.ndarray, counts: np.ndarray, rate: int, target: int, decimate: bool) -> list[tuple[int, int, bool, np.ndarray]]:
    """``(row, start, shared, samples)`` of equally long blocks of one rate: final outputs, and shares of border outputs.

    With ``decimate`` every k-th sample is taken where the rate is a multiple of the target; else, and for all other
    rates, the band-limited resampler is used.
    """
    size, out = x.shape[1], []
    if rate == target:
        return [(k, int(s), False, x[k]) for k, s in enumerate(starts)]
    if decimate and rate % target == 0:
        step = rate // target
        return [(k, -(-int(s) // step), False, x[k, -int(s) % step:: step]) for k, s in enumerate(starts)]
    down, up, reach = _steps(rate, target)
    begin = np.maximum((starts - reach) // down, 0) * down
    lead = starts - begin
    for ahead in np.unique(lead):  # blocks at one phase of the two rates are one matrix
        rows = np.flatnonzero(lead == ahead)
        wide = np.concatenate([np.zeros((len(rows), int(ahead))), x[rows], np.zeros((len(rows), reach + 2 * down))], axis=1)
        made = spectral.resample(wide, rate, target)
        for row, y in zip(rows.tolist(), made, strict=True):
            s, n, first = int(starts[row]), int(counts[row]), int(begin[row]) // down * up
            (a, b), (c, d) = (_border(at, n, down, up, reach) for at in (s, s + size))
            if s > 0 and s + size < n and b > c:
                raise ValueError(f"blocks of {size} samples are shorter than the filter of {rate} to {target}: lay out larger ones")
            c = max(c, b)
            parts = [(a, b, True), (b, c, False), (c, d, True)] if s + size < n else [(a, b, True), (b, c, False)]
            out += [(row, lo, shared, y[lo - first: hi - first]) for lo, hi, shared in parts if hi > lo]
    return out


def resampled_blocks(blocks: DataFrame, keys: Sequence[str], target: int, decimate: bool = False) -> DataFrame:
    """Every signal at ``target`` samples a second, whatever its ``rate``; a task groups its blocks by rate and length.

    ``decimate`` takes every k-th sample of signals whose rate is a multiple of the target and falls back to the
    band-limited resampler for the others. Signals at the target rate pass. Outputs near a border of two blocks see both:
    each block gives its share, and only these shares are shuffled and added. The rows are pieces of unequal size
    (``reblocked`` lays them out evenly). Rates that are null or not positive have no samples; see
    ``segments.split_empty``. Blocks inside a signal must be longer than twice the filter's reach.
    """
    keys = list(keys)
    fields = blocks.select(*keys).schema.fields
    kinds = [*fields, T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("rate", T.IntegerType()),
             T.StructField("shared", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rate, size = rows["rate"].to_numpy(), np.asarray(rows["x"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False), np.int64)
            for r, m in sorted(set(zip(rate.tolist(), size.tolist(), strict=True))):
                part = rows.take(pa.array(np.flatnonzero((rate == r) & (size == m))))
                n = part["n"].to_numpy()
                found = resampled_pieces(matrix(part["x"]), part["start"].to_numpy(), n, r, target, decimate)
                if not found:
                    continue
                row = np.array([f[0] for f in found])
                down, up, _ = _steps(r, target)
                values = [f[3] for f in found]
                ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *[part[k].combine_chunks().take(pa.array(row)) for k in keys], pa.array([f[1] for f in found], pa.int64()),
                    pa.array(-(-n[row] * up // down), pa.int64()), pa.array(np.full(len(row), target, np.int32)),
                    pa.array([f[2] for f in found], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values))),
                ], [*keys, "start", "n", "rate", "shared", "x"])

    used = blocks.filter("rate > 0 and size(x) > 0").select(*keys, *FACTS)
    made = used.mapInArrow(run, T.StructType(kinds))
    total = F.aggregate(F.slice("_s", 2, 2), F.element_at("_s", 1), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    borders = made.filter("shared").groupBy(*keys, "start").agg(
        F.max("n").alias("n"), F.max("rate").alias("rate"), F.collect_list("x").alias("_s")).select(*keys, "start", "n", "rate", total.alias("x"))
    return made.filter("not shared").select(*keys, *FACTS).unionByName(borders)
