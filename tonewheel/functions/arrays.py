"""Signals, matrices and vectors as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a plain column expression inside a lambda runs per element."""
    return F.transform(F.array(value), body)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def deviation(x: Column, ddof: int = 1) -> Column:
    squares = let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
    return F.when(F.size(x) > ddof, F.sqrt(squares / F.nullif(F.size(x) - ddof, F.lit(0))))


def centered(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def padded(x: Column, win: int) -> Column:
    """Zeros up to the window, or the first ``win`` samples."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(win) - F.size(x), F.lit(0)))
    return F.slice(F.concat(x, zeros), 1, win)


def cycled(x: Column, win: int) -> Column:
    """The signal repeated up to the window."""
    times = F.ceil(F.lit(win) / F.nullif(F.size(x), F.lit(0))).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, times)), 1, win)


def valid_length(x: Column, win: int) -> Column:
    return F.least(F.size(x), F.lit(win))


def valid_frames(valid: Column, n_fft: int, hop: int, frames: Column) -> Column:
    return F.least(F.floor((valid - n_fft) / F.lit(hop)) + 1, frames)


def mono(channels: Column) -> Column:
    """Mean over an array of equally long channels."""
    def average(cs: Column) -> Column:
        return F.transform(cs[0], lambda _, i: F.aggregate(cs, F.lit(0.0), lambda a, c: a + c[i]) / F.size(cs))

    return let(channels, average)


def every_kth(x: Column, k: int) -> Column:
    return F.filter(x, lambda _, i: i % k == 0)


def decimated(x: Column, rate: int, target: int) -> Column:
    """Every k-th sample; only for a rate that is a multiple of the target."""
    if rate % target:
        raise ValueError(f"{rate} is no multiple of {target}; use the band-limited resampler")
    return every_kth(x, rate // target)


def gained(x: Column, decibel: Column) -> Column:
    return let(F.pow(F.lit(10.0), decibel / 20), lambda factor: F.transform(x, lambda v: v * factor))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def unit(x: Column) -> Column:
    """Vector over its length; the zero vector stays."""
    return let(norm(x), lambda n: F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda u, v: u.cast("double") - v.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v * v)


def cosine_from_squared(d: Column) -> Column:
    """Cosine similarity of unit vectors from their squared distance."""
    return 1 - d / 2


def softmax(x: Column) -> Column:
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda v: v / t)))


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def standardised(x: Column, mean_: float | None = None, std: float | None = None, coeff: float = 1.0) -> Column:
    """``(v - mean) / (std * coeff)`` over all entries of a vector, given or own statistics."""
    if mean_ is not None and std is not None:
        return F.transform(x, lambda v: (v - mean_) / (std * coeff))
    facts = let(x, lambda y: F.struct(y.alias("y"), mean(y).alias("m"), deviation(y).alias("s")))
    return let(facts, lambda f: F.transform(f["y"], lambda v: (v - f["m"]) / (f["s"] * coeff + 1e-10)))


def standardised_matrix(m: Column, per_band: bool, coeff: float = 1.0) -> Column:
    """Frames by bands; over everything, or per band over time."""
    def facts(values: Column) -> Column:
        return F.struct(mean(values).alias("m"), deviation(values).alias("s"))

    def scaled(v: Column, f: Column) -> Column:
        return (v - f["m"]) / (f["s"] * coeff + 1e-10)

    if not per_band:
        return let(
            let(F.flatten(m), facts), lambda f: F.transform(m, lambda row: F.transform(row, lambda v: scaled(v, f)))
        )
    bands_ = F.transform(m[0], lambda _, i: F.transform(m, lambda row: row[i]))
    return let(
        F.transform(bands_, facts), lambda fs: F.transform(m, lambda row: F.zip_with(row, fs, scaled))
    )


def fixed_frames(m: Column, frames: int, min_bands: int) -> Column:
    """Exactly ``frames`` rows, each at least ``min_bands`` wide, filled with zeros."""
    wide = F.transform(
        m, lambda row: F.concat(row, F.array_repeat(F.lit(0.0), F.greatest(F.lit(min_bands) - F.size(row), F.lit(0))))
    )
    blank = F.transform(wide[0], lambda _: F.lit(0.0))
    return F.slice(F.concat(wide, F.array_repeat(blank, F.greatest(F.lit(frames) - F.size(m), F.lit(0)))), 1, frames)


def bands(x: Column, width: int) -> Column:
    """Equal bands along the last axis; what does not fill a band is dropped."""
    count = F.floor(F.size(x) / width).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(x, b * width + 1, F.lit(width)))


def rejoined(parts: Column) -> Column:
    return F.flatten(parts)


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its inputs, so a retried task draws the same one."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
