"""Cutting signals into windows, as offsets first and as samples only where needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tonewheel.functions.arrays import hash_uniform


def rescaled_frames(frames: Column, rate: Column, target: int) -> Column:
    """Frame count after resampling to ``target``."""
    return F.floor(F.lit(float(target)) / rate * frames).cast("bigint")


def _steps(first: Column, last: Column, step: int) -> Column:
    return F.sequence(first, last, F.lit(step).cast("bigint"))


def sliding_offsets(n: Column, win: int, hop: int) -> Column:
    """Regular offsets, and one right-aligned window if the rest is at least 5% of a window."""
    n = n.cast("bigint")
    following = (F.floor((n - win) / F.lit(hop)) + 1) * hop
    regular = _steps(F.lit(0).cast("bigint"), F.greatest(n - win, F.lit(0)), hop)
    rest = F.when(following + 0.05 * win <= n, F.array(n - win)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= win, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(regular, rest))


def half_rule_starts(n: Column, win: int) -> Column:
    """Back-to-back chunks; a rest above half a chunk gives one more, right-aligned; else it is dropped."""
    n = n.cast("bigint")
    full = F.floor(n / F.lit(win))
    none = F.array().cast("array<bigint>")
    regular = F.when(full > 0, _steps(F.lit(0).cast("bigint"), F.greatest((full - 1) * win, F.lit(0)), win)).otherwise(none)
    last = F.when(n - full * win > win / 2, F.array(F.greatest(n - win, F.lit(0).cast("bigint")))).otherwise(none)
    return F.concat(regular, last)


def sequential_crops(n: Column, crop: int, pad_last: bool = False, drop_short: bool = False) -> Column:
    """Starts of full crops, plus a padded one if there is no full crop or ``pad_last``."""
    n = n.cast("bigint")
    full = F.floor(n / F.lit(crop))
    none = F.array().cast("array<bigint>")
    regular = F.when(full > 0, _steps(F.lit(0).cast("bigint"), F.greatest((full - 1) * crop, F.lit(0)), crop)).otherwise(none)
    out = F.concat(regular, F.when((full == 0) | F.lit(pad_last), F.array(full * crop)).otherwise(none))
    return F.when(n < int(crop * 0.8), none).otherwise(out) if drop_short else out


def segment_index(df: DataFrame, offsets: Column) -> DataFrame:
    """One row per window: ``seg`` from 0 and ``offset``."""
    return df.select("*", F.posexplode(offsets).alias("seg", "offset"))


def without_empty(df: DataFrame, frames: str = "num_frames", rate: str = "sample_rate") -> DataFrame:
    """Clips with samples and a rate; the others have nothing to cut."""
    return df.where((F.coalesce(frames, F.lit(0)) > 0) & (F.coalesce(rate, F.lit(0)) > 0))


def reject_reason(frames: str = "num_frames", rate: str = "sample_rate") -> Column:
    """Why a clip has nothing to cut; null for the others."""
    return (
        F.when(F.col(frames).isNull(), "unknown length").when(F.col(frames) <= 0, "no samples")
        .when(F.col(rate).isNull(), "unknown rate").when(F.col(rate) <= 0, "no rate")
    )


def split_empty(
    df: DataFrame, frames: str = "num_frames", rate: str = "sample_rate", counts: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clips that can be cut, and the rejected ones with a ``reason``.

    ``counts`` observes the first table: once it has been used, ``counts.get`` has ``clips``, ``kept`` and ``rejected``
    of the rows that went by, without a job of its own.
    """
    reason = reject_reason(frames, rate)
    seen = df
    if counts is not None:
        seen = df.observe(counts, F.count(F.lit(1)).alias("clips"), F.count(F.when(reason.isNull(), 1)).alias("kept"),
                          F.count(F.when(reason.isNotNull(), 1)).alias("rejected"))
    return seen.where(reason.isNull()), df.withColumn("reason", reason).where("reason is not null")


def random_crops(df: DataFrame, key: Sequence[str], n: Column, win: int, seed: int) -> DataFrame:
    """``floor(n / win)`` crops at uniform offsets; a short clip gives itself once."""
    count = F.greatest(F.floor(n / F.lit(win)), F.lit(1)).cast("int")
    out = df.withColumn("seg", F.explode(F.sequence(F.lit(0), count - 1)))
    draw = hash_uniform(F.lit(seed), *[F.col(k) for k in key], F.col("seg"))
    room = F.greatest(n - win, F.lit(0))
    return out.withColumn("offset", F.floor(draw * room).cast("bigint"))


def cut_array(x: Column, offset: Column, win: int) -> Column:
    return F.slice(x, (offset + 1).cast("int"), F.lit(win))


def window_members(samples: DataFrame, win: int, hop: int, pos: str = "pos", size: str = "pos_n") -> DataFrame:
    """Sliding windows of a signal kept as one row per sample, however long the signal is.

    Every sample row is sent to the few windows that hold it, so no signal is ever collected: a
    window has at most ``win`` rows. Adds ``seg`` and ``offset``.
    """
    p, n = F.col(pos), F.col(size)
    last = F.greatest(F.floor((n - win) / F.lit(hop)), F.lit(0))
    low = F.greatest(F.floor((p - win) / F.lit(hop)) + 1, F.lit(0))
    high = F.least(F.floor(p / F.lit(hop)), last)
    none = F.array().cast("array<struct<seg:bigint,offset:bigint>>")

    def seg(i: Column, offset: Column) -> Column:
        return F.struct(i.cast("bigint").alias("seg"), offset.cast("bigint").alias("offset"))

    regular = F.when(low <= high, F.transform(F.sequence(low, F.greatest(high, low)), lambda i: seg(i, i * hop))).otherwise(none)
    has_rest = (n > win) & ((last + 1) * hop + 0.05 * win <= n) & (p >= n - win)
    rest = F.when(has_rest, F.array(seg(last + 1, n - win))).otherwise(none)
    return samples.select("*", F.explode(F.concat(regular, rest)).alias("_w")).select(
        *samples.columns, "_w.seg", "_w.offset"
    )


def chunk_members(samples: DataFrame, win: int, pos: str = "pos", size: str = "pos_n") -> DataFrame:
    """The half-rule chunks, for signals kept as one row per sample."""
    p, n = F.col(pos), F.col(size)
    full = F.floor(n / F.lit(win))
    here = F.floor(p / F.lit(win))
    none = F.array().cast("array<struct<seg:bigint,offset:bigint>>")

    def seg(i: Column, offset: Column) -> Column:
        return F.struct(i.cast("bigint").alias("seg"), offset.cast("bigint").alias("offset"))

    regular = F.when(here < full, F.array(seg(here, here * win))).otherwise(none)
    start = F.greatest(n - win, F.lit(0))
    rest = F.when((n - full * win > win / 2) & (p >= start), F.array(seg(full, start))).otherwise(none)
    return samples.select("*", F.explode(F.concat(regular, rest)).alias("_w")).select(
        *samples.columns, "_w.seg", "_w.offset"
    )


def collect_windows(members: DataFrame, keys: Sequence[str], value: str, pos: str = "pos") -> DataFrame:
    """``(keys, seg, offset, x)``: the samples of each window in order; bounded by the window length."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value).cast("double").alias("v"))))
    return members.groupBy(*keys, "seg", "offset").agg(F.transform(rows, lambda r: r["v"]).alias("x"))
