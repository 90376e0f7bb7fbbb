"""Channels of multi-channel recordings: unpivot, mixdown, shared peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_channels(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], name: str = "channel", value: str = "v"
) -> DataFrame:
    """One row per selected channel column."""
    return df.unpivot(list(keys), list(channels), name, value)


def renumbered(channel: Column, count: int = 7) -> Column:
    """Channel numbers counted from the other end."""
    return F.lit(count) - channel


def mixdown(samples: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Mean of the channels at every sample time."""
    return samples.groupBy(*keys).agg(F.avg(value).alias(value))


def peak_normalised(df: DataFrame, value: str = "v", channel: str | None = None, chosen: Sequence[object] = ()) -> DataFrame:
    """Divide by the largest magnitude over all rows of the chosen channels, if it is above 1."""
    used = df.where(F.col(channel).isin(*chosen)) if channel else df
    peak = used.select(F.max(F.abs(value)).alias("_peak")).scalar()
    scaled = F.when(F.col("_peak") > 1, F.col(value) / F.col("_peak")).otherwise(F.col(value))
    return used.withColumn("_peak", peak).withColumn(value, scaled).drop("_peak")


def peak_normalised_arrays(df: DataFrame, value: str = "x") -> DataFrame:
    """The same for one waveform per row."""
    peak = df.select(F.max(F.array_max(F.transform(value, lambda v: F.abs(v)))).alias("_peak")).scalar()
    out = df.withColumn("_peak", peak)
    scaled = F.transform(value, lambda v: F.when(F.col("_peak") > 1, v / F.col("_peak")).otherwise(v))
    return out.withColumn(value, scaled).drop("_peak")
