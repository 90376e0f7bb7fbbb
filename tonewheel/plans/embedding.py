"""Signals to file vectors: resample, cut, centre, pad, featurise, normalise, encode, pool, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions import arrays
from tonewheel.functions.chain import Chain
from tonewheel.functions.spectral import FbankConfig, StftConfig
from tonewheel.operators.blocks import BLOCK, reblocked, resampled_blocks, windows_of_blocks
from tonewheel.operators.features import encode, with_fbank, with_stft, with_vectors
from tonewheel.operators.pooling import pool_vectors
from tonewheel.operators.segments import cut_array, segment_index, sliding_offsets
from tonewheel.session import settle
from tonewheel.sources.store import stored


def segments(signals: DataFrame, win: int, hop: int, fill: str = "pad") -> DataFrame:
    """``(file, seg, offset, valid_len, x)``: centred windows of equal length from ``(file, x)``."""
    rows = segment_index(signals, sliding_offsets(F.size("x"), win, hop))
    cut = rows.withColumn("x", arrays.centered(cut_array(F.col("x"), F.col("offset"), win)))
    full = arrays.cycled(F.col("x"), win) if fill == "cycle" else arrays.padded(F.col("x"), win)
    valid = F.lit(win) if fill == "cycle" else arrays.valid_length(F.col("x"), win)
    return cut.withColumn("valid_len", valid).withColumn("x", full)


def featurised(segs: DataFrame, feature: StftConfig | FbankConfig, per_band_norm: bool | None = None) -> DataFrame:
    """Add ``spec`` and its ``valid_frames``; ``per_band_norm`` standardises it per band or over all."""
    out = with_stft(segs, feature) if isinstance(feature, StftConfig) else with_fbank(segs, feature)
    out = out.withColumn("valid_frames", arrays.valid_frames(F.col("valid_len"), feature.n_fft, feature.hop, F.size("spec")))
    if per_band_norm is not None:
        out = out.withColumn("spec", arrays.standardised_matrix(F.col("spec"), per_band_norm))
    return out


def file_vectors(segs: DataFrame, encoder: str = "spectral_statistics", pool: str = "mean", column: str = "x") -> DataFrame:
    return pool_vectors(encode(segs, encoder, column).select("file", "emb"), ["file"], pool)


def at_rate(blocks: DataFrame, keys: list[str], rates: tuple[int, ...], decimate: bool = False, size: int = BLOCK) -> DataFrame:
    """Blocks of signals of any rates, resampled to one rate after the other (the data's, then the model's).

    ``decimate`` holds for the first step: signals whose rate is a multiple of it lose samples, others are filtered.
    """
    for k, rate in enumerate(rates):
        if k:  # a second filter needs blocks again, not the pieces that the first one left
            blocks = reblocked(settle(blocks), keys, size)
        blocks = resampled_blocks(blocks, keys, rate, decimate and k == 0)
    return blocks


def block_vectors(
    blocks: DataFrame, keys: list[str], chain: Chain, hop: int, rates: tuple[int, ...] = (), decimate: bool = False, size: int = BLOCK,
) -> DataFrame:
    """``keys, seg, offset, emb, valid``: the vector of every window of every signal.

    From stored blocks: resample by each signal's own rate, cut windows from neighbouring blocks, then every step of the
    chain in one pass over the windows. No row is larger than a block or a window.
    """
    if rates:
        blocks = settle(at_rate(blocks, keys, rates, decimate, size))
    return with_vectors(windows_of_blocks(blocks, keys, chain.win, hop).drop("n"), chain)


def embed_blocks(
    spark: SparkSession, blocks: DataFrame, path: str, keys: list[str], chain: Chain, hop: int, rates: tuple[int, ...] = (),
    decimate: bool = False, pool: str = "mean", overwrite: bool = False,
) -> DataFrame:
    """The stored vectors, pooled per signal, of a block table: the whole embedding job, computed on first use."""
    def make() -> DataFrame:
        return pool_vectors(block_vectors(blocks, keys, chain, hop, rates, decimate).select(*keys, "emb"), keys, pool)

    return stored(spark, path, make, overwrite)


def embed(spark: SparkSession, signals: DataFrame, path: str, win: int, hop: int, encoder: str = "spectral_statistics", pool: str = "mean", overwrite: bool = False) -> DataFrame:
    """The stored vectors of a collection, computed on first use."""
    return stored(spark, path, lambda: file_vectors(segments(signals, win, hop), encoder, pool), overwrite)
