"""From raw windows to vectors in one pass over a batch: centre, fill, spectrum, normalise, fix the size, encode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tonewheel.functions import spectral

Kernel = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Chain:
    """What happens to a window of ``win`` samples; steps that are None or False are left out.

    ``fill`` is ``pad`` or ``cycle``; ``feature`` a spectrum or a mel recipe, or None for the samples themselves;
    ``norm`` is ``all`` (over the whole feature, by its own or the given ``mean`` and ``std``) or ``temporal`` (each band
    over time); ``frames`` and ``min_bands`` fix the size of the feature; ``band`` cuts the frequency axis into bands of
    that width, encodes each and joins the vectors in order, and drops what doesn't fill a band.
    """

    win: int
    fill: str = "pad"
    feature: spectral.StftConfig | spectral.FbankConfig | None = None
    norm: str | None = None
    mean: float | None = None
    std: float | None = None
    coeff: float = 1.0
    frames: int | None = None
    min_bands: int = 0
    band: int | None = None
    encoder: str = "spectral_statistics"


def filled(x: np.ndarray, win: int, fill: str) -> tuple[np.ndarray, int]:
    """Windows ``[rows, n]`` of their own mean taken off, ``win`` long, and how many samples of them are valid."""
    x = x - x.mean(axis=1, keepdims=True)
    n = x.shape[1]
    if n >= win:
        return x[:, :win], win
    if fill == "cycle":
        return np.tile(x, (1, -(-win // n)))[:, :win], win
    return np.pad(x, ((0, 0), (0, win - n))), n


def normalised(x: np.ndarray, chain: Chain) -> np.ndarray:
    """Over time of each band, or over everything; a feature of one value or frame has no spread and becomes zeros."""
    if chain.norm is None:
        return x
    if chain.norm == "all" and chain.mean is not None and chain.std is not None:
        return (x - chain.mean) / (chain.std * chain.coeff)
    axes = 1 if chain.norm == "temporal" and x.ndim == 3 else tuple(range(1, x.ndim))
    count = x.shape[1] if axes == 1 else int(np.prod(x.shape[1:]))
    mean = x.mean(axis=axes, keepdims=True)
    spread = np.sqrt(((x - mean) ** 2).sum(axis=axes, keepdims=True) / max(count - 1, 1))
    return (x - mean) / (spread * chain.coeff + 1e-10)


def sized(x: np.ndarray, frames: int | None, min_bands: int) -> np.ndarray:
    """Exactly ``frames`` frames, and at least ``min_bands`` bands, filled with zeros."""
    wide = max(0, min_bands - x.shape[2])
    more = 0 if frames is None else max(0, frames - x.shape[1])
    return np.pad(x, ((0, 0), (0, more), (0, wide)))[:, :frames]


def encoded(x: np.ndarray, kernel: Kernel, band: int | None) -> np.ndarray:
    if band is None:
        return kernel(x)
    return np.concatenate([kernel(x[..., k * band: (k + 1) * band]) for k in range(x.shape[-1] // band)], axis=-1)


def valid_frames(valid: int, feature: spectral.StftConfig | spectral.FbankConfig, frames: int) -> int:
    return min((valid - feature.n_fft) // feature.hop + 1, frames)


def vectors(x: np.ndarray, chain: Chain, kernel: Kernel) -> tuple[np.ndarray, int]:
    """Vectors of equally long raw windows, and how many samples (without a feature) or frames of them are valid."""
    x, valid = filled(x, chain.win, chain.fill)
    if chain.feature is not None:
        make = spectral.stft if isinstance(chain.feature, spectral.StftConfig) else spectral.fbank
        x = make(x, chain.feature)
        if x.ndim == 4:  # an encoder of matrices takes both channels of a complex spectrum side by side in frequency
            x = np.concatenate([x[:, 0], x[:, 1]], axis=-1)
        valid = valid_frames(valid, chain.feature, x.shape[1])
    x = normalised(x, chain)
    if x.ndim == 3:
        x = sized(x, chain.frames, chain.min_bands)
    return encoded(x, kernel, chain.band), valid
