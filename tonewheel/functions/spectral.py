"""Numeric kernels for one batch of equally long windows: spectra, mel energies, resampling.

They are called from ``operators.features`` inside Arrow batches; nothing here touches Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np

LOG_FLOOR = 1e-10
#: Zero crossings of the resampler's filter on each side, and its cutoff below the lower of both rates' halves.
ZEROS, ROLLOFF = 6, 0.99


def hann(n: int, periodic: bool = True) -> np.ndarray:
    span = n if periodic else n - 1
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(span, 1))


def frames(x: np.ndarray, size: int, hop: int, center: bool = False, pad: str = "reflect") -> np.ndarray:
    """``[batch, n]`` to ``[batch, frame, size]`` as a view."""
    if center:
        x = np.pad(x, ((0, 0), (size // 2, size // 2)), mode=pad)
    if x.shape[1] < size:
        return np.zeros((x.shape[0], 0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]


@dataclass(frozen=True)
class StftConfig:
    sample_rate: int = 16000
    frame_length: float = 25
    frame_shift: float = 10
    impl: str = "torchaudio"
    data_type: str = "magnitude"
    center: bool = False
    log: bool = True
    channels: bool = False

    @property
    def n_fft(self) -> int:
        return int(self.sample_rate * self.frame_length / 1000)

    @property
    def hop(self) -> int:
        return int(self.sample_rate * self.frame_shift / 1000)


def stft(x: np.ndarray, conf: StftConfig) -> np.ndarray:
    """``[batch, time, freq]``; complex spectra give real parts, then imaginary parts, along frequency.

    With ``channels`` a complex spectrum has both as channels instead: ``[batch, 2, time, freq]``.
    """
    librosa = conf.impl == "librosa"
    center = True if librosa else conf.center
    framed = frames(x, conf.n_fft, conf.hop, center, "constant" if librosa else "reflect")
    spectrum = np.fft.rfft(framed * hann(conf.n_fft), axis=-1)
    if conf.data_type == "complex" and not librosa:
        parts = [spectrum.real, spectrum.imag]
        return np.stack(parts, axis=1) if conf.channels else np.concatenate(parts, axis=-1)
    size = np.abs(spectrum)
    return np.log(size + LOG_FLOOR) if conf.log else size


def to_mel(hz, scale: str):
    hz = np.asarray(hz, dtype=np.float64)
    if scale == "htk":
        return 2595.0 * np.log10(1.0 + hz / 700.0)
    if scale == "kaldi":
        return 1127.0 * np.log(1.0 + hz / 700.0)
    # slaney: linear below 1 kHz, logarithmic above
    return np.where(hz < 1000.0, hz * 3 / 200.0, 15.0 + 27.0 * np.log(np.maximum(hz, 1000.0) / 1000.0) / np.log(6.4))


def from_mel(mel, scale: str):
    mel = np.asarray(mel, dtype=np.float64)
    if scale == "htk":
        return 700.0 * (10.0 ** (mel / 2595.0) - 1.0)
    if scale == "kaldi":
        return 700.0 * (np.exp(mel / 1127.0) - 1.0)
    return np.where(mel < 15.0, mel * 200.0 / 3.0, 1000.0 * np.exp((mel - 15.0) * np.log(6.4) / 27.0))


def mel_filters(
    bins: np.ndarray, n_mels: int, low: float, high: float, scale: str, area_norm: bool, slopes: str = "hz"
) -> np.ndarray:
    """Triangles ``[freq, mel]`` over bin frequencies; slopes are straight in Hz or in mel."""
    edges_mel = np.linspace(to_mel(low, scale), to_mel(high, scale), n_mels + 2)
    edges_hz = from_mel(edges_mel, scale)
    at, edges = (bins, edges_hz) if slopes == "hz" else (to_mel(bins, scale), edges_mel)
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    up = (at[:, None] - left) / (mid - left)
    down = (right - at[:, None]) / (right - mid)
    bank = np.maximum(0.0, np.minimum(up, down))
    return bank * (2.0 / (edges_hz[2:] - edges_hz[:-2])) if area_norm else bank


@dataclass(frozen=True)
class FbankConfig:
    sample_rate: int = 16000
    frame_length: float = 25
    frame_shift: float = 10
    impl: str = "kaldi"
    num_mel_bins: int = 80
    f_min: float = 0.0
    f_max: float | None = None
    center: bool = True
    top_db: float | None = None
    shift_15: bool = False
    mel_scale: str = "htk"
    norm: str | None = None
    window_type: str = "hanning"
    n_fft_: int | None = None
    hop_: int | None = None
    #: Kaldi recipe: Gaussian noise of this size on every frame. ``htk_compat`` would move the energy column to the end;
    #: there is none here, so it changes nothing.
    dither: float = 0.0
    seed: int = 0
    htk_compat: bool = False
    #: Log recipe: window shorter than the transform, centred in it.
    win_length: int | None = None

    @property
    def n_fft(self) -> int:
        return self.n_fft_ or int(self.sample_rate * self.frame_length / 1000)

    @property
    def hop(self) -> int:
        return self.hop_ or int(self.sample_rate * self.frame_shift / 1000)


def fbank(x: np.ndarray, conf: FbankConfig) -> np.ndarray:
    """Mel energies ``[batch, time, mel]`` by one of four published recipes."""
    return {"kaldi": _fbank_kaldi, "torchaudio": _fbank_db, "nnaudio": _fbank_log, "huggingface": _fbank_hf}[conf.impl](x, conf)


def window(name: str, n: int, periodic: bool) -> np.ndarray:
    """Tapers by name."""
    span = max(n if periodic else n - 1, 1)
    turn = 2 * np.pi * np.arange(n) / span
    if name in ("hann", "hanning", "hann_window"):
        return 0.5 - 0.5 * np.cos(turn)
    if name in ("hamming", "hamming_window"):
        return 0.54 - 0.46 * np.cos(turn)
    if name == "povey":
        return (0.5 - 0.5 * np.cos(turn)) ** 0.85
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn)
    if name in ("rectangular", "boxcar"):
        return np.ones(n)
    raise ValueError(f"unknown window {name!r}")


def _mel_power(
    x: np.ndarray, conf: FbankConfig, scale: str, area_norm: bool, center: bool, high: float, taper: np.ndarray | None = None
) -> np.ndarray:
    framed = frames(x, conf.n_fft, conf.hop, center)
    power = np.abs(np.fft.rfft(framed * (hann(conf.n_fft) if taper is None else taper), axis=-1)) ** 2
    bins = np.linspace(0.0, conf.sample_rate / 2, conf.n_fft // 2 + 1)
    return power @ mel_filters(bins, conf.num_mel_bins, conf.f_min, high, scale, area_norm)


def _nyquist(conf: FbankConfig) -> float:
    return conf.f_max if conf.f_max is not None else conf.sample_rate / 2


def _fbank_db(x: np.ndarray, conf: FbankConfig) -> np.ndarray:
    db = 10.0 * np.log10(np.maximum(_mel_power(x, conf, "htk", False, conf.center, _nyquist(conf)), LOG_FLOOR))
    if conf.top_db is not None and db.size:
        db = np.maximum(db, db.max(axis=(1, 2), keepdims=True) - conf.top_db)
    return db


def _fbank_log(x: np.ndarray, conf: FbankConfig) -> np.ndarray:
    short = conf.win_length or conf.n_fft
    before = (conf.n_fft - short) // 2
    taper = np.pad(hann(short), (before, conf.n_fft - short - before))
    mel = _mel_power(x, conf, "slaney", True, True, _nyquist(conf), taper)
    return np.log(mel + np.finfo(np.float32).eps)


def _fbank_hf(x: np.ndarray, conf: FbankConfig) -> np.ndarray:
    high = conf.f_max if conf.f_max is not None else 14000.0
    mel = _mel_power(x, conf, conf.mel_scale, conf.norm == "slaney", True, high, window(conf.window_type, conf.n_fft, True))
    return 10.0 * np.log10(np.maximum(mel, LOG_FLOOR))


def _fbank_kaldi(x: np.ndarray, conf: FbankConfig) -> np.ndarray:
    """DC removal, pre-emphasis 0.97, power spectrum on the next power of two, log with float32 floor."""
    if conf.shift_15:
        x = x * 2.0**15
    framed = frames(x, conf.n_fft, conf.hop)
    if conf.dither:
        framed = framed + conf.dither * np.random.default_rng(conf.seed).normal(size=framed.shape)
    framed = framed - framed.mean(axis=-1, keepdims=True) if framed.shape[1] else framed
    before = np.concatenate([framed[..., :1], framed[..., :-1]], axis=-1)
    n = conf.n_fft
    shaped = (framed - 0.97 * before) * window(conf.window_type, n, False)
    padded = 1 << (n - 1).bit_length()
    power = np.abs(np.fft.rfft(shaped, padded, axis=-1)) ** 2
    bins = np.arange(padded // 2 + 1) * conf.sample_rate / padded
    bank = mel_filters(bins, conf.num_mel_bins, 20.0, conf.sample_rate / 2, "kaldi", False, slopes="mel")
    bank[-1] = 0.0
    return np.log(np.maximum(power @ bank, np.finfo(np.float32).eps))


def resample(x: np.ndarray, rate: int, target: int, zeros: int = ZEROS, rolloff: float = ROLLOFF) -> np.ndarray:
    """Band-limited resampling of ``[batch, n]``: a Hann-windowed sinc evaluated at the new sample times."""
    if rate == target or x.shape[1] == 0:
        return x
    common = gcd(rate, target)
    rate, target = rate // common, target // common
    n = x.shape[1]
    out = np.zeros((x.shape[0], -(-n * target // rate)))
    cutoff = min(rate, target) * rolloff
    reach = int(np.ceil(zeros * rate / cutoff))
    padded = np.pad(x, ((0, 0), (reach, reach + rate)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + rate, axis=1)[:, ::rate]
    taps = np.arange(-reach, reach + rate) / rate
    for phase in range(target):
        t = np.clip((taps - phase / target) * cutoff, -zeros, zeros)
        kernel = np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2 * cutoff / rate
        times = out[:, phase::target]
        times[...] = (windows[:, : times.shape[1]] @ kernel)
    return out


def frame_statistics(x: np.ndarray) -> np.ndarray:
    """Encoder of features ``[windows, time, band]``: mean, spread, least and largest value of each band over time."""
    return np.concatenate([x.mean(1), x.std(1), x.min(1), x.max(1)], axis=1)


def spectral_statistics(x: np.ndarray) -> np.ndarray:
    """Default encoder: level, spread, extremes and energy of each window, then its eight octave-like band energies."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2 / max(x.shape[1], 1)
    parts = np.array_split(power, 8, axis=1)
    basic = [x.mean(1), x.std(1), x.min(1), x.max(1), (x * x).mean(1)]
    return np.stack(basic + [p.sum(1) for p in parts], axis=1)
