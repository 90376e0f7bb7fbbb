"""Windows, crops and spectra against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.functions import arrays, spectral
from tonewheel.operators import segments


def expr(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("n,win,hop,want", [
    (20, 10, 10, [0, 10]), (21, 10, 10, [0, 10, 11]), (8, 10, 10, [0]), (40, 20, 20, [0, 20]), (41, 20, 20, [0, 20, 21]), (24, 10, 5, [0, 5, 10, 14]),
])
def test_sliding_offsets(spark, n, win, hop, want):
    assert expr(spark, segments.sliding_offsets(F.lit(n), win, hop)) == want
    samples = spark.range(n).select(F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("pos_n"), F.col("id").cast("double").alias("v"), F.lit(0).alias("k"))
    got = segments.collect_windows(segments.window_members(samples, win, hop), ["k"], "v").orderBy("seg").collect()
    assert [r["offset"] for r in got] == want
    assert all(r["x"] == [float(i) for i in range(r["offset"], min(r["offset"] + win, n))] for r in got)


@pytest.mark.parametrize("n,want", [(26, [0, 10, 16]), (25, [0, 10]), (6, [0]), (5, [])])
def test_half_rule(spark, n, want):
    assert expr(spark, segments.half_rule_starts(F.lit(n), 10)) == want
    samples = spark.range(n).select(F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("pos_n"))
    got = segments.chunk_members(samples, 10).groupBy("seg", "offset").count().orderBy("seg").collect()
    assert [r["offset"] for r in got] == want and all(r["count"] == min(n, 10) for r in got)


def test_sequential_crops(spark):
    assert expr(spark, segments.sequential_crops(F.lit(25), 10)) == [0, 10]
    assert expr(spark, segments.sequential_crops(F.lit(25), 10, pad_last=True)) == [0, 10, 20]
    assert expr(spark, segments.sequential_crops(F.lit(7), 10)) == [0]
    assert expr(spark, segments.sequential_crops(F.lit(7), 10, drop_short=True)) == []


def test_random_crops_stay_inside_and_repeat(spark):
    df = spark.createDataFrame([("a", 105), ("b", 4)], "f string, n int")
    rows = segments.random_crops(df, ["f"], F.col("n"), 10, seed=1).collect()
    again = segments.random_crops(df.repartition(5), ["f"], F.col("n"), 10, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sum(r["f"] == "a" for r in rows) == 10 and all(0 <= r["offset"] <= 95 for r in rows)


def test_array_work(spark):
    x = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 6)])
    assert expr(spark, arrays.centered(x)) == [-2.0, -1.0, 0.0, 3.0]
    assert expr(spark, arrays.every_kth(x, 2)) == [1.0, 3.0]
    assert expr(spark, arrays.padded(x, 6)) == [1.0, 2.0, 3.0, 6.0, 0.0, 0.0] and expr(spark, arrays.padded(x, 2)) == [1.0, 2.0]
    assert expr(spark, arrays.deviation(x)) == pytest.approx(np.std([1, 2, 3, 6], ddof=1))
    assert expr(spark, arrays.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert expr(spark, arrays.mono(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))))) == [2.0, 4.0]
    assert expr(spark, arrays.gained(x, F.lit(20.0))) == [10.0, 20.0, 30.0, 60.0]
    assert expr(spark, arrays.bands(x, 3)) == [[1.0, 2.0, 3.0]] and expr(spark, arrays.bands(x, 9)) == []
    with pytest.raises(ValueError):
        arrays.decimated(x, 10, 3)


def test_sine_peaks_in_its_bin():
    conf = spectral.StftConfig(sample_rate=8000, frame_length=32, frame_shift=16, log=False)
    tone = np.sin(2 * np.pi * 1000 * np.arange(2048) / 8000)[None]
    spec = spectral.stft(tone, conf)
    assert spec.shape[1] == (2048 - 256) // 128 + 1 and (spec[0].argmax(1) == 32).all()
    assert np.allclose(spec[0, 3, 32], 64, atol=1e-6)  # half of the window's sum
    both = spectral.stft(tone, spectral.StftConfig(8000, 32, 16, data_type="complex"))
    assert np.allclose(np.hypot(both[..., :129], both[..., 129:]), spec)
    assert spectral.stft(tone, spectral.StftConfig(8000, 32, 16, impl="librosa")).shape[1] == 2048 // 128 + 1


def test_parseval():
    x = np.random.default_rng(0).normal(size=(3, 64))
    conf = spectral.StftConfig(sample_rate=64000, frame_length=1, frame_shift=1, log=False)
    p = spectral.stft(x, conf)[:, 0] ** 2
    assert np.allclose((p[:, 0] + 2 * p[:, 1:-1].sum(1) + p[:, -1]) / 64, ((x * spectral.hann(64)) ** 2).sum(1))


@pytest.mark.parametrize("impl", ["kaldi", "torchaudio", "nnaudio", "huggingface"])
def test_mel_recipes_find_the_tone(impl):
    rate, f = 16000, 2000.0
    tone = np.sin(2 * np.pi * f * np.arange(8000) / rate)[None]
    conf = spectral.FbankConfig(sample_rate=rate, impl=impl, num_mel_bins=40)
    out = spectral.fbank(tone, conf)
    scale, low, high = {"kaldi": ("kaldi", 20, 8000), "torchaudio": ("htk", 0, 8000), "nnaudio": ("slaney", 0, 8000), "huggingface": ("htk", 0, 14000)}[impl]
    centres = spectral.from_mel(np.linspace(spectral.to_mel(low, scale), spectral.to_mel(high, scale), 42), scale)[1:-1]
    assert out.shape[2] == 40 and np.isfinite(out).all()
    assert abs(int(out[0, out.shape[1] // 2].argmax()) - int(np.abs(centres - f).argmin())) <= 1
    expected = (8000 - 400) // 160 + 1 if impl == "kaldi" else 8000 // 160 + 1
    assert out.shape[1] == expected


def test_mel_scales_invert():
    hz = np.array([0.0, 200.0, 999.0, 1000.0, 4000.0, 8000.0])
    for scale in ("htk", "kaldi", "slaney"):
        assert np.allclose(spectral.from_mel(spectral.to_mel(hz, scale), scale), hz)


@pytest.mark.parametrize("rate,target", [(16000, 8000), (8000, 16000), (44100, 16000), (3, 2)])
def test_resampling_keeps_a_low_tone(rate, target):
    n, f = 4000, 0.01
    y = spectral.resample(np.sin(2 * np.pi * f * np.arange(n))[None], rate, target)
    assert y.shape[1] == -(-n * target // rate)
    want = np.sin(2 * np.pi * f * rate / target * np.arange(y.shape[1]))
    middle = slice(len(want) // 4, 3 * len(want) // 4)
    assert np.abs(y[0, middle] - want[middle]).max() < 0.02


def test_chain_agrees_with_its_steps(spark):
    """One pass over mixed lengths against the array expressions, step by step."""
    from tonewheel.functions.chain import Chain
    from tonewheel.operators.features import with_stft, with_vectors

    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=n).tolist()) for i, n in enumerate([64, 64, 40, 64, 9, 64, 40])]
    df = spark.createDataFrame(rows, "id int, x array<double>").repartition(2)
    conf = spectral.StftConfig(1000, 16, 8, log=False)
    for fill in ("pad", "cycle"):
        for per_band in (True, False):
            chain = Chain(64, fill, conf, "temporal" if per_band else "all", frames=9, min_bands=11, band=5, encoder="frame_statistics")
            got = {r.id: (r.emb, r.valid) for r in with_vectors(df, chain).collect()}
            full = arrays.cycled(F.col("x"), 64) if fill == "cycle" else arrays.padded(F.col("x"), 64)
            valid = F.lit(64) if fill == "cycle" else F.size("x")
            steps = df.withColumn("x", arrays.centered(F.col("x"))).withColumn("valid", valid).withColumn("x", full)
            steps = with_stft(steps, conf).withColumn("valid", arrays.valid_frames(F.col("valid"), 16, 8, F.size("spec")))
            steps = steps.withColumn("spec", arrays.fixed_frames(arrays.standardised_matrix(F.col("spec"), per_band), 9, 11))
            for r in steps.collect():
                m = np.array(r.spec)
                want = np.concatenate([np.concatenate([b.mean(0), b.std(0), b.min(0), b.max(0)]) for b in (m[:, :5], m[:, 5:10])])
                assert np.allclose(got[r.id][0], want, atol=1e-9) and got[r.id][1] == r.valid


def test_filterbank_options():
    x = np.random.default_rng(2).normal(size=(3, 400))
    base = spectral.FbankConfig(8000, 10, 5, num_mel_bins=5)
    still = spectral.fbank(x, base)
    noisy = spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, num_mel_bins=5, dither=0.5, seed=1))
    assert np.array_equal(noisy, spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, num_mel_bins=5, dither=0.5, seed=1)))
    assert not np.allclose(still, noisy) and np.array_equal(still, spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, num_mel_bins=5, htk_compat=True)))
    log = spectral.FbankConfig(8000, 10, 5, impl="nnaudio", num_mel_bins=5)
    assert np.allclose(spectral.fbank(x, log), spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, impl="nnaudio", num_mel_bins=5, win_length=80)))
    short = spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, impl="nnaudio", num_mel_bins=5, win_length=40))
    inner = spectral.frames(x, 80, 40, True)[..., 20:60] * spectral.hann(40)
    power = np.abs(np.fft.rfft(np.pad(inner, ((0, 0), (0, 0), (20, 20))), axis=-1)) ** 2
    bank = spectral.mel_filters(np.linspace(0, 4000, 41), 5, 0.0, 4000.0, "slaney", True)
    assert np.allclose(short, np.log(power @ bank + np.finfo(np.float32).eps))
    hann, hamming = (spectral.fbank(x, spectral.FbankConfig(8000, 10, 5, impl="huggingface", num_mel_bins=5, f_max=4000.0, window_type=w)) for w in ("hann", "hamming"))
    assert not np.allclose(hann, hamming)
    with pytest.raises(ValueError):
        spectral.window("kaiser", 8, True)


def test_whole_job_is_stored_once(spark, tmp_path):
    from tonewheel.functions.chain import Chain
    from tonewheel.operators.blocks import blocks_of_arrays
    from tonewheel.plans.embedding import embed_blocks

    rows = [("a", 2000, np.sin(np.arange(900) / 7).tolist()), ("b", 1500, np.cos(np.arange(700) / 9).tolist())]
    stored = blocks_of_arrays(spark.createDataFrame(rows, "file string, rate int, x array<double>"), ["file"], "rate", size=200)
    chain = Chain(128, norm="all", mean=0.0, std=2.0)
    made = embed_blocks(spark, stored, str(tmp_path / "v"), ["file"], chain, 64, (1000, 800), decimate=True)
    want = {}
    for name, rate, x in rows:
        y = np.array(x)[None, ::2] if rate == 2000 else spectral.resample(np.array(x)[None], rate, 1000)
        y = spectral.resample(y, 1000, 800)[0]
        n = len(y)
        offsets = [r for r in range(0, n - 127, 64)]
        if offsets[-1] + 64 + 0.05 * 128 <= n:
            offsets.append(n - 128)
        cut = np.stack([y[o: o + 128] - y[o: o + 128].mean() for o in offsets]) / 2
        want[name] = spectral.spectral_statistics(cut).mean(0)
    got = {r.file: r.emb for r in made.collect()}
    assert all(np.allclose(got[f], want[f], atol=1e-9) for f in want) and sorted(got) == sorted(want)
    again = embed_blocks(spark, stored.limit(0), str(tmp_path / "v"), ["file"], chain, 64)
    assert again.count() == 2
