"""Stored blocks against whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.functions import spectral
from tonewheel.operators import blocks, segments

SIGNALS = [("a", 1000, 337), ("b", 3000, 512), ("c", 1500, 200), ("d", 44100, 999), ("e", 700, 64), ("f", 2000, 1), ("g", 2000, 65), ("h", 1000, 30)]


def signal(n, seed):
    return np.random.default_rng(seed).normal(size=n)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f, r, [float(v) for v in signal(n, i)]) for i, (f, r, n) in enumerate(SIGNALS)] + [("z", 1000, []), ("y", 1000, None)]
    return spark.createDataFrame(rows, "file string, rate int, x array<double>")


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.file, r.start)):
        assert r.start == len(out.setdefault(r.file, []))
        out[r.file] += r.x
        assert r.start + len(r.x) <= r.n
    return out


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_blocks_hold_the_signal(spark, stored, size):
    cut = blocks.blocks_of_arrays(stored, ["file"], "rate", size=size)
    whole = joined(cut)
    assert max(len(r.x) for r in cut.collect()) <= size and sorted(whole) == sorted(f for f, _, _ in SIGNALS)
    for i, (f, _, n) in enumerate(SIGNALS):
        assert whole[f] == signal(n, i).tolist()
    samples = stored.select("file", "rate", F.size("x").cast("long").alias("pos_n"), F.posexplode("x").alias("pos", "value"))
    assert joined(blocks.blocks_of_samples(samples, ["file"], F.col("rate"), size=size)) == whole
    again = blocks.reblocked(cut, ["file"], 50)
    assert joined(again) == whole and max(len(r.x) for r in again.collect()) <= 50


@pytest.mark.parametrize("size,win,hop", [(7, 20, 10), (64, 16, 8), (64, 20, 30), (5000, 100, 100), (10, 100, 33)])
def test_windows(spark, stored, size, win, hop):
    cut = blocks.blocks_of_arrays(stored, ["file"], "rate", size=size)
    got = {(r.file, r.seg): (r.offset, r.x) for r in blocks.windows_of_blocks(cut, ["file"], win, hop).collect()}
    want = {}
    plan = segments.segment_index(stored.select("file", F.size("x").alias("n")).filter("n > 0"), segments.sliding_offsets(F.col("n"), win, hop))
    whole = {f: signal(n, i) for i, (f, _, n) in enumerate(SIGNALS)}
    for r in plan.collect():
        want[r.file, r.seg] = (r.offset, whole[r.file][r.offset: r.offset + win].tolist())
    assert got == want


@pytest.mark.parametrize("target,decimate", [(1000, False), (1000, True), (1600, False)])
def test_resampled_blocks_agree_with_whole_signals(spark, stored, target, decimate):
    size = 1100 if target == 1600 else 600  # 44.1 kHz sees 268 samples on both sides
    for cut_at in (size, 5000):
        got = joined(blocks.resampled_blocks(blocks.blocks_of_arrays(stored, ["file"], "rate", size=cut_at), ["file"], target, decimate))
        for i, (f, rate, n) in enumerate(SIGNALS):
            x = signal(n, i)
            want = x[:: rate // target] if decimate and rate % target == 0 else spectral.resample(x[None], rate, target)[0]
            assert len(got[f]) == len(want) and np.allclose(got[f], want, atol=1e-12), (f, cut_at)


def test_many_borders(spark):
    x = signal(4000, 99)
    one = spark.createDataFrame([("a", 3000, x.tolist())], "file string, rate int, x array<double>")
    for size in (44, 47, 64, 333):
        for target in (2000, 1000, 4500):
            got = joined(blocks.resampled_blocks(blocks.blocks_of_arrays(one, ["file"], "rate", size=size), ["file"], target))
            assert np.allclose(got["a"], spectral.resample(x[None], 3000, target)[0], atol=1e-12)
    two = blocks.reblocked(blocks.resampled_blocks(blocks.blocks_of_arrays(one, ["file"], "rate", size=64), ["file"], 2000), ["file"], 100)
    again = joined(blocks.resampled_blocks(two, ["file"], 1600))["a"]
    assert np.allclose(again, spectral.resample(spectral.resample(x[None], 3000, 2000), 2000, 1600)[0], atol=1e-12)


def test_small_blocks_are_refused(spark):
    x = signal(400, 1)
    one = spark.createDataFrame([("a", 3000, x.tolist())], "file string, rate int, x array<double>")
    with pytest.raises(Exception, match="shorter than the filter"):
        blocks.resampled_blocks(blocks.blocks_of_arrays(one, ["file"], "rate", size=20), ["file"], 1000).collect()


def test_no_rate(spark):
    rows = [("a", None, [1.0]), ("b", 0, [1.0]), ("c", -5, [1.0])]
    one = spark.createDataFrame(rows, "file string, rate int, x array<double>")
    assert blocks.resampled_blocks(blocks.blocks_of_arrays(one, ["file"], "rate"), ["file"], 1000).collect() == []
