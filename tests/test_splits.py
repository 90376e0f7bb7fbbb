"""The limit of a split by rounds of histograms, against sorting."""

import hashlib
from math import ceil

import pytest
from pyspark.sql import functions as F

from tonewheel.operators import splits


def md5(seed, unit):
    return hashlib.md5(f"{seed}|{unit}".encode()).hexdigest()


@pytest.mark.parametrize("prefix,fetched", [(3, 256), (1, 4), (1, 1)])
def test_limits_equal_sorting(spark, monkeypatch, prefix, fetched):
    monkeypatch.setattr(splits, "PREFIX", prefix)
    monkeypatch.setattr(splits, "FETCHED", fetched)
    df = spark.range(700).select(F.col("id").alias("u"), (F.col("id") % 3).alias("c")).union(spark.createDataFrame([(None, 1)], "u long, c long"))
    for s in splits.sealed_splits(df, "u", None, (0.0, 0.001, 0.3, 1.0), 3, seed=5):
        m = ceil(s.test_size * 700 - 1e-9)
        order = sorted(md5(s.seed, u) for u in range(700))
        assert s.limit == (order[m - 1] if m else "")
        assert splits.assign(df.where("u is not null"), "u", [s]).where("side = 'test'").count() == m


def classes_on(seed, t, units):
    order = sorted(units, key=lambda u: md5(seed, u))
    m = ceil(t * len(units) - 1e-9)
    return [{c for u in side for c in units[u]} for side in (order[:m], order[m:])]


def test_first_good_seed_beyond_twenty_tries(spark):
    """Ten classes of two recordings, half of them: only a draw in hundreds has one of each on both sides."""
    units = {u: [u % 6] for u in range(12)}
    df = spark.createDataFrame([(u, c, k) for u, cs in units.items() for c in cs for k in range(3)], "u long, c long, k int")
    for s in splits.sealed_splits(df, "u", "c", (0.5,), 2, seed=1):
        good = [x for x in range(1 + s.run, s.seed + 1, splits.SEED_STEP) if all(len(k) == 6 for k in classes_on(x, 0.5, units))]
        assert good == [s.seed]
    with pytest.raises(ValueError, match="after 2 tries"):
        splits.sealed_splits(df, "u", "c", (0.5,), 2, seed=1, max_tries=2)


def test_what_cannot_be_split_is_known_beforehand(spark):
    lone = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "u int, c string")
    with pytest.raises(ValueError, match="1 of 2 classes"):
        splits.sealed_splits(lone, "u", "c")
    few = spark.createDataFrame([(i, i % 5) for i in range(20)], "u int, c int")
    with pytest.raises(ValueError, match="4 of 20 recordings for 5 classes"):
        splits.sealed_splits(few, "u", "c", (0.2,))
    with pytest.raises(ValueError, match="no recording on a side"):
        splits.sealed_splits(few, "u", "c", (0.0,))


def test_recordings_of_several_classes(spark):
    units = {u: [0, 1 + u % 3] for u in range(30)}
    df = spark.createDataFrame([(u, c) for u, cs in units.items() for c in cs], "u long, c long")
    for s in splits.sealed_splits(df, "u", "c", (0.1, 0.5), 3, seed=3):
        assert all(len(k) == 4 for k in classes_on(s.seed, s.test_size, units))
        row = splits.coverage(df, "u", "c", [s]).first()
        assert row.classes == row.train_classes == row.test_classes == 4


def test_sums_of_sides_equal_assigned_rows(spark):
    df = spark.range(900).select((F.col("id") % 211).alias("u"), (F.col("id") % 3).alias("c"), F.col("id").alias("v"))
    drawn = splits.sealed_splits(df, "u", "c", (0.1, 0.5, 0.9), 3) + [splits.Split(7, 0.0, 111, ""), splits.Split(8, 1.0, 5, "g")]
    sided = splits.assign(df, "u", drawn)
    # a row is hashed once per seed, below the list of that seed's splits
    plan = sided._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, line in enumerate(plan) if "md5(" in line) > min(i for i, line in enumerate(plan) if "Generate" in line)
    want = sided.groupBy("run", "test_size", "c").agg(
        F.sum(F.when(F.col("side") == "train", F.col("v"))).alias("train"), F.sum(F.when(F.col("side") == "test", F.col("v"))).alias("test"))
    got = splits.side_sums(df, "u", drawn, ["c"], F.col("v"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3 * len(drawn)
