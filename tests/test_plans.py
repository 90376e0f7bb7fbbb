"""Splits, roll-ups, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonewheel import workloads
from tonewheel.functions.tables import MACHINES
from tonewheel.operators import labels, splits
from tonewheel.plans import rollup


def recordings(spark, n=60):
    return spark.createDataFrame([(f"r{i // 3}", i, (i // 3) % 3) for i in range(n)], "ori string, seg int, cls int")


def test_sealed_split(spark):
    df = recordings(spark)
    drawn = splits.sealed_splits(df, "ori", "cls", (0.5, 0.25), 3)
    out = splits.assign(df, "ori", drawn)
    sides = out.groupBy("run", "test_size", "ori").agg(F.countDistinct("side").alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 1
    tests = out.where("side = 'test'").groupBy("run", "test_size").agg(F.countDistinct("ori").alias("n")).collect()
    assert {(r["test_size"], r["n"]) for r in tests} == {(0.5, 10), (0.25, 5)}
    assert out.count() == 60 * 6
    kept = splits.coverage(df, "ori", "cls", drawn).collect()
    assert len(kept) == 6 and all(r["train_classes"] == 3 and r["test_classes"] == 3 for r in kept)


def test_five_recordings_give_three_tests(spark):
    df = spark.createDataFrame([(f"r{i}", i % 2) for i in range(5)], "ori string, cls int")
    out = splits.assign(df, "ori", splits.sealed_splits(df, "ori", None))
    assert out.where("side = 'test'").count() == 3


def test_impossible_split_fails(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "ori string, cls int")
    with pytest.raises(ValueError):
        splits.sealed_splits(df, "ori", "cls", max_tries=2)


def test_ratio_grid():
    grid = splits.ratio_grid()
    assert len(grid) == 19 and grid[0] == 0.05 and grid[-1] == 0.95


def test_mixing_and_shuffle(spark):
    a = spark.range(1000).toDF("id")
    mixed = splits.mix_sources([a, a], [1.0, 4.0], "id")
    n = {r["source_id"]: r["count"] for r in mixed.groupBy("source_id").count().collect()}
    assert n[1] == 1000 and 150 < n[0] < 350
    first = [r["id"] for r in splits.shuffled(a, "id", 1).collect()]
    assert sorted(first) == list(range(1000)) and first != sorted(first)
    assert first == [r["id"] for r in splits.shuffled(a.repartition(7), "id", 1).collect()]


def test_labels(spark):
    train = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "pos int, l string")
    test = spark.createDataFrame([(0, "c"), (1, "a")], "pos int, l string")
    seen = {r["l"]: r["id"] for r in labels.by_first_appearance([train, test], "l", "pos").collect()}
    assert seen == {"b": 0, "a": 1, "c": 2}
    assert {r["l"]: r["id"] for r in labels.by_sorted_union([train, test], "l").collect()} == {"a": 0, "b": 1, "c": 2}


# Published results of 14 models on 19 data sets (6 anomaly, 13 fault): values, then the three published means.
PUBLISHED = [
    ([63.87, 54.86, 56.34, 57.96, 55.30, 56.82], [58.88, 53.89, 64.02, 47.48, 80.95, 59.74, 98.18, 6.91, 10.93, 10.01, 11.59, 56.02, 35.54], 57.52, 45.70, 51.61),
    ([74.20, 60.50, 58.95, 63.31, 56.93, 59.09], [77.93, 68.17, 70.57, 52.87, 84.45, 62.37, 98.23, 5.98, 10.32, 10.95, 17.23, 74.18, 48.42], 62.16, 52.44, 57.30),
    ([66.99, 56.17, 56.75, 60.09, 56.40, 58.40], [47.93, 74.23, 89.43, 53.77, 84.56, 59.02, 96.06, 8.09, 12.96, 10.31, 12.65, 71.50, 49.95], 59.15, 51.57, 55.36),
    ([71.04, 59.48, 59.64, 62.63, 55.62, 58.46], [90.23, 98.96, 86.77, 72.61, 95.86, 76.35, 99.08, 12.72, 18.35, 17.42, 25.52, 74.90, 54.29], 61.15, 63.31, 62.23),
]


def test_published_means(spark):
    rows = [(m, t, f"{t}{i}", v) for m, p in enumerate(PUBLISHED) for t, vs in (("ad", p[0]), ("fd", p[1])) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "model int, task string, dataset string, score double")
    got = {(r["model"], r["task"]): r["score"] for r in rollup.benchmark_score(df, ["model"]).collect()}
    for m, (_, _, ad, fd, top) in enumerate(PUBLISHED):
        for task, want in (("ad", ad), ("fd", fd), ("overall", top)):
            assert abs(got[m, task] - want) <= 0.021
    best = {r["dataset"]: r["model"] for r in rollup.best_per_column(df).collect()}
    assert best["ad0"] == 1 and best["fd0"] == 3


def test_orders(spark):
    df = spark.createDataFrame([("run10",), ("run2",), ("run1",)], "n string")
    assert [r["n"] for r in df.orderBy(rollup.numeric_suffix(F.col("n"))).collect()] == ["run1", "run2", "run10"]
    cells = spark.createDataFrame([("5.5M",), ("90M",), ("-",), ("1130M",)], "c string")
    assert [r["c"] for r in cells.orderBy(*rollup.leaderboard_order(F.col("c"))).collect()] == ["1130M", "90M", "5.5M", "-"]
    m = spark.createDataFrame([("fan", "eval"), ("bearing", "eval"), ("fan", "dev")], "mt string, setn string")
    assert [tuple(r) for r in m.orderBy(*rollup.machine_order(m, MACHINES["dcase22"])).collect()] == [("bearing", "eval"), ("fan", "dev"), ("fan", "eval")]


def test_run_statistics(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0)], "k string, run int, value double")
    rows = {r["k"]: r for r in rollup.run_statistics(df, ["k"], [0, 1]).collect()}
    assert (rows["a"]["run0"], rows["a"]["run1"], rows["a"]["mean"], rows["a"]["std"]) == (1.0, 3.0, 2.0, 1.41)
    assert rows["b"]["run1"] is None and rows["b"]["std"] is None


def test_entry_and_registry(spark, sf):
    df = entry.entry(spark)
    assert df.columns == ["level", "setn", "mt", "sec", "metric", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(workloads.QUERIES) <= set(entry.queries())
    assert set(workloads.QUERIES) - set(entry.oracle_sql()) == {"group_pca"}
