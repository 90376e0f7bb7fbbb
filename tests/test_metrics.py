"""Hand-sized ROC, accuracy and curve cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tonewheel.operators import metrics, roc
from tonewheel.plans import anomaly, diagnosis


def auc_of(spark, rows, target=1 << 20, f=0.1):
    df = spark.createDataFrame(rows, "g string, y int, s double")
    out = roc.roc_by_group(df, ["g"], F.col("y"), F.col("s"), f, target)
    return {r["g"]: (r["auc"], r["pauc"]) for r in out.collect()}


def test_golden_cases(spark):
    rows = [("perfect", y, float(s)) for s, y in ((1, 0), (2, 0), (3, 1), (4, 1))]
    rows += [("equal", y, 5.0) for y in (0, 0, 1, 1)] + [("one", 1, 1.0), ("one", 1, 2.0)]
    got = auc_of(spark, rows)
    assert got["perfect"] == (1.0, 1.0)
    assert got["equal"][0] == 0.5 and abs(got["equal"][1] - 0.5) < 1e-12
    assert got["one"] == (None, None)


def brute(points):
    pos = [s for y, s in points if y == 1]
    neg = [s for y, s in points if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting_in_ranges(spark):
    rng = random.Random(5)
    rows = [("h" if i % 3 else "k", int(rng.random() < 0.4), float(rng.randint(0, 60))) for i in range(500)]
    want = {g: brute([r[1:] for r in rows if r[0] == g]) for g in "hk"}
    plain, ranged = auc_of(spark, rows), auc_of(spark, rows, target=8)
    for g in "hk":
        assert abs(plain[g][0] - want[g]) < 1e-12 and abs(ranged[g][0] - want[g]) < 1e-12
        assert abs(plain[g][1] - ranged[g][1]) < 1e-12
    turned = auc_of(spark, [(g, y, -s) for g, y, s in rows])
    assert abs(turned["h"][0] + plain["h"][0] - 1) < 1e-12


def test_partial_area_interpolates_the_last_step(spark):
    # one negative above all positives out of four: the curve is flat up to 0.25, then full
    rows = [("g", 0, 9.0)] + [("g", 1, 5.0)] * 2 + [("g", 0, 1.0)] * 3
    f = 0.5
    area = 0.25
    want = 0.5 * (1 + (area - 0.5 * f * f) / (f - 0.5 * f * f))
    assert abs(auc_of(spark, rows, f=f)["g"][1] - want) < 1e-12


def test_harmonic_mean(spark):
    df = spark.createDataFrame([("a", 50.0), ("a", 100.0), ("b", 0.0), ("b", 9.0), ("c", None)], "g string, v double")
    got = {r["g"]: r["h"] for r in df.groupBy("g").agg(metrics.hmean("v").alias("h")).collect()}
    assert abs(got["a"] - 200 / 3) < 1e-9 and got["b"] == 0.0 and got["c"] is None
    row = spark.createDataFrame([(50.0, 100.0, None)], "a double, b double, c double")
    row = row.select(metrics.hmean_of("a", "b").alias("x"), metrics.hmean_of("a", "c").alias("y")).first()
    assert abs(row["x"] - 200 / 3) < 1e-9 and row["y"] is None


def test_two_macro_accuracies(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "cls string, pred string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scene string")
    report = metrics.class_report(pred, classes=classes)
    rows = {r["scene"]: (r["pred"], r["correct"], r["all"], r["acc"]) for r in report.collect()}
    assert rows == {"a": (1, 1, 2, 50.0), "b": (1, 0, 0, None), "c": (1, 1, 1, 100.0), "d": (0, 0, 0, None)}
    acc = metrics.accuracy(report).first()
    assert acc["macro_acc"] == 75.0 and acc["macro_acc_lib"] == 50.0 and abs(acc["micro_acc"] - 200 / 3) < 1e-9


def simpson(x, y):
    """Parabola through each pair of intervals, and through the last three points for an odd one out."""
    import numpy as np

    total, n = 0.0, len(x) - 1
    for i in range(0, n - 1, 2):
        c = np.polyfit(x[i : i + 3], y[i : i + 3], 2)
        total += np.polyval(np.polyint(c), x[i + 2]) - np.polyval(np.polyint(c), x[i])
    if n % 2:
        c = np.polyfit(x[-3:], y[-3:], 2)
        total += np.polyval(np.polyint(c), x[-1]) - np.polyval(np.polyint(c), x[-2])
    return total


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_curve_area(spark, n):
    rng = random.Random(n)
    x = [0.0] + sorted(rng.random() for _ in range(n - 2)) + [1.0]
    y = [math.sin(3 * v) for v in x]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    assert abs(metrics.curve_area(df, [], "x", "y").first()["area"] - simpson(x, y)) < 1e-9
    trapezoid = sum((b - a) * (p + q) / 2 for a, b, p, q in zip(x, x[1:], y, y[1:]))
    assert abs(metrics.curve_area(df, [], "x", "y", "trapezoid").first()["area"] - trapezoid) < 1e-12


def test_split_curve_starts_at_chance(spark):
    summary = spark.createDataFrame([(t, 100.0) for t in (0.25, 0.5, 0.75)], "test_size double, mean double")
    area = diagnosis.split_curve(summary, 2, method="trapezoid").first()["area"]
    assert abs(area - (0.75 * 0.25 + 0.75) * 100) < 1e-9


def test_histogram_and_median(spark):
    df = spark.createDataFrame([("g", float(i), i % 2) for i in range(50)] + [("c", 1.0, 0)] * 3, "g string, score double, status int")
    bins = metrics.score_histogram(df, ["g"]).where("g = 'g'").agg(F.count("*"), F.sum("normal"), F.sum("anomaly"), F.max("bin")).first()
    assert tuple(bins) == (49, 25, 25, 48)
    assert metrics.score_histogram(df, ["g"]).where("g = 'c'").first()["normal"] == 3
    assert {r["g"]: r["median"] for r in metrics.group_median(df, ["g"], target_rows=7).collect()} == {"g": 24.5, "c": 1.0}
    assert metrics.median_decision(df, ["g"]).where("g = 'g'").agg(F.sum("decision")).first()[0] == 25


def test_report_levels_round_before_rolling_up(spark):
    rows = [("dev", "m", sec, d, y, float(s)) for sec in (0, 1) for d in (0, 1) for y, s in ((0, 1), (0, 3), (1, 2), (1, 4))]
    scores = spark.createDataFrame(rows, "setn string, mt string, sec int, domain int, status int, score double")
    lines = {(r["level"], r["sec"], r["metric"]): r["value"] for r in anomaly.report(scores, 22).collect()}
    assert lines["section", 0, "auc_s"] == 75.0
    assert lines["total", None, "hmean"] == lines["machine", None, "hmean"]
