import math
import random

import numpy as np
from pyspark.sql import functions as F

from tonewheel.llm import hard_negatives as module
from tonewheel.llm.hard_negatives import hard_negatives, products

SCHEMA = "vec_id long, label int, embedding array<float>, score string, found int, limits int, _a int"


def brute(rows, positives=5, k=10):
    own = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for ai, al, av in [r for r in own if r[0] % 100 == 0]:
        told = sorted((-sum(x * y for x, y in zip(av, v)), i, lab == al) for i, lab, v in own if i != ai and len(v) == len(av))
        for minus, pi, _ in [t for t in told if t[2]][:positives]:
            p = -minus
            held = [t for t in told if not t[2] and 30 * p <= 100 * -t[0] <= 90 * p][:k]
            out += [(ai, pi, r + 1, i, p, -m) for r, (m, i, _) in enumerate(held)]
    return sorted(out)


def got(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    found = hard_negatives(frame, F.col("vec_id") % 100 == 0, **how)
    return sorted(tuple(r) for r in found.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_brute_force_with_ties_copies_and_odd_rows(spark, monkeypatch):
    draw = random.Random(5)
    # few distinct values: many equal scores at every limit
    rows = [(i, draw.choice([1, 1, 1, 2, 3]), [draw.choice([0.0, 0.05, 0.1, -0.1, 0.2]) for _ in range(6)]) for i in range(1200)]
    rows += [(2000 + i, 2, [0.1] * 6) for i in range(400)]  # a third of all: one vector
    rows += [(3000, None, [0.1] * 6), (3001, 1, None), (3100, 1, [float("nan")] * 6), (3200, 1, [0.1, None]), (3300, 1, [float("inf"), 0.0]),
             (None, 1, [0.1] * 6), (3400, 2, [0.2, 0.2]), (3401, 2, [0.2, 0.1]), (3402, 1, [0.15, 0.15]), (3500, 9, [0.1] * 6), (3600, 2, []), (3601, 2, [])]
    draw.shuffle(rows)
    truth = brute(rows)
    assert len({r[0] for r in truth}) > 10
    assert got(spark, rows) == truth
    monkeypatch.setattr(module, "STRIP", 4)  # several strips and chunks, small slabs
    monkeypatch.setattr(module, "LEAST_CHUNK", 100)
    monkeypatch.setattr(module, "SLAB_ROWS", 37)
    monkeypatch.setattr(module, "SLAB_ANCHORS", 3)
    assert got(spark, rows) == truth


def test_repeated_rows_count_as_often(spark):
    rows = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (2, 2, [0.5, 0.0])]
    p, n = 256 * 256, 128 * 256
    assert got(spark, rows) == sorted([(100, 1, 1, 2, p, n), (100, 1, 2, 2, p, n)] * 2)


def test_no_rows_no_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, 1, [1.0]), (2, 2, [0.5])]) == []


def test_products_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]
    assert products(a, a)[0, 0] == module.MOST and products(a, -a)[0, 0] == module.NONE + 1


def test_very_long_vectors(spark):
    rows = [(100, 1, [0.01] * 50_000), (1, 1, [0.01] * 50_000), (2, 2, [0.007] * 50_000)]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1
