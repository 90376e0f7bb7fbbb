"""Ranged windows must equal plain windows, whatever the group sizes."""

import random

from pyspark.sql import functions as F

from tonewheel.operators import skew


def hot_table(spark, n=900):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 400), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v int, id int"), rows


def test_positions_of_a_hot_group(spark):
    df, rows = hot_table(spark)
    got = {r["id"]: (r["pos"], r["pos_n"]) for r in skew.positions(df, ["g"], ["v", "id"], target_rows=20).collect()}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(part):
            assert got[r[2]] == (i, len(part))


def test_ranges_are_balanced(spark):
    df, rows = hot_table(spark)
    hot = skew.hot_groups(df, ["g"], 20)
    sizes = skew.with_range(df, ["g"], ["v", "id"], hot, 20).where("g = 'hot'").groupBy("_range").count().collect()
    assert len(sizes) >= 15
    assert max(r["count"] for r in sizes) < 120


def test_global_positions_need_no_key(spark):
    df, rows = hot_table(spark, 200)
    got = {r["id"]: r["pos"] for r in skew.positions(df, [], ["v", "id"], target_rows=10).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_running_sums_agree_with_and_without_ranges(spark):
    df, _ = hot_table(spark)
    runs = [
        {(r["g"], r["id"]): (r["v_run"], r["v_all"]) for r in skew.running_sums(df, ["g"], ["v", "id"], ["v"], desc, t).collect()}
        for desc in (True, False) for t in (1 << 20, 25)
    ]
    assert runs[0] == runs[1] and runs[2] == runs[3] and runs[0] != runs[2]


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, i, i) for i in range(30)] + [("a", i, i) for i in range(60)], "g string, v int, id int")
    out = skew.running_sums(df, ["g"], ["v"], ["id"], target_rows=20)
    assert out.count() == 90
    assert out.where("g is null").agg(F.max("id_run")).first()[0] == sum(range(30))
    assert {r[0] for r in out.where("g is null").select("id_all").distinct().collect()} == {sum(range(30))}
    stats = skew.with_group_stats(df, ["g"], top=F.max("v"))
    assert {(r.g, r.top) for r in stats.select("g", "top").distinct().collect()} == {(None, 29), ("a", 59)}


def test_forward_fill_across_blocks(spark):
    rows = [("a", i, i if i in (2, 9) else None) for i in range(20)] + [("b", 0, None), ("b", 1, 7)]
    df = spark.createDataFrame(rows, "g string, line int, v int")
    got = {(r["g"], r["line"]): r["f"] for r in skew.forward_fill(df, ["g"], "line", F.col("v"), "f", block=4).collect()}
    assert [got["a", i] for i in range(20)] == [None] * 2 + [2] * 7 + [9] * 11
    assert got["b", 0] is None and got["b", 1] == 7


def test_group_stats_and_top_k(spark):
    df, rows = hot_table(spark, 100)
    whole = skew.with_group_stats(df, [], m=F.max("v"))
    assert {r["m"] for r in whole.collect()} == {max(r[1] for r in rows)}
    assert skew.top_k(df, ["g"], [F.col("v"), F.col("id")], 2).groupBy("g").count().agg(F.max("count")).first()[0] == 2


def test_ranges_within_ranges(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_RANGES", 3)
    rows = [(None if i % 3 else "a", i * 7919 % 1000, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = skew.running_sums(df, ["g"], ["v", "id"], ["id"], target_rows=20)
    plain = skew.running_sums(df, ["g"], ["v", "id"], ["id"])
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    cut = skew.with_range(df, ["g"], ["v", "id"], skew.hot_groups(df, ["g"], 20), 20)
    assert cut.groupBy("g", "_range").count().agg(F.max("count")).first()[0] < 120


def test_ties_are_gathered_once(spark):
    df = spark.createDataFrame([(5, i) for i in range(300)] + [(i, i) for i in range(20)], "v int, id int")
    got = {(r.v, r.id): r.pos_n for r in skew.positions(df, [], ["v"], target_rows=30).collect()}
    assert len(got) == 319 and set(got.values()) == {320}
