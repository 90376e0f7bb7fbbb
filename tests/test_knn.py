"""Blocked search against brute force, votes, and whole evaluations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.operators import features, knn, pooling, votes
from tonewheel.plans import anomaly, diagnosis


def table(spark, n=120, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[10] = x[11] = x[12]  # copies
    rows = [(i, "hot" if i % 3 else "cold", int(i % 4), x[i].tolist(), "train" if i % 2 else "test") for i in range(n)]
    return spark.createDataFrame(rows, "file int, g string, cls int, emb array<double>, sett string"), x, rows


def brute(x, rows, k, group=True, metric="cosine"):
    out = {}
    for i, g, _, _, s in rows:
        if s != "test":
            continue
        found = []
        for j, h, _, _, t in rows:
            if t == "train" and (g == h or not group):
                d = 1 - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) if metric == "cosine" else np.linalg.norm(x[i] - x[j])
                found.append((round(d, 9), j))
        out[i] = [j for _, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("block", [8192, 7])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_search_equals_brute_force(spark, block, metric):
    df, x, rows = table(spark)
    hits = knn.knn_join(df.where("sett = 'test'"), df.where("sett = 'train'"), ["g"], 4, metric, block_rows=block)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r["file"], r["rank"])):
        got.setdefault(r["file"], []).append(r["neighbour"])
    assert got == brute(x, rows, 4, metric=metric)


def test_k_above_group_and_empty_group(spark):
    train = spark.createDataFrame([(1, "a", [1.0, 0.0])], "file int, g string, emb array<double>")
    test = spark.createDataFrame([(2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0])], "file int, g string, emb array<double>")
    rows = knn.knn_join(test, train, ["g"], 5).collect()
    assert [(r["file"], r["neighbour"], r["dist"]) for r in rows] == [(2, 1, 1.0)]
    assert [r["g"] for r in anomaly.missing_groups(test, train, ["g"]).collect()] == ["b"]


def test_train_finds_itself(spark):
    df, _, _ = table(spark)
    train = df.where("sett = 'train'")
    assert knn.anomaly_scores(train, train, ["g"]).agg(F.max("score")).first()[0] < 1e-12


def test_zscore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, score double")
    got = sorted((r["g"], r["score"]) for r in knn.znorm(df, ["g"]).where("g = 'a'").collect())
    assert got == [("a", -1.0), ("a", 1.0)]
    assert {r["score"] for r in knn.znorm(df, ["g"]).where("g = 'b'").collect()} == {None}


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "file string, rank int, ncls int, sim double, neighbour string")


def test_vote(spark):
    a, b, c = 0, 1, 2
    rows = [("x", 1, a, 0.9, "p"), ("x", 2, b, 0.5, "q"), ("x", 3, b, 0.5, "r")]
    rows += [("tie", 1, b, 0.5, "p"), ("tie", 2, a, 0.5, "q")]
    rows += [("neg", 1, a, -0.2, "p"), ("neg", 2, c, -0.1, "q")]
    got = {r["file"]: r["pred"] for r in votes.vote(hits_of(spark, rows), ["file"], 3).collect()}
    assert got == {"x": b, "tie": a, "neg": b}
    prob = votes.class_probabilities(hits_of(spark, rows), ["file"], 3).where("file = 'x'").first()["prob"]
    e = np.exp([0.9, 1.0, 0.0])
    assert np.allclose(prob, e / e.sum())
    first = votes.neighbour_lists(hits_of(spark, rows), ["file"]).where("file = 'x'").first()["pred"][0]
    assert first["sim"] == 0.9 and first["file"] == "p"
    ks = votes.for_every_k(hits_of(spark, rows), 2, 3).where("file = 'x'").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in ks} == {2: 2, 3: 3}


@pytest.mark.parametrize("block", [8192, 9])
def test_runs_share_one_product(spark, block):
    df, x, rows = table(spark, 60)
    masks = F.array(*[((F.col("file") * m) % 5 < 2).cast("tinyint") for m in (1, 3)])
    hits = knn.knn_runs(df.withColumn("in_test", masks), "in_test", 2, 3, block_rows=block)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r["run"], r["file"], r["rank"])):
        got.setdefault((r["run"], r["file"]), []).append(r["neighbour"])
    for run, m in enumerate((1, 3)):
        side = [(i, "", 0, None, "test" if (i * m) % 5 < 2 else "train") for i in range(60)]
        for file, near in brute(x, side, 3, group=False).items():
            assert got[run, file] == near


def test_fused_scores_take_the_lower(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), "dev", "fan", 0, i % 2, int(i % 7 == 0 and i % 4 == 0), "test" if i % 4 == 0 else "train", "p", "a", rng.normal(size=4).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "file string, setn string, mt string, sec int, domain int, status int, sett string, path string, attri string, emb array<double>")
    meta, vec = df.drop("emb"), df.select("file", "emb")
    out = anomaly.score(meta, vec, domains="min").collect()
    assert len(out) == 20 and all(r["score"] == min(r["score_sou"], r["score_tar"]) for r in out)
    both = anomaly.score(meta, vec, domains="min", score_train=True)
    train = both.where("sett = 'train'").collect()
    assert len(train) == 60 and all((r["score_sou"] is None) != (r["score_tar"] is None) for r in train)
    assert "attri" not in out[0].asDict() and anomaly.missing_vectors(meta, vec.where("file <> '3'")).count() == 1
    with pytest.raises(ValueError):
        anomaly.score(meta, vec, domains="min", dataset="dcase21")


def test_several_vectors_per_file(spark):
    rows = [("t", "train", [1.0, 0.0]), ("a", "test", [1.0, 0.0]), ("a", "test", [0.0, 1.0]), ("b", "test", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "file string, sett string, emb array<double>")
    meta = df.select("file", "sett").distinct().selectExpr("file", "'dev' setn", "'m' mt", "0 sec", "0 domain", "0 status", "sett", "'' path", "'' attri")
    out = {r["file"]: r["score"] for r in anomaly.score(meta, df.drop("sett"), pool="max", normalise=False).collect()}
    assert abs(out["a"] - 1.0) < 1e-12 and abs(out["b"] - (1 - 2**-0.5)) < 1e-12


def test_registered_detector(spark):
    anomaly.DETECTORS["zero"] = lambda test, train, keys, carry: test.select(*keys, "file", *carry, F.lit(0.0).alias("score"))
    rows = [("t", "train", [1.0]), ("a", "test", [1.0])]
    df = spark.createDataFrame(rows, "file string, sett string, emb array<double>")
    meta = df.selectExpr("file", "'dev' setn", "'m' mt", "0 sec", "0 domain", "0 status", "sett", "'' path", "'' attri")
    out = anomaly.score(meta, df.drop("sett"), {"knn": {"k": 1}, "zero": {}}, normalise=False)
    assert {r["detector"] for r in out.collect()} == {"knn", "zero"}


def test_group_pca_matches_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, f"g{i % 2}", x[i].tolist()) for i in range(60)], "file int, g string, emb array<double>")
    got = {r["file"]: r["emb"] for r in features.group_pca(df, df, "g", 2).collect()}
    for g in (0, 1):
        ids = [i for i in range(60) if i % 2 == g]
        centred = x[ids] - x[ids].mean(0)
        axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
        axes *= np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
        assert np.allclose([got[i] for i in ids], centred @ axes.T, atol=1e-9)


@pytest.mark.parametrize("how", ["sum", "mean", "std", "mean_std", "max", "min", "soft"])
def test_wide_pooling_equals_narrow(spark, how, monkeypatch):
    df, x, rows = table(spark, 40)
    narrow = {r["g"]: r["emb"] for r in pooling.pool_vectors(df, ["g"], how).collect()}
    monkeypatch.setattr(pooling, "WIDE", 2)
    wide = {r["g"]: r["emb"] for r in pooling.pool_vectors(df, ["g"], how).collect()}
    for g, v in narrow.items():
        assert np.allclose(v, wide[g])
        part = x[[r[0] for r in rows if r[1] == g]]
        want = {"sum": part.sum(0), "mean": part.mean(0), "std": part.std(0), "mean_std": np.r_[part.mean(0), part.std(0)],
                "max": part.max(0), "min": part.min(0), "soft": [part.sum(0).argmax()]}[how]
        assert np.allclose(v, want)


def test_hard_pooling_breaks_ties_low(spark):
    df = spark.createDataFrame([("f", [0.0, 1.0]), ("f", [1.0, 0.0])], "g string, emb array<double>")
    assert pooling.pool_vectors(df, ["g"], "hard").first()["emb"] == [0.0]


def test_repeated_runs_on_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i // 4, (i // 4) % 3, (rng.normal(size=4) + 4 * np.eye(4)[(i // 4) % 3]).tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "file int, ori int, cls int, emb array<double>")
    acc = diagnosis.repeated(df, "ori", 3, 3, (0.5,), 3).collect()
    assert len(acc) == 3 and all(r["macro_acc"] > 95 for r in acc)


def test_rows_of_one_id_stay_apart(spark):
    test = spark.createDataFrame([("a", "g", [1.0, 0.0]), ("a", "g", [0.0, 1.0]), ("b", "g", [1.0, 1.0])], "file string, g string, emb array<double>")
    train = spark.createDataFrame([(f"t{i}", "g", [1.0, i / 8]) for i in range(9)], "file string, g string, emb array<double>")
    for k in (1, 2):
        scores = [sorted(round(r.score, 9) for r in knn.anomaly_scores(test, train, ["g"], k, block_rows=b).collect()) for b in (2, 8192)]
        assert scores[0] == scores[1] and len(scores[0]) == 3


def test_bad_vectors_are_refused(spark):
    good = spark.createDataFrame([("a", "g", [1.0, 0.0])], "file string, g string, emb array<double>")
    for bad in ([1.0], None):
        train = good.union(spark.createDataFrame([("b", "g", bad)], good.schema))
        with pytest.raises(Exception, match="one length"):
            knn.knn_join(good, train, ["g"], 1).collect()


def test_pooling_has_one_meaning_for_all_widths(spark, monkeypatch):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 0.0])], "file string, emb array<double>")
    uneven = df.union(spark.createDataFrame([("b", [1.0, 2.0, 9.0])], df.schema))
    unknown = spark.createDataFrame([("c", None)], df.schema).union(df)
    for wide in (256, 1):
        monkeypatch.setattr(pooling, "WIDE", wide)
        assert [r.emb for r in pooling.pool_vectors(df, ["file"], "max").collect()] == [[3.0, 2.0]]
        for bad in (uneven, unknown):
            with pytest.raises(Exception, match="2 numbers expected"):
                pooling.pool_vectors(bad, ["file"], "max").collect()


def test_scoring_loses_no_row_in_silence(spark):
    meta = spark.createDataFrame([
        ("a", "dev", "fan", 0, "train"), ("b", "dev", "fan", 0, "test"), ("c", "dev", "fan", 1, "test"),
    ], "file string, setn string, mt string, sec int, sett string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [1.0, 0.0])], "file string, emb array<double>")
    with pytest.raises(ValueError, match="no train rows"):
        anomaly.score(meta, vectors)
    with pytest.raises(Exception, match="no vector for file b"):
        anomaly.score(meta.where("sec = 0"), vectors).collect()
