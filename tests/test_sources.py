"""Files written by the tests: headers, waveforms, lists, manifests, links, stores, streams."""

import hashlib
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewheel.functions import names
from tonewheel.functions import tables as tb
from tonewheel.operators.features import apply_kernel
from tonewheel.plans import catalog, embedding
from tonewheel.sources import files, links, manifest, metadata, reports, store
from tonewheel.streaming.landing import score_landing


def write_wav(path, samples, rate=8000, channels=1, width=2):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        if width == 3:
            f.writeframes(b"".join(int(v * (1 << 23)).to_bytes(4, "little", signed=True)[:3] for v in samples))
        else:
            f.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


def test_headers_and_waveforms(spark, tmp_path):
    tone = np.sin(np.arange(800) / 5)
    write_wav(tmp_path / "a" / "x.wav", tone)
    write_wav(tmp_path / "b" / "y.wav", tone[:240], rate=16000, width=3)
    facts = {os.path.basename(r["path"]): r for r in files.scan_headers(spark, str(tmp_path)).collect()}
    assert facts["x.wav"]["num_frames"] == 800 and facts["x.wav"]["sample_rate"] == 8000 and facts["x.wav"]["dur"] == 0.1
    assert facts["y.wav"]["num_frames"] == 240 and facts["y.wav"]["sample_rate"] == 16000
    got = {os.path.basename(r["path"]): (r["sr"], r["x"]) for r in files.waveforms(spark, str(tmp_path)).collect()}
    assert got["x.wav"][0] == 8000 and np.allclose(got["x.wav"][1], tone, atol=1e-4)
    assert np.allclose(got["y.wav"][1], tone[:240], atol=1e-6)


def test_more_channels_need_a_mixdown(spark, tmp_path):
    write_wav(tmp_path / "s" / "s.wav", [0.5, -0.5, 0.25, 0.75], channels=2)
    with pytest.raises(Exception, match="channels"):
        files.waveforms(spark, str(tmp_path)).collect()
    assert np.allclose(files.waveforms(spark, str(tmp_path), mixdown=True).first()["x"], [0.0, 0.5], atol=1e-4)


def test_csv_signals(spark, tmp_path):
    (tmp_path / "m.csv").write_text("t,cur,vib\n0,1.5,2\n1,2.5,4\n\n")
    rows = {r["channel"]: r["x"] for r in files.csv_signals(spark, str(tmp_path), ["vib", 1]).collect()}
    assert rows == {"vib": [2.0, 4.0], "cur": [1.5, 2.5]}
    plain = files.csv_signals(spark, str(tmp_path), [2], header=False).first()["x"]
    assert plain == [None, 2.0, 4.0]


def test_yearly_catalog_with_truth_and_rejects(spark, tmp_path):
    for rel in (
        "dev_data/fan/train/section_00_source_train_normal_0001_vel_5.wav",
        "dev_data/fan/test/section_01_target_test_anomaly_0002.wav",
        "eval_data/bandsaw/test/a.wav", "eval_data/bandsaw/test/b.wav", "dev_data/fan/supplemental/section_00_noise_0001_car_A1.wav",
    ):
        write_wav(tmp_path / "w" / rel, np.zeros(80))
    (tmp_path / "list.csv").write_text("bandsaw\na.wav,section_02_target_test_anomaly_0009_x_1.wav\nb.wav,oops,too,many\nnonsense\n")
    truth, bad_lines = metadata.parse_truth(metadata.numbered_lines(spark, str(tmp_path / "list.csv")), "dcase23")
    assert [tuple(r) for r in truth.collect()] == [("bandsaw", "a.wav", "section_02_target_test_anomaly_0009_x_1.wav")]
    assert sorted(r["line"] for r in bad_lines.collect()) == [2, 3]
    root = str(tmp_path / "w")
    good, bad = catalog.yearly(files.scan_headers(spark, root), root, "dcase23", truth)
    rows = {r["file"].split("/")[-1]: r for r in good.collect()}
    assert rows["a.wav"]["sec"] == 2 and rows["a.wav"]["domain"] == 1 and rows["a.wav"]["status"] == 1 and rows["a.wav"]["attri"] == "x_1_dcase23"
    one = rows["section_00_source_train_normal_0001_vel_5.wav"]
    assert (one["sec"], one["domain"], one["status"], one["attri"], one["num_frames"]) == (0, 0, 0, "vel_5_dcase23", 80)
    assert rows["section_01_target_test_anomaly_0002.wav"]["attri"] == "_dcase23"
    assert [r["file"].split("/")[-1] for r in bad.collect()] == ["b.wav"]
    extra, _ = catalog.supplementary(files.catalog(spark, root), root)
    row = extra.first()
    assert (row["type"], row["attri"], row["sett"]) == ("noise", "car_A1_sup_dcase25", "supple")
    out = str(tmp_path / "meta")
    metadata.write_metadata(good, out)
    back = spark.read.parquet(out)
    assert back.where("setn = 'eval'").count() == 1 and back.count() == 3


def test_metadata_csv_by_folder(spark, tmp_path):
    for setn in ("dev", "eval"):
        for sett in ("train", "test", "supple"):
            folder = tmp_path / "dcase23" / setn / sett
            folder.mkdir(parents=True)
            (folder / "fan.csv").write_text("file,path,mt,sec,domain,status,attri\nx,/x,fan,0,1,0,a\n")
    df = metadata.read_metadata(spark, str(tmp_path))
    assert df.count() == 4 and {r["dataset"] for r in df.collect()} == {"dcase23"}
    assert metadata.read_metadata(spark, str(tmp_path), conditions=["/dev/"]).count() == 2


def test_class_lists_and_keys(spark):
    rows = spark.createDataFrame([("/d/imbalance_6g_1_2.wav",), ("/d/normal_1.wav",), ("/d/other.wav",)], "path string")
    good, bad = catalog.fault_by_prefix(rows, "shaft")
    assert {(r["scene"], r["status"], r["ori"]) for r in good.collect()} == {
        ("imbalance", "anomaly", "imbalance_6g_1_2.wav"), ("normal", "normal", "normal_1.wav")}
    assert bad.count() == 1
    key = spark.range(1).select(names.recording_key(F.lit("a_b_c_d.flac"), 2, ".flac").alias("k"), names.recording_key(F.lit("x"), 1).alias("e")).first()
    assert key["k"] == "a_b.flac" and key["e"] == ""
    assert tb.CLASS_IDS["shaft"].index("normal") == 2


def test_manifest_on_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in "abc":
        (tmp_path / "d" / n).write_text(n)
    md5 = {n: hashlib.md5(n.encode()).hexdigest() for n in "abc"}
    text = f"# list\n\nMD5 ({tmp_path}/d/a) = {md5['a'].upper()}\n{md5['a']}  *{tmp_path}/d/b\n{md5['c']} {tmp_path}/d/c\n{md5['c']} {tmp_path}/d/none\nlonely\nshort {tmp_path}/d/a\n"
    (tmp_path / "list.md5").write_text(text)
    entries = manifest.parse_manifest(metadata.numbered_lines(spark, str(tmp_path / "list.md5")))
    counts = {r["status"]: r["n"] for r in manifest.audit_summary(manifest.audit(entries, manifest.file_checksums(spark, str(tmp_path / "d")))).collect()}
    assert counts == {"verified": 2, "mismatch": 2, "missing": 1}


def test_links_resolve(spark):
    cases = {"/a/b": "http://h/a/b", "c": "http://h/x/c", "../c": "http://h/c", "./c/./d?q=1": "http://h/x/c/d?q=1", "": "http://h/x/p?y=1",
             "#t": "http://h/x/p?y=1#t", "?z": "http://h/x/p?z", "//k/l": "http://k/l", "https://m/n": "https://m/n", "../../../up": "http://h/up"}
    html = "".join(f'<A class="q" HREF="{h}">t</a>' for h in cases)
    pages = spark.createDataFrame([("http://h/x/p?y=1#frag", html)], "url string, html string")
    assert {r["link"] for r in links.page_links(pages).collect()} == set(cases.values())


def test_discovery_follows_pages_once(spark):
    pages = spark.createDataFrame([
        ("http://h/d/", '<a href="s/">s</a><a href="one.zip">1</a><a href="http://else/x/">x</a>'),
        ("http://h/d/s/", '<a href="../">up</a><a href="two.RAR">2</a><a href="t">t</a>'),
        ("http://h/d/s/t", '<a href="/d/three.tar.gz">3</a>'), ("http://else/x/", '<a href="far.zip">f</a>'),
    ], "url string, html string")
    found = links.discover(pages, pages.where("url = 'http://h/d/'"), "http://h/d/")
    assert {r["link"] for r in found.collect()} == {"http://h/d/one.zip", "http://h/d/s/two.RAR", "http://h/d/three.tar.gz"}


def test_plan_reconcile(spark):
    found = spark.createDataFrame([("a", "u1"), ("b", "u2")], "dataset_name string, url string")
    plan = spark.createDataFrame([("a", "u0", "completed", 5), ("a", "u1", "failed", 0), ("z", "u9", "failed", 0)], "dataset_name string, url string, status string, total_size bigint")
    assert {(r["url"], r["status"]) for r in manifest.reconcile_plan(found, plan).collect()} == {("u1", "failed"), ("u2", "not_started")}


def test_stores(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.stored(spark, str(tmp_path / "s"), compute).count() == 3
    store.stored(spark, str(tmp_path / "s"), compute, overwrite=True)
    assert len(calls) == 2
    store.write_shards(spark.range(100).toDF("i"), str(tmp_path / "c"), 4, "i")
    assert store.read_shards(spark, str(tmp_path / "c"), 4, 100).count() == 100
    spans = [(r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "c")).groupBy("shard").agg(F.min("i").alias("a"), F.max("i").alias("b")).orderBy("a").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        store.read_shards(spark, str(tmp_path / "c"), 4, 99)


def test_submission_files(spark, tmp_path):
    df = spark.createDataFrame([("m", s, f"d/{s}{i}.wav", float(i), "test") for s in (0, 1) for i in range(3)], "mt string, sec int, file string, score double, sett string")
    rows = reports.submission_rows(df)
    reports.write_submission(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "decision_result"), schema="name string, decision int, mt string, sec int")
    assert back.where("decision = 1").count() == 2 and back.count() == 6


def test_signals_to_vectors(spark, tmp_path):
    signals = spark.createDataFrame([("a", [float(i % 7) for i in range(41)]), ("b", [1.0, 2.0])], "file string, x array<double>")
    segs = embedding.segments(signals, 20, 20)
    got = {(r["file"], r["offset"]): (r["valid_len"], r["x"]) for r in segs.collect()}
    assert set(got) == {("a", 0), ("a", 20), ("a", 21), ("b", 0)}
    assert got["b", 0] == (2, [-0.5, 0.5] + [0.0] * 18)
    vec = embedding.embed(spark, signals, str(tmp_path / "v"), 20, 20)
    assert vec.count() == 2 and len(vec.first()["emb"]) == 13
    cyc = embedding.segments(signals, 5, 5, fill="cycle").where("file = 'b'").first()["x"]
    assert cyc == [-0.5, 0.5, -0.5, 0.5, -0.5]


def test_kernel_over_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [5.0])], "i int, x array<double>")
    out = {r["i"]: r["s"] for r in apply_kernel(df, "x", "s", lambda x: x.sum(1, keepdims=True)).collect()}
    assert out == {1: [1.0], 2: [3.0], 3: [5.0]}


def test_landing_stream(spark, tmp_path):
    train = spark.createDataFrame([("t", "g", [1.0, 0.0])], "file string, g string, emb array<double>")
    spark.createDataFrame([("n", "g", [0.0, 1.0])], train.schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(train.schema).parquet(str(tmp_path / "in"))
    query = score_landing(stream, train, ["g"], str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["score"] == 1.0


def test_half_written_store_is_written_again(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(3).write.parquet(path)
    assert store.stored(spark, path, lambda: spark.range(9)).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert store.stored(spark, path, lambda: spark.range(9)).count() == 9


def test_shards_of_tied_order(spark, tmp_path):
    df = spark.range(100).withColumn("o", F.col("id") % 3)
    store.write_shards(df, str(tmp_path / "s"), 8, "o")
    assert store.read_shards(spark, str(tmp_path / "s"), 8, 100).count() == 100


def test_swapped_columns_are_an_error(spark, tmp_path):
    place = tmp_path / "d" / "dev" / "train"
    os.makedirs(place)
    (place / "fan.csv").write_text("path,file\np/x,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        metadata.read_metadata(spark, str(tmp_path), "file string, path string").collect()


def test_shards_with_fewer_rows_and_stopped_writes(spark, tmp_path):
    few = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    path = str(tmp_path / "few")
    store.write_shards(few, path, 8, "i")
    assert sorted(r.i for r in store.read_shards(spark, path, 8, 3).collect()) == [1, 2, 3]
    store.write_shards(few.limit(0), str(tmp_path / "none"), 4, "i")
    assert store.read_shards(spark, str(tmp_path / "none"), 4, 0).collect() == []
    lost = next(os.path.join(d, f) for d, _, names in os.walk(path) if "shard=" in d for f in names if f.endswith(".parquet"))
    os.remove(lost)
    with pytest.raises(ValueError, match="hold other rows"):
        store.read_shards(spark, path, 8, 3)
    few.write.parquet(str(tmp_path / "plain"))
    for gone in ("plain", "nowhere"):
        with pytest.raises(ValueError, match="no finished cache"):
            store.read_shards(spark, str(tmp_path / gone), 8, 3)


def test_csv_channels_of_split_files(spark, tmp_path):
    place = tmp_path / "c"
    place.mkdir()
    lines = ["t, vib,7"] + [f"{i},{i / 2},{i * 3}" for i in range(4000)]
    (place / "a.csv").write_text("\n".join(lines[:10] + ["", "  "] + lines[10:]) + "\n")
    (place / "b.csv").write_text("t,vib,7\n1,x,2\n3,4\n")
    wanted = spark.createDataFrame([(str(place / "a.csv"), "vib", 100, "n1"), (str(place / "a.csv"), "0", 200, "n2"), (str(place / "a.csv"), "7", 300, "n3"),
                                    (str(place / "b.csv"), "vib", 50, "n4"), (str(place / "b.csv"), "2", 50, "n5")], "path string, ch string, sr int, name string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = files.csv_channels(spark, str(place), wanted)
        assert spark.read.text(str(place)).rdd.getNumPartitions() > 3
        out = {}
        for r in sorted(got.collect(), key=lambda r: r.pos):
            assert r.pos == len(out.setdefault(r.name, []))
            out[r.name].append(r.value)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out == {"n1": [i / 2 for i in range(4000)], "n2": [float(i) for i in range(4000)], "n3": [i * 3.0 for i in range(4000)], "n4": [None, 4.0], "n5": [2.0, None]}
    bad = wanted.limit(1).withColumn("ch", F.lit("none"))
    with pytest.raises(Exception, match="no channel none"):
        files.csv_channels(spark, str(place), bad).collect()


def test_checksums_of_a_file_of_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK_BYTES", 1000)
    (tmp_path / "s").mkdir()
    body = bytes(range(256)) * 100
    (tmp_path / "s" / "x").write_bytes(body)
    got = {os.path.basename(r.path): r.actual for r in manifest.file_checksums(spark, str(tmp_path / "s")).collect()}
    assert got == {"x": hashlib.md5(body).hexdigest()}


def test_rejects_are_counted(spark):
    from pyspark.sql import Observation

    from tonewheel.operators import segments

    rows = [(1, 10, 8000), (2, 0, 8000), (3, None, 8000), (4, 5, None), (5, 5, 0)]
    seen = Observation("clips")
    kept, rejected = segments.split_empty(spark.createDataFrame(rows, "i int, num_frames int, sample_rate int"), counts=seen)
    assert [r.i for r in kept.collect()] == [1] and seen.get == {"clips": 5, "kept": 1, "rejected": 4}
    assert {r.i: r.reason for r in rejected.collect()} == {2: "no samples", 3: "unknown length", 4: "unknown rate", 5: "no rate"}


def test_crawl_writes_each_page_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(links, "shared_folder", lambda _: str(tmp_path))
    pages = spark.createDataFrame([(f"http://h/{i}", f'<a href="/{i + 1}">n</a><a href="/{i}.zip">z</a><a href="/0">back</a>') for i in range(6)], "url string, html string")
    found = links.discover(pages, pages.where("url = 'http://h/0'"), "http://h/")
    assert found.count() == 6
    (seen,) = [d for d, subs, _ in os.walk(tmp_path) if any(s.startswith("round=") for s in subs)]
    rounds = spark.read.schema("at string, round int").parquet(seen)
    assert rounds.count() == rounds.select("at").distinct().count() == 7


def test_null_groups_carry_their_value(spark):
    from tonewheel.operators.skew import forward_fill

    rows = [(None, i, 1 if i == 2 else None) for i in range(12)] + [("a", i, 5 if i == 0 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    got = forward_fill(df, ["g"], "pos", F.col("v"), "last", block=4)
    assert got.where("g is null and pos >= 2 and last = 1").count() == 10 and got.where("g = 'a' and last = 5").count() == 9


def test_fused_domains_keep_every_vector(spark):
    from tonewheel.plans import anomaly

    meta = spark.createDataFrame([("t0", 0, "train"), ("t1", 1, "train"), ("a", 0, "test")], "file string, domain int, sett string").selectExpr(
        "file", "'dev' setn", "'m' mt", "0 sec", "domain", "0 status", "sett", "'' path", "'' attri")
    vec = spark.createDataFrame([("t0", [1.0, 0.0]), ("t1", [0.0, 1.0]), ("a", [1.0, 0.2]), ("a", [0.3, 1.0]), ("a", [0.3, 1.0])], "file string, emb array<double>")
    got = anomaly.score(meta, vec, domains="min", normalise=False)
    assert got.count() == 3 and "_vector" not in got.columns
    assert all(abs(r.score - min(r.score_sou, r.score_tar)) < 1e-12 for r in got.collect())


def test_discovery_resolves_links_of_reached_pages_only(spark, monkeypatch):
    """Pages out of reach cost no links; long frontiers, which are not broadcast, find the same."""
    rows = [(f"http://h/{i}", f'<a href="http://h/{i * 2}">x</a><a href="/{i}.zip">z</a>') for i in range(1, 65)]
    pages, wrote, real = spark.createDataFrame(rows, "url string, html string"), [], links.settle
    monkeypatch.setattr(links, "settle", lambda df: wrote.append(df.count() if "link" in df.columns else 0) or real(df))
    for listed in (200_000, 0):
        monkeypatch.setattr(links, "LISTED", listed, raising=False)
        found = links.discover(pages, pages.where("url = 'http://h/3'"), "http://h/")
        assert {r.link for r in found.collect()} == {f"http://h/{i}.zip" for i in (3, 6, 12, 24, 48)}
        assert sum(wrote) == 10
        wrote.clear()
