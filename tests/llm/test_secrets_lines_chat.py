import hashlib
import re

from tonewheel.llm import chat_collapse, line_dedup, secret_scan

FORMS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
}


def wanted(text):
    kept = {"assign": lambda m: len(m[1]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    found = [(m.start(), k, m.end()) for k, n in enumerate(FORMS) for m in re.finditer(FORMS[n], text or "", re.ASCII) if kept[n](m)]
    return [f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in sorted(found)]


def held(rows, texts):
    for row in rows:
        want = wanted(texts[row.doc_id])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == row.base_sha256, (row, want[:3])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w.startswith(k) for w in want) for k in FORMS]
        assert not want or set(want) <= set(row.spans.split(","))


def test_secrets(spark):
    texts = [
        None, "", "token: secret: abcdefghijklm", "TOKEN='abcdefghijkl' é api_key = x.y=zzzzzzzzzzzzz", "AKIAAKIA" + "B" * 11 + " AKIA1",
        "deadbeef" * 4 + " 0123456789abcde", "secret" + " " * 50_000 + "= abc", "a" * 30_000, "Password=" + "q" * 12 + "token=" + "r" * 12,
    ]
    docs = spark.createDataFrame([(k, t, f"s{k}", None) for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    held(secret_scan.secrets(docs).collect(), texts)
    assert secret_scan.secrets(docs.limit(0)).collect() == []


def test_owners_part_examples_from_live_values(spark):
    value = "Ab1" * 9
    rows = [(k, f"x {value} token=abcdefghijkl{k // 4}", f"s{k}", "en") for k in range(4)] + [(9, "y " + "Zz9" * 9, "s1", "en")]
    got = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0].n_example == 1 and got[0].n_live == 0 and "generic" not in got[0].spans
    assert "generic:2:29" in got[9].spans


def test_many_repositories_of_one_owner(spark):
    rows = [(k, "token=abcdefghijklm" + (" token=zyxwvutsrqponm" if k < 9 else ""), "s", f"r{k}") for k in range(10)]
    got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert all((r.n_example, r.n_live) == (1, int(r.doc_id < 9)) for r in got) and len(got) == 10


def test_secrets_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held(secret_scan.secrets(docs).collect(), dict(docs.select("doc_id", "text").collect()))


def test_repeated_lines(spark):
    line = "One two three four five six seven eight nine."
    rows = [(5, f"é {line}\n{line}", 1), (3, f"Intro here.\n  {line.upper()} More text", 2), (7, None, 3), (8, "", 4), (None, line, 5), (9, "short. short.", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, nth int")
    assert {tuple(r) for r in line_dedup.repeats(docs).collect()} == {(5, len(line) + 3, 2 * len(line) + 3, 3, 2)}
    assert line_dedup.repeats(docs.limit(0)).collect() == []


def test_hot_lines_are_joined_by_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = sorted(map(tuple, line_dedup.repeats(docs).collect()))
    monkeypatch.setattr(line_dedup, "HOT_PLACES", 2)
    assert sorted(map(tuple, line_dedup.repeats(docs).collect())) == plain and plain


def test_repeated_lines_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first, want = {}, set()
    for doc, text in sorted(docs.collect()):
        for m in line_dedup.UNIT.finditer(text):
            unit = line_dedup.normal(m[0])
            if len(unit.split()) >= 8:
                if unit in first:
                    want.add((doc, m.end(), first[unit]))
                first.setdefault(unit, doc)
    assert {(r.doc_id, r.end, r.first_doc_id) for r in line_dedup.repeats(docs).collect()} == want and want


def test_lines_of_short_sentences(spark):
    short = "We like it here. You may stay. Come in now."
    rows = [(1, f"Alpha.\n{short}\nBeta."), (2, f"Gamma.\n{short}\nNo."), (3, "We like it here. Go."), (4, "ha. " * 11), (5, "one two\nthree four\nfive six\nseven eight"),
            (6, "one two\n\nthree four\nFive six seven eight\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.passages(docs).collect()]
    texts = dict(rows)
    assert sorted(texts[d][s:e] for d, s, e, *_ in got if d == 2) == ["Come in now.", "We like it here.", "You may stay."]
    assert {(d, f, n) for d, _, _, f, n in got} == {(2, 1, 2), (4, 4, 4), (6, 5, 2)}
    assert sorted(s for d, s, *_ in got if d == 4) == [32, 36, 40] and sorted(s for d, s, *_ in got if d == 6) == [0, 9, 20]
    assert line_dedup.passages(docs.limit(0)).collect() == []


def test_repeats_of_whole_lines(spark):
    """Lines of eight words and more, found without any cut into sentences, go to their last word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts, gone = dict(docs.collect()), {}
    rows = line_dedup.passages(docs).collect()
    for r in rows:
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    seen, words, short = set(), 0, 0
    for doc in sorted(texts):
        for m in re.finditer("[^\n]+", texts[doc]):
            line = " ".join(m[0].lower().split())
            if len(line.split()) >= 8:
                if line in seen:
                    words += 1
                    short += all(len(u[0].split()) < 8 for u in line_dedup.UNIT.finditer(m[0]))
                    assert all(m.start() + w.start() in gone[doc] and m.start() + w.end() - 1 in gone[doc] for w in re.finditer(r"\S+", m[0]))
                seen.add(line)
    assert words > 50 and short > 10
    sentences = {(r.doc_id, r.start, r.end, r.first_doc_id, r.n_places) for r in line_dedup.repeats(docs).collect()}
    assert sentences < {tuple(r) for r in rows}


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b, a], 6: [a, ("assistant", "no")], None: [a]}
    rows = [(i, k, r, t, "x") for i, turns in convs.items() for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in chat_collapse.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string")).collect()}
    assert set(got) == {3, 5, 6} and got[3].n_same == 2
    assert got[3].rendered == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\n"
    assert chat_collapse.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_passages_are_shuffled_by_their_places(spark):
    """What meets by digest and by text is of fixed size: no run carries the places of its units."""
    docs = spark.createDataFrame([(k, f"Own {k}.\nWe like it here. You may stay. Come in now.") for k in range(3)], "doc_id long, text string")
    found = line_dedup.runs(docs)
    assert {k for k, t in found.dtypes if t.startswith("array")} == {"starts", "ends"}
    assert found.filter("d1 is not null and (starts is not null or ends is not null)").count() == 0
    assert found.filter("d1 is null").count() == 3
    got = line_dedup.passages(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and {(r.doc_id, r.first_doc_id, r.n_places) for r in got.collect()} == {(1, 0, 3), (2, 0, 3)}


def test_frequent_lines_meet_one_row_each(spark, monkeypatch):
    """Places are read once and joined to counts, one to one: no place is left out of that join or comes twice."""
    monkeypatch.setattr(line_dedup, "HOT_PLACES", 2)
    line = "One two three four five six seven eight nine."
    docs = spark.createDataFrame([(k, f"{line}\nOwn {k}.\n{line}") for k in range(400)], "doc_id long, text string")
    for found in (line_dedup.repeats(docs), line_dedup.passages(docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join LeftOuter") == 1 and "LeftAnti" not in plan and "Union" not in plan
        assert {(r.first_doc_id, r.n_places) for r in found.collect()} == {(0, 800)} and found.count() == 799
