import hashlib
import random
import re

from tonewheel.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
        "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15,
    }[kind]


def wanted(text):
    found = [(m.start(), k, m.end()) for k, n in enumerate(FORMS) for m in re.finditer(FORMS[n], text or "") if good(n, m[0])]
    return [f"{list(FORMS)[k]}:{s}:{e}" for s, k, e in sorted(found)]


TEXTS = [
    None, "", "plain", "a@b.com_x@y.co.uk é 😀 z@w.de", "1.2.3.4.5.6.7.8 and 300.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (017) 555-7713 x +12 +3 ((((", "4929348385146306 5500005555555559 79927398713", "x" * 3_000 + "@", "1" * 3_000, "a@" + "b." * 3_000 + "c",
    "+1" + "(" * 3_000, "me (at) host.org or me@host.org, tel 017 555 7713", "a@b..c a@-.- @b.c a@b.c.", "9" * 16 + " " + "0" * 14, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5\n6",
]


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, base int")


def held(got, texts):
    for row in got:
        want = wanted(texts[row.doc_id])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == row.base_sha256, (row, want[:5])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k) for w in want) for k in FORMS]
        assert set(want) <= set(row.spans.split(","))  | {""} or not want


def test_base_spans_of_hard_texts(spark):
    got = pii.personal_data(rows_of(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    held(got, TEXTS)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    held(pii.personal_data(docs).collect(), texts)


def test_redaction_takes_spans_out(spark):
    docs = spark.createDataFrame([(1, "see a@b.com now", 15), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: tuple(r) for r in pii.redacted(docs).collect()}
    assert got == {1: (1, "see [EMAIL] now", 15), 2: (2, None, None), 3: (3, "clean", 5)}


def test_no_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_runs(spark):
    texts = ["x" * 300_000 + "@", "1" * 200_000, "a@" + "b." * 60_000 + "c", "+1" + "(" * 100_000 + "1", "1." * 100_000]
    got = {r.doc_id: r.spans for r in pii.personal_data(rows_of(spark, texts)).collect()}
    assert got[0] == "" and got[1] == "" and got[2] == "email:0:120003" and "phone" not in got[3]


def test_redacted_keeps_columns_of_any_name(spark):
    rows = [(1, "write to me@host.org now", "b", [1], 24, "x"), (1, None, "b", None, 0, None), (None, "nothing", None, [], 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, all array<int>, n_chars long, cands string")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "write to [EMAIL] now", "b", [1], 20, "x"), (1, None, "b", None, 0, None), (None, "nothing", None, [], 7, "y")], key=str)


def test_other_forms_are_added(spark):
    draw = random.Random(5)

    def number(n):
        return "".join(draw.choice("123456789") for _ in range(n))

    def card():
        d = "4" + number(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    texts = [
        f"alpha na{number(2)}@mail{k % 9}.example.com beta {k % 250}.{k % 99 + 1}.7.{k % 80} gamma {card()} delta +1 ({number(3)}) {number(3)}-{number(4)} "
        f"eps token=ab{number(9)}cd" for k in range(300)
    ]
    forms = {
        "(017) 555-7713": "phone", "017 555 7713": "phone", "me12 (at) host.example.org": "email", "4111-1111-1111-1112": "card",
    }
    clean = ["on 2019-05-12 there", "years 1998 1999 2000 went", "sums 12.5 13.7 14.2 made", "hash ab1234567890123456cd", "host me (at) home", "only 42 of 1234"]
    asked = [f"alpha {form} beta" for form in forms] + clean
    got = {r.doc_id: r for r in pii.personal_data(rows_of(spark, texts + asked)).collect()}
    held(got.values(), texts + asked)
    for k, (form, kind) in enumerate(forms.items(), len(texts)):
        assert f"{kind}:6:{6 + len(form)}" in got[k].spans.split(","), (form, got[k].spans)
        assert got[k].n_added >= 1
    assert [got[k].spans for k in range(len(texts) + len(forms), len(texts) + len(asked))] == [""] * len(clean)
