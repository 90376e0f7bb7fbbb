import random
import re

from tonewheel.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k: k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    near = {i: [j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(sets[i]), min(seen))
    return out


def hard_rows():
    draw = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É é"), (7, "é é")]
    for family in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([12, 60, 400]))]
        for _ in range(draw.choice([2, 9, 40])):
            own = [draw.choice(words) if draw.random() < draw.choice([0.0, 0.005, 0.02]) else w for w in base]
            rows.append((len(rows), " ".join(own)))
    passage = " ".join(draw.choice(words) for _ in range(30))
    rows += [(len(rows) + k, passage + " " + " ".join(draw.choice(words) for _ in range(10 + k))) for k in range(60)]
    return rows


def test_components_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    monkeypatch.setattr(ngram_join, "FEW_ROWS", 4)
    rows = hard_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, rows[9][1], 1, "x")], "doc_id long, text string, n int, cls string")
    got = ngram_join.jaccard_components(docs, 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(rows, 4, 85)
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(rows) + 1


def test_no_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([(4, "a b c d e f", "x")] * 2 + [(2, "a b c d e f", "x"), (9, None, "x")], "doc_id long, text string, lang string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).select("doc_id", "component_id").collect()))
    assert got == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == [2, 9]
    assert ngram_join.jaccard_components(docs.limit(0)).collect() == []


def test_one_id_with_unlike_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "p"), (1, b, "p"), (2, a, "q"), (3, b, "q"), (3, b, "q"), (3, b, "r"), (None, a, "p"), (4, None, "p"), (4, None, "p"), (5, " ", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key string")
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted(map(tuple, left.collect()), key=str)
    assert got == sorted([(1, a, "p"), (1, b, "p"), (None, a, "p"), (4, None, "p"), (4, None, "p"), (5, " ", "p")], key=str)
    found = ngram_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.n_same) for r in found) == sorted(
        [(1, 1, 2), (1, 1, 4), (2, 1, 2), (3, 1, 4), (3, 1, 4), (3, 1, 4), (0, 0, 1), (4, 4, 1), (4, 4, 1), (5, 5, 1)])
    again = ngram_join.one_of_each(spark.createDataFrame([(7, b, "x"), (7, b, "x"), (9, b + " more", "x")], docs.schema))
    assert [r.doc_id for r in again.collect()] == [7]


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: (299_997, 1), 2: (299_998, 1), 3: (got[3][0], 3)}


def test_what_shares_one_key_or_is_unlike_in_size_is_not_compared(spark, monkeypatch):
    asked, possible = [], ngram_join._possible

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_possible", counted)
    rows = []
    for k in range(300):  # two texts with one shingle in common, which is a key of both in some of them
        rows += [(2 * k + side, f"p{k} q{k} r{k} s{k} " + " ".join(f"{side}x{k}y{w}" for w in range(8))) for side in (0, 1)]
    assert {r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(range(600))
    assert asked == [0, 0]
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words), (2, words + " more"), (3, " ".join([words] + [f"v{k}" for k in range(90)]))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and asked[2:] == [1, 0]
