"""Personal data by candidate gradient boosting: generators propose spans, boosted trees choose among them. Native only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.arrays import let
from tonewheel.llm.shared import matches
from tonewheel.session import settle

KINDS = ("email", "ip", "card", "phone")
# Base forms. Possessive loops and the look-behind change no match: they keep long runs from being tried from every
# place in them. \G lets a match begin right where the one before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall forms: they overlap each other and the base forms.
WIDE = {
    "email": r"(?:\G|(?<![^\s@<>()\[\]]))[^\s@<>()\[\]]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9]++(?:[.-][A-Za-z0-9]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[.][0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9])++",
    "phone": r"(?<![0-9+(])[+(]?[0-9][\x20().0-9-]{6,60}[0-9]",
}
HINT = {
    "email": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.rlike("[0-9]"),
}
FEATURES = [
    "length", "digits", "groups", "letters", "gaps", "dots", "plus", "brackets", "luhn", "octets", "before", "after", "named",
    *[f"is_{k}" for k in KINDS],
]
#: About so many examples are made at most for the trees, drawn by hash, from spans of at most so many code points;
#: every candidate of every text is scored.
MAX_TRAINING, LONGEST_EXAMPLE = 20_000, 200
LEAST_PRECISION = 0.995
NONE = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is right."""
    def summed(text: Column) -> Column:
        places = F.transform(F.split(F.reverse(text), ""), lambda d, i: let(
            d.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.aggregate(places, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0

    return F.when(F.length(digits) > 0, summed(digits)).otherwise(F.lit(False))


def octets(match: Column) -> Column:
    """Whether four dotted numbers are at most 255 each."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return let(parts, lambda ps: (F.size(ps) == 4) & F.forall(
        ps, lambda p: p.rlike("^[0-9]{1,3}$") & (F.try_to_number(p, F.lit("999")) <= 255)))


def holds(kind: str, match: Column) -> Column:
    """Whether a base match is kept."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(match)
    count = F.length(digits_of(match))
    return count.between(14, 19) & luhn(digits_of(match)) if kind == "card" else count.between(10, 15)


def _spans(text: Column, kind: str, form: str) -> Column:
    return F.when(HINT[kind](text), matches(text, form)).otherwise(F.expr(NONE))


def _before(text: Column, c: Column) -> Column:
    return F.substring(text, F.greatest(c["s"] - 23, F.lit(1)), F.least(c["s"], F.lit(24)))


def _after(text: Column, c: Column) -> Column:
    return F.substring(text, c["e"] + 1, 1)


def _features(k: Column, m: Column, before: Column, after: Column) -> Column:
    """Numbers on the form of a span and on what stands around it, in the order of ``FEATURES``."""
    numbers = [
        F.char_length(m), F.regexp_count(m, F.lit("[0-9]")), F.regexp_count(m, F.lit("[0-9]++")), F.regexp_count(m, F.lit("[A-Za-z]")),
        F.regexp_count(m, F.lit("[ -]")), F.regexp_count(m, F.lit(r"\.")), m.startswith("+").cast("int"),
        F.regexp_count(m, F.lit(r"[()\[\]]")),
        (F.length(digits_of(m)).between(14, 19) & luhn(digits_of(m))).cast("int"), octets(m).cast("int"),
        before.rlike("[A-Za-z0-9]$").cast("int"), after.rlike("[A-Za-z0-9]").cast("int"),
        before.rlike("(?i)mail|tel|phone|call|card|visa|host|addr").cast("int"),
        *[(k == rank).cast("int") for rank in range(len(KINDS))],
    ]
    return F.array(*[F.coalesce(n, F.lit(0)).cast("double") for n in numbers])


def _held(kind: str) -> Column:
    return F.filter(_spans(F.col("_text"), kind, BASE[kind]), lambda c: holds(kind, c["m"]))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda c: F.struct(
        c["s"].alias("s"), F.lit(rank).alias("k"), c["e"].alias("e"), c["m"].alias("m")))


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda c: c["k"] == rank)).cast("long")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``_row``, the kept columns as ``_kept``, ``base`` spans, the same with their surroundings (``told``), and ``cands``.

    ``cands`` are the spans of the wide forms that are no base span, with their features. Written once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_kept"), text.alias("_text"))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", _held(kind))
    rows = rows.withColumn("_base", F.concat(*[_ranked(F.col(f"_{kind}"), rank) for rank, kind in enumerate(KINDS)]))
    rows = rows.withColumn("_keys", F.transform("_base", _key))
    wide = F.concat(*[_ranked(_spans(F.col("_text"), kind, WIDE[kind]), rank) for rank, kind in enumerate(KINDS)])
    some = F.when(F.col("_text").rlike(r"[0-9@]|\(at\)|\[at\]"), wide).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,e:int,m:string>>)"))
    rows = rows.withColumn("_wide", F.filter(some, lambda c: ~F.array_contains(F.col("_keys"), _key(c))))
    own = F.col("_text")
    plain = F.transform("_base", lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    told = F.transform(F.filter("_base", lambda c: F.char_length(c["m"]) <= LONGEST_EXAMPLE), lambda c: F.struct(
        c["k"].alias("k"), c["m"].alias("m"), _before(own, c).alias("before"), _after(own, c).alias("after")))
    cands = F.transform("_wide", lambda c: F.struct(
        c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), _features(c["k"], c["m"], _before(own, c), _after(own, c)).alias("x")))
    return settle(rows.select(
        F.monotonically_increasing_id().alias("_row"), "_kept", F.array_sort(plain).alias("base"), told.alias("told"), cands.alias("cands")
    ))


def _key(c: Column) -> Column:
    """A span as one number: a text has fewer than 2^30 code points."""
    return F.shiftleft(c["s"].cast("long"), 33).bitwiseOR(F.shiftleft(c["k"].cast("long"), 31)).bitwiseOR(c["e"].cast("long"))


def _vectors(rows: DataFrame, *columns: str) -> DataFrame:
    flat = rows.select(*columns, *[F.col("x")[k].alias(n) for k, n in enumerate(FEATURES)])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(flat).select(*columns, "features")


def candidates(found: DataFrame) -> DataFrame:
    """``_row, span, kind, features``: a row per span of the wide forms that is no base span."""
    rows = found.filter("size(cands) > 0").select("_row", F.explode("cands").alias("c"))
    span = F.struct(F.col("c.s").alias("s"), F.col("c.k").alias("k"), F.col("c.e").alias("e"))
    return _vectors(rows.select("_row", span.alias("span"), F.col("c.k").alias("kind"), F.col("c.x").alias("x")), "_row", "span", "kind")


def rewritten(t: Column) -> Column:
    """``array<struct<kind, m, y, left, right>>``: a known span as it may be written otherwise, and what it must not be.

    Whether an example is personal data follows from the span it was made of and from what was done to it: other signs
    between the same digits, brackets for the at sign, or one mistyped digit leave it personal; too few or too many
    digits, dates, lists of numbers, a host without a dot, another kind's name or letters on either side don't.
    """
    m, d = t["m"], digits_of(t["m"])

    def of(kind: str, text: Column, y: float = 1.0, left: str = "", right: str = "") -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), text.alias("m"), F.lit(y).alias("y"), F.lit(left).alias("left"), F.lit(right).alias("right"))

    def parts(by: str, *cuts: tuple[int, int]) -> Column:
        return F.concat_ws(by, *[F.substring(d, at, n) for at, n in cuts])

    def glued(kind: str) -> list[Column]:
        return [of(kind, m, 0.0, left, right) for left, right in (("x", ""), ("", "x"), ("x", "x"))]

    local, fours, last = (-10, 3), [(1, 4), (5, 4), (9, 4), (13, 7)], F.substring(d, -1, 1).cast("int")
    forms = {
        "email": [
            of("email", m), *[of("email", F.regexp_replace(m, "@", sign)) for sign in (" (at) ", "(at)", " [at] ", "[at]")],
            of("email", F.regexp_replace(m, "@.*$", "@x"), 0.0), of("email", F.regexp_replace(m, "@.*$", " (at) x"), 0.0),
            of("email", F.regexp_replace(m, r"\.", ""), 0.0), of("email", F.regexp_replace(F.regexp_replace(m, r"\.", ""), "@", " (at) "), 0.0),
        ],
        "ip": [of("ip", m), of("ip", F.regexp_replace(m, "^[0-9]+", "300"), 0.0), of("phone", m, 0.0), of("card", m, 0.0), *glued("ip")],
        "card": [
            of("card", m), *[of("card", parts(by, *fours)) for by in (" ", "-", ".")],
            of("card", F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((last + 1) % 10).cast("string"))),
            of("card", F.substring(d, 1, 12), 0.0), of("card", F.substring(d, 1, 6), 0.0), of("card", F.concat(d, d), 0.0), of("phone", m, 0.0),
            of("phone", parts(" ", *fours), 0.0), *glued("card"),
        ],
        "phone": [
            of("phone", m), of("phone", F.regexp_replace(m, r"^\+", "")), *[of("phone", parts(by, local, (-7, 3), (-4, 4))) for by in (" ", "-", ".")],
            of("phone", F.concat(F.lit("("), F.substring(d, -10, 3), F.lit(") "), parts("-", (-7, 3), (-4, 4)))),
            of("phone", parts("-", (1, 4), (5, 2), (7, 2)), 0.0), of("phone", parts(" ", (1, 4), (5, 4), (-4, 4)), 0.0),
            of("phone", F.concat_ws(" ", *[parts(".", (at, 2), (at + 2, 1)) for at in (1, 4, 7)]), 0.0), of("phone", F.substring(d, 1, 8), 0.0),
            *[of("card", text, 0.0) for text in (m, d, parts(" ", local, (-7, 3), (-4, 4)), parts("-", (1, 4), (5, 2), (7, 2)))], *glued("phone"),
        ],
    }
    made = F.array(*forms[KINDS[-1]])
    for rank in reversed(range(len(KINDS) - 1)):
        made = F.when(t["k"] == rank, F.array(*forms[KINDS[rank]])).otherwise(made)
    return made


def examples(found: DataFrame, bound: int = MAX_TRAINING) -> DataFrame:
    """``_row, kind, y, features``: about ``bound`` examples made of base spans and as many from candidates inside of words."""
    def drawn(rows: DataFrame, each: int, *by: str) -> DataFrame:
        share = min(1.0, bound / each / max(rows.count(), 1))
        return rows.filter(F.pmod(F.xxhash64(*by), F.lit(1_000_003)) <= int(share * 1_000_003))

    spans = drawn(found.select("_row", F.posexplode("told").alias("at", "t")), 12, "_row", "at")
    made = spans.select("_row", "t", F.explode(rewritten(F.col("t"))).alias("r"))
    made = made.select("_row", F.col("r.kind").alias("kind"), F.col("r.y").alias("y"), _features(
        F.col("r.kind"), F.col("r.m"), F.concat("t.before", "r.left"),
        F.when(F.col("r.right") != "", F.col("r.right")).otherwise(F.col("t.after"))).alias("x"))
    before, after = FEATURES.index("before"), FEATURES.index("after")
    inside = found.select("_row", F.explode(F.filter("cands", lambda c: (c["x"][before] > 0) | (c["x"][after] > 0))).alias("c"))
    inside = drawn(inside, 1, "_row", "c.s", "c.e").select("_row", F.col("c.k").alias("kind"), F.lit(0.0).alias("y"), F.col("c.x").alias("x"))
    return _vectors(made.unionByName(inside), "_row", "kind", "y")


def fit(rows: DataFrame) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Boosted trees, and for each kind the least probability at which held-out examples are right often enough.

    ``rows``: ``_row``, ``kind``, ``features`` and ``y``; hand-labelled spans serve as well. A fifth of the texts is held
    out. None without both classes, or if no kind has such a threshold; a kind without one selects nothing.
    """
    sample = settle(rows.coalesce(2))
    part = F.pmod(F.xxhash64("_row", F.lit("held")), F.lit(5))
    train = sample.filter(part > 0)
    if train.select("y").distinct().count() < 2:
        return None
    trees = GBTClassifier(labelCol="y", maxIter=8, maxDepth=5, stepSize=0.3, seed=7).fit(train)
    grid = [k / 100 for k in range(50, 100)]
    p = vector_to_array("probability")[1]
    told = trees.transform(sample.filter(part == 0)).select("kind", "y", p.alias("p"))
    sums = [F.sum((F.col("p") >= t).cast("int")) for t in grid] + [F.sum((F.col("p") >= t).cast("int") * F.col("y")) for t in grid]
    least = {}
    for got in told.groupBy("kind").agg(*sums).collect():
        good = [t for k, t in enumerate(grid) if got[1 + k] and got[1 + len(grid) + k] >= LEAST_PRECISION * got[1 + k]]
        if good:
            least[got[0]] = min(good)
    return (trees, least) if least else None


def _with_added(found: DataFrame) -> DataFrame:
    """``found`` with ``all``: the base spans and those selected candidates that meet none of them."""
    model = fit(examples(found))
    if model is None:
        return found.withColumn("all", F.col("base"))
    trees, least = model
    threshold = F.lit(2.0)
    for kind, t in least.items():
        threshold = F.when(F.col("kind") == kind, t).otherwise(threshold)
    added = (
        trees.transform(candidates(found)).filter(vector_to_array("probability")[1] >= threshold)
        .groupBy("_row").agg(F.collect_set("span").alias("added"))
    )
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    apart = F.filter(F.coalesce("added", none), lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return found.join(added, "_row", "left").withColumn("all", F.array_sort(F.concat("base", apart)))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c["k"]], c["s"].cast("string"), c["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs`` (``doc_id``, ``text``).

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; base_sha256 is the digest of the
    base spans joined by commas, ``spans`` adds those the trees select and ``n_added`` counts them. Null and empty texts have none. Rows come back
    as often as they come in; ids may be null. Other columns are not read. The trees learn from base spans written in
    other ways (``rewritten``), since no table has marked spans; where the texts hold too few of them to learn from and to
    hold out, nothing is added to the base.
    """
    made = _with_added(scanned(docs, ["doc_id"]))
    counts = [_count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return made.select("_kept.doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"),
                       (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets, overlapping spans as one; n_chars follows.

    Other columns come back as they were, whatever their names; so do rows without a span, null texts included.
    """
    made = _with_added(scanned(docs, docs.columns))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    own = F.col("_kept")
    text = F.coalesce(own["text"].cast("string"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, c["s"] - a["at"]), names[c["k"]])
        return F.struct(F.greatest(a["at"], c["e"]).alias("at"), F.when(c["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    rebuilt = F.aggregate("all", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    changed = made.withColumn("_new", F.when(F.size("all") > 0, rebuilt).otherwise(own["text"]))
    return changed.select(*[
        F.col("_new").alias(c) if c == "text"
        else F.when(F.size("all") > 0, F.char_length("_new").cast("long")).otherwise(own[c]).alias(c) if c == "n_chars" else own[c].alias(c)
        for c in docs.columns
    ])
