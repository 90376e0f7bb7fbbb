"""Secret scans with corpus-wide ownership: how many repositories and owners a candidate is found with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.llm.shared import matches
from tonewheel.session import settle

KINDS = ("assign", "access", "hex", "generic")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
# A run of a class is either long enough or not: asking for its length right away changes no match.
FORMS = {
    "assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}+", "hex": "(?<![0-9a-f])[0-9a-f]{16,}+",
    "generic": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
HINT = {
    "assign": lambda t: t.rlike("(?i:passw|secret|token|api_?key)"), "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{16}"), "generic": lambda t: t.rlike("[A-Za-z0-9+/_-]{20}"),
}
#: A value that so many owners, or so many repositories of fewer owners, have is a widely copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 10
NONE = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def _held(text: Column, kind: str) -> Column:
    found = F.when(HINT[kind](text), matches(text, FORMS[kind])).otherwise(F.expr(NONE))
    if kind == "assign":
        return F.filter(found, lambda c: F.length(F.regexp_extract(c["m"], ASSIGN, 1)) >= 12)
    if kind == "generic":
        return F.filter(found, lambda c: c["m"].rlike("[0-9]") & c["m"].rlike("[a-z]") & c["m"].rlike("[A-Z]"))
    return found


def _described(text: Column, rank: int) -> Column:
    kind = KINDS[rank]

    def row(c: Column) -> Column:
        value = F.regexp_extract(c["m"], ASSIGN, 1) if kind == "assign" else c["m"]
        return F.struct(c["s"].alias("s"), F.lit(rank).alias("k"), c["e"].alias("e"), F.md5(value).alias("h"))

    return F.transform(_held(text, kind), row)


def text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c["k"]], c["s"].cast("string"), c["e"].cast("string"))), ",")


def _count(rank: int) -> Column:
    return F.size(F.filter("found", lambda c: c["k"] == rank)).cast("long")


def secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base spans, all spans, and how many look live or copied.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example``. A candidate's value (of an assignment:
    what is assigned) is counted by distinct repositories and owners over the whole corpus. Values of fewer than
    ``WIDE_OWNERS`` owners and ``WIDE_REPOSITORIES`` repositories look live, others are examples. The method adds generic spans (20 characters and more with
    upper case, lower case and digits, outside base spans) that look live; base spans always stay.
    Null and empty texts have no spans; a null owner or repository counts as one of its own name; repeated rows come
    back as often as they come in and count once for their owner; an empty table gives no rows.

    Only candidates are shuffled, first folded by value, owner and repository. A value that a third of all texts has is
    one row per owner after the fold, and its join back is split by adaptive execution.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.concat_ws("/", *[F.col(r).cast("string") for r in repository]).alias("repository"), text.alias("text"))
    rows = rows.withColumn("found", F.array_sort(F.concat(*[_described(F.col("text"), k) for k in range(3)])))
    rows = rows.withColumn("more", F.filter(_described(F.col("text"), 3), lambda c: ~F.exists(
        "found", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    held = settle(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "owner", "repository", "found", "more"))
    each = held.filter("size(found) + size(more) > 0").select(
        "_row", "owner", "repository", F.explode(F.concat("found", "more")).alias("c")
    ).select("_row", "owner", "repository", "c", F.col("c.h").alias("h"))
    owned = each.groupBy("h", "owner", "repository").count().groupBy("h", "owner").agg(F.count("*").alias("r")).groupBy("h").agg(
        F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    told = each.select("_row", "c", "h").join(owned, "h").select(
        "_row", F.col("c.s").alias("s"), F.col("c.k").alias("k"), F.col("c.e").alias("e"),
        ((F.col("owners") < WIDE_OWNERS) & (F.col("repositories") < WIDE_REPOSITORIES)).alias("live"))
    per_row = told.groupBy("_row").agg(
        F.sum((F.col("live") & (F.col("k") < 3)).cast("long")).alias("n_live"), F.sum((~F.col("live") & (F.col("k") < 3)).cast("long")).alias("n_example"),
        F.array_sort(F.collect_list(F.when(F.col("live") | (F.col("k") < 3), F.struct("s", "k", "e")))).alias("all"),
    )
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    return held.join(per_row, "_row", "left").select(
        "doc_id", *[_count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(text_of(F.col("found")), 256).alias("base_sha256"),
        text_of(F.coalesce("all", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
    )
