"""Links of stored HTML pages: absolute addresses, archives, and the pages reachable from a start."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.functions.arrays import let
from tonewheel.functions.tables import ARCHIVE_SUFFIXES
from tonewheel.session import settle, shared_folder

#: Addresses that are broadcast to the pages at most.
LISTED = 200_000
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.array_append(kept, part))
        )

    closing = F.when(F.rlike(path, F.lit(r"/\.\.?$")), "/").otherwise("")
    return F.concat(F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"), closing)


def page_facts(base: Column) -> Column:
    """What resolving needs to know of a page, worked out once per page."""
    page = F.regexp_replace(base, r"#.*$", "")
    plain = F.regexp_replace(page, r"\?.*$", "")
    return F.struct(
        F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*://[^/?#]*)", 1).alias("site"),
        F.regexp_extract(base, r"^([a-zA-Z][\w+.\-]*):", 1).alias("scheme"),
        page.alias("page"),
        plain.alias("plain"),
        F.regexp_extract(plain, r"^[a-zA-Z][\w+.\-]*://[^/]*(/(?:.*/)?)", 1).alias("folder"),
    )


def absolute(facts: Column, href: Column) -> Column:
    """``href`` as seen from the page with these facts."""
    cut = F.rlike(href, F.lit("[?#]"))
    target = F.when(cut, F.regexp_extract(href, r"^([^?#]*)", 1)).otherwise(href)
    rest = F.when(cut, F.regexp_extract(href, r"^[^?#]*(.*)$", 1)).otherwise("")
    folder = F.when(facts["folder"] == "", "/").otherwise(facts["folder"])
    path = F.when(F.startswith(href, F.lit("/")), target).otherwise(F.concat(folder, target))
    clean = let(path, lambda p: F.when(F.contains(p, F.lit("/.")), _without_dots(p)).otherwise(p))
    return (
        F.when(F.rlike(href, F.lit(r"^[a-zA-Z][\w+.\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(facts["scheme"], F.lit(":"), href))
        .when(href == "", facts["page"])
        .when(F.startswith(href, F.lit("#")), F.concat(facts["page"], href))
        .when(F.startswith(href, F.lit("?")), F.concat(facts["plain"], href))
        .otherwise(F.concat(facts["site"], clean, rest))
    )


def is_archive(url: Column) -> Column:
    suffixes = "|".join(s.replace(".", r"\.") for s in ARCHIVE_SUFFIXES)
    return F.rlike(url, F.lit(f"(?i)({suffixes})$"))


def is_below(url: Column, base: str | Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.startswith(url, base) & ~is_archive(url)


def _links_of(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``(page, link)`` for every anchor, absolute, as often as it is there."""
    found = pages.select(
        F.col(url).alias("page"),
        page_facts(F.col(url)).alias("_p"),
        F.explode(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))).alias("href"),
    )
    link = let(F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))), lambda h: absolute(F.col("_p"), h))
    return found.select("page", link.alias("link"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(page, link)`` for every anchor, absolute, one row per distinct pair."""
    return _links_of(pages, url, html).distinct()


def kept_links(links: DataFrame, base: str | None = None) -> DataFrame:
    """Archives, and pages below ``base``."""
    marked = links.withColumn("archive", is_archive(F.col("link")))
    return marked.where("archive" if base is None else F.col("archive") | F.startswith("link", F.lit(base)))


def discover(pages: DataFrame, starts: DataFrame, base: str, url: str = "url", html: str = "html") -> DataFrame:
    """Archives reachable from ``starts`` over stored pages below ``base``: ``(link)``.

    One join per link distance; each round follows only pages not seen before and writes only those, as one more
    partition of the table of pages seen, so what is written grows with the pages and not with the rounds. Links are
    resolved when their page is reached, so once for each page and never for pages out of reach. Pages count
    as the same with and without a closing slash.
    """
    def bare(c: str) -> Column:
        return F.regexp_replace(c, "/+$", "")

    # written once: pages made by expressions would be made again in each round
    at = settle(pages.select(bare(url).alias("at"), F.col(url).alias("_url"), F.col(html).alias("_html")))
    spark, seen = pages.sparkSession, f"{shared_folder(pages.sparkSession)}/{uuid.uuid4().hex}"

    def written(rows: DataFrame, number: int) -> DataFrame:
        rows.write.parquet(f"{seen}/round={number}")
        return spark.read.schema("at string").parquet(f"{seen}/round={number}")

    frontier, files, number = written(starts.select(bare(url).alias("at")).distinct(), 0), None, 0
    while count := frontier.limit(LISTED + 1).count():
        # the frontier holds an address once; the pages are not shuffled while it is short
        reached = at.join(F.broadcast(frontier) if count <= LISTED else frontier, "at", "left_semi")
        # written first: the filter that comes with explode would be pushed below the join and read links of all pages
        reached = settle(reached.select("_url", "_html"))
        # written before filtering: a filter pushed below would resolve every link again for each test
        step = kept_links(settle(_links_of(reached, "_url", "_html").select("link")), base)
        found = step.where("archive").select("link")
        files = found if files is None else files.unionByName(found)
        onward = step.where(~F.col("archive")).select(bare("link").alias("at")).distinct()
        visited, number = spark.read.schema("at string, round int").parquet(seen), number + 1
        frontier = written(onward.join(visited, "at", "left_anti"), number)
    return files.distinct() if files is not None else spark.createDataFrame([], "link string")
