"""Which pages of a site to read, and whether they hold enough text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.functions.numbers import let
from attesta.session import with_computed
from attesta.sources.crawl import usable

MAX_PAGES = 6
THIN_CONTENT_CHARS = 600

# Page categories in order of preference, and the path parts that tell them.
CATEGORIES = (
    ("about", "about|who-we-are|our-story|history|our-company|company"),
    ("team", "team|staff|our-people|leadership|meet-|owner|founder"),
    ("careers", "career|jobs|employment|join-our|hiring|now-hiring|work-with-us"),
    ("contact", "contact|locations|service-area|areas-we-serve"),
    ("services", "services|what-we-do|financing|reviews|testimonials"),
)
GUESSED_PATHS = ("/about", "/team", "/careers", "/contact")
MAX_PATH = 80


def _is_root(path: Column) -> Column:
    return path.isin("", "/")


def pick_pages(links: Column, have: Column) -> Column:
    """The first link of each category, in category order; a link serves one category."""

    def choose(rows: Column) -> Column:
        def fitting(pattern: str) -> Column:  # a literal, so that it is compiled once
            return F.transform(F.filter(rows, lambda r: r["path"].rlike(pattern)), lambda r: r["url"])

        def step(taken: Column, links_of_category: Column) -> Column:
            found = F.try_element_at(F.filter(links_of_category, lambda u: ~F.array_contains(taken, u)), F.lit(1))
            return F.when(found.isNull(), taken).otherwise(F.array_append(taken, found))

        return F.aggregate(F.array(*[fitting(p) for _, p in CATEGORIES]), F.array().cast("array<string>"), step)

    rows = F.transform(links, lambda u: F.struct(u.alias("url"), F.lower(urls.path_of(u)).alias("path")))
    open_rows = F.filter(
        rows,
        lambda r: ~_is_root(r["path"]) & (F.length(r["path"]) < MAX_PATH) & ~F.array_contains(have, r["url"]),
    )
    return let(open_rows, choose)


def plan_pages(sites: DataFrame) -> DataFrame:
    """Up to six addresses per site, home page first.

    sites: home_url, links (of the home page, in order), sitemap (locations, in order).
    """
    base = F.concat(F.regexp_extract("home_url", "^([^:]+)://", 1), F.lit("://"), urls.authority(F.col("home_url")))
    from_map = pick_pages(F.col("sitemap"), F.concat(F.array("home_url"), F.col("picked")))
    nav = F.filter(
        "content_links", lambda u: ~_is_root(urls.path_of(u)) & (u != F.col("home_url")))
    guessed = F.array(*[F.concat(F.col("base"), F.lit(p)) for p in GUESSED_PATHS])
    # each step is computed once per site; projected, they would be inlined into one another
    rows = sites.withColumn("base", base)
    rows = with_computed(rows, "content_links", F.filter("links", lambda u: ~urls.is_asset(u)))
    rows = with_computed(rows, "picked", pick_pages(F.col("content_links"), F.array("home_url")))
    rows = with_computed(
        rows, "picked", F.when(F.size("picked") < 3, F.array_union("picked", from_map)).otherwise(F.col("picked")))
    rows = with_computed(
        rows, "filled", F.when(F.size("picked") < MAX_PAGES - 1, F.array_union("picked", nav)).otherwise(F.col("picked")))
    chosen = F.when(F.size("filled") == 0, guessed).otherwise(F.col("filled"))
    return rows.withColumn("urls", F.slice(F.concat(F.array("home_url"), chosen), 1, MAX_PAGES)).select(
        *sites.columns, "urls")


def plan_from_cache(fresh_pages: DataFrame) -> DataFrame:
    """Sites whose recent crawl can be reused: a home page and at least one more page are cached.

    Home page first, then as fetched, six rows per site at most. The home page comes from a partial
    aggregate and the others from a ranking that Spark trims to six rows in every task, so a site
    with a large part of all pages is never gathered in one.
    """
    rows = fresh_pages.select("domain", "url", "fetched_at")
    root = _is_root(urls.path_of(F.col("url")))
    home = F.min_by(F.when(root, F.col("url")), F.when(root, F.struct("fetched_at", "url")))
    sites = rows.groupBy("domain").agg(F.count("*").alias("cached"), home.alias("home_url")).filter(
        (F.col("cached") >= 2) & F.col("home_url").isNotNull()).drop("cached")
    fetched = W.partitionBy("domain").orderBy("fetched_at", "url")
    first = rows.withColumn("n", F.row_number().over(fetched)).filter(F.col("n") <= MAX_PAGES)
    others = sites.join(first, "domain").filter(F.col("url") != F.col("home_url"))
    placed = others.withColumn("plan_pos", F.row_number().over(fetched) + 1).filter(F.col("plan_pos") <= MAX_PAGES)
    return sites.select("domain", F.lit(1).alias("plan_pos"), F.col("home_url").alias("url")).unionByName(
        placed.select("domain", "plan_pos", "url"))


def site_content(fetched: DataFrame, *keys: str) -> DataFrame:
    """Per site: characters and pages of usable, different text, and why there is no evidence.

    fetched: keys, plan_pos, text, content_hash, via, outcome. Copies of a text count once, as
    the first page in plan order.
    """
    good = usable(F.col("outcome"), F.col("text"))
    first = F.struct("plan_pos", F.length("text").alias("chars"), (F.col("via") == "wayback").alias("archived"))
    per_text = (
        fetched.withColumn("hash", F.when(good, F.col("content_hash")))
        .groupBy(*keys, "hash").agg(F.min(first).alias("page"))
    )
    has_text = F.col("hash").isNotNull()
    chars = F.coalesce(F.sum(F.when(has_text, F.col("page.chars"))), F.lit(0))
    return per_text.groupBy(*keys).agg(
        F.count("hash").alias("pages_fetched"),
        chars.alias("content_chars"),
        F.coalesce(F.bool_or(F.when(has_text, F.col("page.archived"))), F.lit(False)).alias("fallback_used"),
    ).withColumn(
        "no_evidence_reason",
        F.when(F.col("pages_fetched") == 0, "site_unreadable").when(
            F.col("content_chars") < THIN_CONTENT_CHARS, "content_too_thin"),
    )


def scan_pages(fetched: DataFrame, *keys: str) -> DataFrame:
    """The usable pages of each site, copies of a text once, as the first in plan order."""
    payload = [c for c in fetched.columns if c not in (*keys, "content_hash")]
    return (
        fetched.filter(usable(F.col("outcome"), F.col("text")))
        .groupBy(*keys, "content_hash")
        .agg(F.min_by(F.struct(*payload), "plan_pos").alias("page"))
        .select(*keys, "content_hash", "page.*")
    )
