"""Landed crawl data: raw pages, fetch logs and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import html as H
from attesta.functions import urls
from attesta.functions.text import content_hash

MIN_TEXT_CHARS = 80
MAX_SITEMAP_LINKS = 300

# Fetch failures that still allow the archived copy to be tried.
TRANSPORT_FAILURES = ("TimeoutException", "ConnectError", "ReadError", "RemoteProtocolError")


def page_texts(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Raw pages (…, url, html) to text, domain and content hash; the markup is dropped."""
    kept = [c for c in pages.columns if c not in ("html",)]
    return (
        pages.withColumn("text", H.page_text(F.col("html"), cap))
        .select(
            *kept, urls.normalize_domain(F.col("url")).alias("domain"), "text",
            F.when(F.col("text") != "", content_hash(F.col("text"))).alias("content_hash"),
        )
    )


def readable(content_type: Column) -> Column:
    """Only markup and text bodies are read; anything else counts as empty."""
    return F.coalesce(content_type, F.lit("")).rlike("html|xml|text")


def classify_fetches(log: DataFrame) -> DataFrame:
    """Fetch log with its outcome, the way the page was obtained and the text to keep.

    log: url, allowed (robots and deny list), cached, status, error, content_type, text, and
    archived_text (text of the archived copy, null when there is none).
    """
    status, error = F.col("status"), F.col("error")
    live = F.when((status == 200) & ~readable(F.col("content_type")), F.lit("")).otherwise(
        F.coalesce("text", F.lit("")))
    timeout = F.coalesce(error.rlike("Timeout"), F.lit(False))
    failed = error.isNotNull()
    transport = failed & (error.isin(*TRANSPORT_FAILURES) | timeout)
    fallback = transport | (~failed & ((status >= 500) | ((status == 200) & (F.length(live) < MIN_TEXT_CHARS))))
    archived = F.coalesce(F.length("archived_text") >= MIN_TEXT_CHARS, F.lit(False))
    usable = log.withColumns({"live_text": live, "use_archive": fallback})
    outcome = (
        F.when(F.col("cached"), "cached")
        .when(~F.col("allowed"), "robots")
        .when(failed & ~transport, "error")
        .when(~failed & status.isin(401, 403, 429), "blocked")
        .when(~failed & status.isin(404, 410), "not_found")
        .when(F.col("use_archive") & F.col("archived_text").isNotNull(), F.when(archived, "ok").otherwise("empty"))
        .when(transport, F.when(timeout, "timeout").otherwise("error"))
        .when(F.col("use_archive"), "error")
        .when(status == 200, "ok")
        .otherwise("error")
    )
    from_archive = ~F.col("cached") & F.col("allowed") & F.col("use_archive") & F.col("archived_text").isNotNull()
    via = F.when(from_archive, "wayback").otherwise("live")
    classified = usable.withColumns({"outcome": outcome, "via": via})
    text = (
        F.when(F.col("outcome") == "cached", F.col("text"))
        .when(F.col("via") == "wayback", F.when(F.col("outcome") == "ok", F.col("archived_text")).otherwise(F.lit("")))
        .when(F.col("allowed") & ~failed & (status == 200), F.col("live_text"))
        .otherwise(F.lit(""))
    )
    return classified.withColumn("kept_text", text).drop("live_text", "use_archive")


def usable(outcome: Column, text: Column) -> Column:
    return outcome.isin("ok", "cached") & (F.coalesce(text, F.lit("")) != "")


def reachable(outcome: Column, cached: Column, status: Column) -> Column:
    """The site answered at all; unknown when robots kept us out."""
    return F.when(outcome == "robots", F.lit(None).cast("boolean")).otherwise(cached | status.isNotNull())


def update_reachability(companies: DataFrame, home_fetches: DataFrame) -> DataFrame:
    """Companies with their reachability replaced where the last home fetch tells it.

    home_fetches: domain, fetched_at, reachable.
    """
    newest = home_fetches.filter(F.col("reachable").isNotNull()).groupBy("domain").agg(
        F.max_by("reachable", "fetched_at").alias("now"))
    return companies.join(newest, "domain", "left").select(
        *[F.coalesce("now", "reachable").alias("reachable") if c == "reachable" else F.col(c)
          for c in companies.columns]
    )


def sitemap_links(body: Column, site: Column, limit: int = MAX_SITEMAP_LINKS) -> Column:
    """Locations on the site's own host, in document order, at most ``limit``."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    host = urls.strip_www(urls.authority(site))
    own = F.filter(found, lambda u: urls.strip_www(urls.authority(u)) == host)
    return F.slice(own, 1, limit)


def is_sitemap(status: Column, content_type: Column, body: Column) -> Column:
    return (status == 200) & (F.contains(content_type, F.lit("xml")) | F.substring(body, 1, 500).contains("<urlset"))
