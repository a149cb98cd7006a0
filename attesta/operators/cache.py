"""Caches as tables: freshness, upserts, change detection, scan reuse and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.operators.asof import latest_within, micros

PAGE_DAYS = 60
SCAN_DAYS = 60
RECORD_OK_DAYS = 30
RECORD_FAILED_DAYS = 1
DAY_US = 86_400_000_000


def fresh(moment: Column, as_of: Column, days: Column | int) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return moment >= as_of - F.make_dt_interval(days.cast("int"))


def fresh_pages(pages: DataFrame, as_of: Column, days: int = PAGE_DAYS) -> DataFrame:
    """Cached pages that may be reused: recent and with text."""
    return pages.filter(fresh(F.col("fetched_at"), as_of, days) & (F.coalesce("text", F.lit("")) != ""))


def fresh_records(enrichments: DataFrame, as_of: Column) -> DataFrame:
    """Stored record lookups still valid: a success lasts 30 days, a failure one."""
    days = F.when(F.col("ok"), F.lit(RECORD_OK_DAYS)).otherwise(F.lit(RECORD_FAILED_DAYS))
    return enrichments.filter(fresh(F.col("fetched_at"), as_of, days))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str = "fetched_at") -> DataFrame:
    """Both tables with one row per key, the newest; an incoming row wins a tie."""
    rows = stored.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in rows.columns if c not in (*keys, "_incoming")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.struct(order, "_incoming")).alias("row"))
        .select(*keys, "row.*")
    )


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """URLs whose text differs between two crawls."""
    before = old.select("url", F.col("content_hash").alias("old_hash"))
    after = new.select("url", F.col("content_hash").alias("new_hash"))
    return before.join(after, "url").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))


def fresh_scan(requests: DataFrame, scans: DataFrame, days: int = SCAN_DAYS) -> DataFrame:
    """Each request with the newest reusable scan: done, same company, profile and criteria
    fingerprint, finished within ``days`` before the request."""
    keys = ["company_id", "profile_id", "criteria_hash"]
    done = scans.filter(F.col("status") == "done").select(
        *keys, micros(F.col("finished_at")).alias("event_us"), F.col("scan_id").alias("event_id"))
    asked = requests.withColumn("at_us", micros(F.col("requested_at")))
    return (
        latest_within(asked, done, keys, tolerance_us=days * DAY_US, bucket_us=DAY_US)
        .withColumnsRenamed({"event_id": "fresh_scan_id"}).drop("event_us", "at_us")
    )


def new_texts(fetches: DataFrame, days: int = PAGE_DAYS) -> DataFrame:
    """Fetches that brought a text which the same address had at no time in the ``days`` before.

    fetches: url, content_hash, ts, id, …; of fetches at one instant the smallest id counts.
    """
    keys, span = ["url", "content_hash"], days * DAY_US
    timed = fetches.filter(F.col("content_hash").isNotNull()).withColumn("at_us", micros(F.col("ts")))
    payload = [c for c in timed.columns if c not in (*keys, "at_us")]
    # Of a span as long as the look-back only the first fetch can be new, and whether it is the last one of the
    # span before tells: one row per address, text and span is all that is sorted.
    order = F.struct("at_us", F.col("id").isNull(), "id")
    spans = timed.groupBy(*keys, F.floor(F.col("at_us") / F.lit(span)).alias("span")).agg(
        F.min_by(F.struct(*payload), order).alias("row"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))
    before = F.lag("last_us").over(W.partitionBy(*keys).orderBy("span"))
    seen = F.coalesce(F.col("first_us") - F.col("before_us") <= span, F.lit(False))
    return spans.withColumn("before_us", before).filter(~seen).select(*keys, "row.*")


def split_requests(with_fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests answered by a stored scan, and requests that need a new one."""
    hit = F.col("fresh_scan_id").isNotNull()
    return with_fresh.filter(hit), with_fresh.filter(~hit)


def round_robin(companies: DataFrame, per_profile: int) -> DataFrame:
    """``per_profile`` companies, one industry after the other in order of first appearance.

    Each industry can contribute at most that many rows, so Spark trims them before the shuffle.
    """
    industry = F.coalesce(F.nullif("industry", F.lit("")), F.lit("?"))
    rows = companies.withColumn("industry", industry)
    turn = F.row_number().over(W.partitionBy("industry").orderBy("id"))
    queued = rows.withColumn("turn", turn).filter(F.col("turn") <= per_profile)
    first_seen = rows.groupBy("industry").agg(F.min("id").alias("first_seen"))
    return queued.join(first_seen, "industry").orderBy("turn", "first_seen").limit(per_profile)


def scan_worklist(companies: DataFrame, profiles: DataFrame, per_profile: int) -> DataFrame:
    """Picked companies for every profile, in order. Every pick meets every profile by design; the
    picks, as many as asked for, are one value that each profile's row unfolds."""
    picked = round_robin(companies, per_profile).select(F.col("id").alias("company_id"), "turn", "first_seen")
    picks = picked.agg(F.collect_list(F.struct("company_id", "turn", "first_seen"))).scalar()  # per_profile at most
    queued = profiles.select("profile_id", F.inline(picks))
    return queued.orderBy("profile_id", "turn", "first_seen")


def rescan_worklist(latest: DataFrame) -> DataFrame:
    """Every company and profile that already has a finished scan."""
    return latest.select("profile_id", "company_id")
