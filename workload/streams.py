"""Streaming jobs run to the end over the driver's tables; each equals a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import content_hash
from attesta.operators.cache import DAY_US, fresh_records
from attesta.operators.cache import new_texts as find_new_texts
from attesta.session import new_folder
from attesta.streaming import runs as S
from workload import caches, leads, scoring
from workload import proxies as P


BATCHES = 4


def _arrive(rows, part, run):
    """``rows`` reach a stream in four batches, by their ``part`` from 0 to 3; ``run`` starts the
    stream on the folder they land in."""
    spark = rows.sparkSession
    landing = new_folder(spark, "landing")
    for k in range(BATCHES):
        rows.filter(part == k).write.mode("append").parquet(landing)
        run(spark.readStream.schema(rows.schema).parquet(landing)).awaitTermination()


def _any_order(key):
    return F.pmod(F.xxhash64(key), F.lit(BATCHES))


def _out_of_order(rows, moment, key, delay_us):
    """Four equal spans of the time of arrival, which is up to ``delay_us`` after a row's moment, so that
    rows of one span come in any order and many come after later ones."""
    us = F.unix_micros(moment.cast("timestamp")) + F.pmod(F.xxhash64(key), F.lit(delay_us))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    return F.floor((us - low) * BATCHES / (high - low + 1))


def _orders(spark, sf_dir):
    return P.table(spark, sf_dir, "orders")


def stream_latest(spark, sf_dir):
    """Scans arrive in any order."""
    folder = new_folder(spark, "latest")
    _arrive(_orders(spark, sf_dir), _any_order("o_orderkey"),
            lambda s: S.latest_scans(P.scan_columns(s), f"{folder}/rows", f"{folder}/state"))
    return S.current(spark, f"{folder}/rows", ["company_id", "profile_id"]).select(
        "company_id", "scan_id", "profile_id", "status", F.date_format("finished_at", "yyyy-MM-dd").alias("finished_on"), "error")


def stream_pages(spark, sf_dir):
    """Fetches arrive in any order."""
    folder = new_folder(spark, "pages")
    _arrive(_orders(spark, sf_dir), _any_order("o_orderkey"),
            lambda s: S.keep_newest(caches.crawl_log(s), ["url"], ["fetched_at", "fetch_id"], f"{folder}/rows", f"{folder}/state"))
    return S.current(spark, f"{folder}/rows", ["url"], ["fetched_at", "fetch_id"]).select(
        "url", "fetch_id", "text", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"))


def stream_records(spark, sf_dir):
    """Record lookups kept by (domain, kind) for their life of 30 days; freshness is judged when the
    table is read."""
    folder = new_folder(spark, "records")
    kind = F.when(F.col("state") == "P", "rdap").otherwise("wayback")
    log = lambda s: caches.crawl_log(s).withColumns({"ok": F.col("state") == "F", "kind": kind})
    rows = _orders(spark, sf_dir)
    _arrive(rows, _out_of_order(rows, F.col("o_orderdate"), "o_orderkey", 30 * DAY_US),
            lambda s: S.keep_newest(log(s), ["url", "kind"], ["fetched_at", "fetch_id"], f"{folder}/rows", f"{folder}/state", life_days=30))
    kept = S.current(spark, f"{folder}/rows", ["url", "kind"], ["fetched_at", "fetch_id"])
    return fresh_records(kept, caches.as_of()).select("url", "kind", "fetch_id", "ok")


def _fetches(orders):
    return caches.crawl_log(orders).select(
        "url", content_hash(F.col("text")).alias("content_hash"), F.col("fetched_at").alias("ts"), F.col("fetch_id").alias("id"))


def new_texts(spark, sf_dir):
    """Fetches that brought a text the address had not had in the sixty days before."""
    return find_new_texts(_fetches(_orders(spark, sf_dir))).select("url", "content_hash", "id")


def stream_new_texts(spark, sf_dir):
    folder = new_folder(spark, "texts")
    rows = _orders(spark, sf_dir)
    part = _out_of_order(rows, F.col("o_orderdate"), "o_orderkey", 30 * DAY_US)
    _arrive(rows, part, lambda s: S.new_page_texts(_fetches(s), folder, f"{folder}/state", delay_us=30 * DAY_US))
    return S.found(spark, folder).select("url", "content_hash", "id")


def stream_import(spark, sf_dir):
    """Leads arrive in file order."""
    folder = new_folder(spark, "import")
    pages = P.table(spark, sf_dir, "pages").select("page_id", "url")
    most = pages.agg(F.max("page_id")).first()[0] or 0
    _arrive(pages, F.floor(F.col("page_id") * BATCHES / (most + 1)),
            lambda s: S.import_leads(leads.raw_leads(s), leads.existing(spark, sf_dir), f"{folder}/rows", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def stream_politeness(spark, sf_dir):
    folder = new_folder(spark, "politeness")
    rows = P.table(spark, sf_dir, "events")
    part = _out_of_order(rows, F.col("ts"), "event_id", DAY_US)
    _arrive(rows, part, lambda s: S.politeness(caches.visits(s), folder, f"{folder}/state", delay_us=DAY_US))
    return S.found(spark, folder).select("host", "id", "gap_us")


def stream_breaker(spark, sf_dir):
    folder = new_folder(spark, "breaker")
    rows = P.table(spark, sf_dir, "events")
    part = _out_of_order(rows, F.col("ts"), "event_id", DAY_US)
    _arrive(rows, part, lambda s: S.breaker(caches.responses(s), ["upstream"], folder, f"{folder}/state", delay_us=DAY_US))
    return S.found(spark, folder).select("id", "failed", "available", "tripped_us")


QUERIES = {
    f.__name__: f
    for f in (stream_latest, stream_pages, stream_records, new_texts, stream_new_texts, stream_import, stream_politeness, stream_breaker)
}
_NEW_TEXTS_SQL = f"""WITH {caches.LOG_SQL},
  t AS (SELECT *, lag(fetched_at) OVER (PARTITION BY url, text ORDER BY fetched_at, fetch_id) AS before FROM log WHERE text IS NOT NULL)
  SELECT url, sha256(text) AS content_hash, fetch_id AS id FROM t WHERE before IS NULL OR fetched_at - before > INTERVAL 60 DAY"""
ORACLE = {
    "stream_latest": scoring.ORACLE["latest_scan"],
    "stream_pages": caches.ORACLE["page_upsert"],
    "stream_import": leads.ORACLE["lead_import"],
    "stream_politeness": caches.ORACLE["politeness_audit"],
    "stream_breaker": caches.ORACLE["breaker_windows"],
    "stream_records": f"""WITH {caches.LOG_SQL}, k AS (SELECT *, CASE WHEN state = 'P' THEN 'rdap' ELSE 'wayback' END AS kind FROM log),
      n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY url, kind ORDER BY fetched_at DESC, fetch_id DESC) = 1)
      SELECT url, kind, fetch_id, state = 'F' AS ok FROM n
      WHERE fetched_at >= TIMESTAMP '{caches.AS_OF}' - CASE WHEN state = 'F' THEN INTERVAL 30 DAY ELSE INTERVAL 1 DAY END""",
    "new_texts": _NEW_TEXTS_SQL,
    "stream_new_texts": _NEW_TEXTS_SQL,
}
