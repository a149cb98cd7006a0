"""Freshness, upserts, scan reuse, work lists and request-log audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import content_hash
from attesta.operators import cache as C
from attesta.operators import traffic as T
from attesta.operators.scoring import criteria_hash
from workload import proxies as P

AS_OF = "2000-01-01 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def _crawl_log(spark, sf_dir):
    return crawl_log(P.table(spark, sf_dir, "orders"))


def crawl_log(orders):
    """Orders as fetches: the address is the customer's, copies of it differ in time and text."""
    return orders.select(
        F.concat(F.lit("https://site"), F.col("o_custkey").cast("string"), F.lit(".example.com/")).alias("url"),
        F.col("o_orderkey").alias("fetch_id"),
        F.when(F.col("o_totalprice") > 20000, F.col("o_orderpriority")).alias("text"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
        F.col("o_orderstatus").alias("state"),
    )


def fresh_pages(spark, sf_dir):
    return C.fresh_pages(_crawl_log(spark, sf_dir), as_of()).select("fetch_id", "url", "text")


def fresh_records(spark, sf_dir):
    stored = _crawl_log(spark, sf_dir).withColumn("ok", F.col("state") == "F")
    return C.fresh_records(stored, as_of()).select("fetch_id", "ok")


def _halves(spark, sf_dir):
    log = _crawl_log(spark, sf_dir).withColumn("fetched_at", F.struct("fetched_at", "fetch_id"))
    stored = log.filter("state <> 'P'").withColumn("content_hash", content_hash(F.col("text")))
    incoming = log.filter("state = 'P'").withColumn("content_hash", content_hash(F.col("text")))
    return stored, incoming


def page_upsert(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    return C.upsert(stored, incoming, ["url"]).select(
        "url", "fetch_id", "text", F.date_format("fetched_at.fetched_at", "yyyy-MM-dd").alias("fetched_on"))


def page_changes(spark, sf_dir):
    stored, incoming = _halves(spark, sf_dir)
    newest = lambda rows: C.upsert(rows, rows.limit(0), ["url"])
    return C.page_changes(newest(stored), newest(incoming))


def _with_fingerprint(spark, rows):
    prints = P.profiles(spark).select("profile_id", criteria_hash(F.col("criteria")).alias("criteria_hash"))
    return rows.join(prints, "profile_id")


def fresh_scan(spark, sf_dir):
    """Every order asks for a scan on its date; finished scans up to 60 days old are reused unless
    they were judged against other criteria (here: an older fingerprint for large orders)."""
    scans = _with_fingerprint(spark, P.scans(spark, sf_dir)).withColumn(
        "criteria_hash", F.when(F.col("outreach_note").isNotNull(), F.lit("older")).otherwise(F.col("criteria_hash")))
    asked = _with_fingerprint(spark, P.scans(spark, sf_dir)).select(
        F.col("scan_id").alias("request_id"), "company_id", "profile_id", "criteria_hash",
        F.col("finished_at").alias("requested_at"))
    return C.fresh_scan(asked, scans).select("request_id", "fresh_scan_id")


def scan_worklist(spark, sf_dir):
    return C.scan_worklist(P.companies(spark, sf_dir), P.profiles(spark), 20).select("profile_id", "company_id")


def criteria_fingerprint(spark, sf_dir):
    """Every customer as a profile: the fingerprint, and whether new labels or weights keep it."""
    relabelled = F.transform("criteria", lambda c: c.withField("label", F.lit("other")))
    reweighted = F.transform("criteria", lambda c: c.withField("weight", c["weight"] + 1))
    own = criteria_hash(F.col("criteria"))
    criterion = lambda key, weight, negative: F.struct(
        key.alias("key"), F.col("c_name").alias("label"), weight.cast("int").alias("weight"), F.col("c_mktsegment").alias("test"),
        F.when(negative, "negative").otherwise(F.lit("positive")).alias("polarity"))
    criteria = F.array(
        criterion(F.lit("k1"), F.col("c_nationkey") % 5 + 1, F.lit(False)),
        criterion(F.concat(F.lit("k"), F.col("c_nationkey").cast("string")), F.lit(2), F.col("c_acctbal") < 0))
    profiles = P.table(spark, sf_dir, "customer").select("c_custkey", criteria.alias("criteria"))
    return profiles.select(
        "c_custkey", own.alias("fingerprint"), (own == criteria_hash(relabelled)).alias("label_free"),
        (own == criteria_hash(reweighted)).alias("weight_free"))


def visits(events):
    """Visits a thousand times denser than logged, so that some come too close."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("host"), F.timestamp_micros(F.floor(micros / 1000).cast("bigint")).alias("ts"),
                         F.col("event_id").alias("id"))


def politeness_audit(spark, sf_dir):
    return T.politeness_audit(visits(P.table(spark, sf_dir, "events"))).select("host", "id", "gap_us")


def responses(events):
    """All events as answers of one archive: a single upstream, the whole log."""
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    return events.select(F.lit("archive").alias("upstream"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("event_id").alias("id"), T.is_failure(status).alias("failed"))


def breaker_windows(spark, sf_dir):
    return T.breaker_windows(responses(P.table(spark, sf_dir, "events")), ["upstream"]).select("id", "failed", "available", "tripped_us")


QUERIES = {
    f.__name__: f
    for f in (fresh_pages, fresh_records, page_upsert, page_changes, fresh_scan, scan_worklist, politeness_audit,
              breaker_windows)
}
QUERIES["criteria_hash"] = criteria_fingerprint

LOG_SQL = """
log AS (
  SELECT 'https://site' || o_custkey || '.example.com/' AS url, o_orderkey AS fetch_id,
         CASE WHEN o_totalprice > 20000 THEN o_orderpriority END AS text, o_orderdate AS fetched_at, o_orderstatus AS state FROM orders)"""
_NEWEST = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1"

ORACLE = {
    "fresh_pages": f"WITH {LOG_SQL} SELECT fetch_id, url, text FROM log WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND coalesce(text, '') <> ''",
    "fresh_records": f"""WITH {LOG_SQL} SELECT fetch_id, state = 'F' AS ok FROM log
      WHERE fetched_at >= TIMESTAMP '{AS_OF}' - CASE WHEN state = 'F' THEN INTERVAL 30 DAY ELSE INTERVAL 1 DAY END""",
    "page_upsert": f"WITH {LOG_SQL} SELECT url, fetch_id, text, strftime(fetched_at, '%Y-%m-%d') AS fetched_on FROM log {_NEWEST}",
    "page_changes": f"""WITH {LOG_SQL}, a AS (SELECT * FROM log WHERE state <> 'P' {_NEWEST}), b AS (SELECT * FROM log WHERE state = 'P' {_NEWEST})
      SELECT url, sha256(a.text) AS old_hash, sha256(b.text) AS new_hash FROM a JOIN b USING (url) WHERE a.text IS DISTINCT FROM b.text""",
    "fresh_scan": f"""WITH {P.SCANS_SQL}
      SELECT r.scan_id AS request_id, max_by(s.scan_id, struct_pack(t := s.finished_at, i := s.scan_id)) AS fresh_scan_id
      FROM scans r LEFT JOIN scans s ON s.status = 'done' AND s.outreach_note IS NULL AND s.company_id = r.company_id AND s.profile_id = r.profile_id
        AND s.finished_at <= r.finished_at AND s.finished_at >= r.finished_at - INTERVAL 60 DAY GROUP BY r.scan_id""",
    "scan_worklist": f"""WITH {P.COMPANIES_SQL}, q AS (
        SELECT id, row_number() OVER (PARTITION BY industry ORDER BY id) AS turn, min(id) OVER (PARTITION BY industry) AS seen FROM companies),
      picked AS (SELECT id FROM q ORDER BY turn, seen LIMIT 20)
      SELECT CAST(p AS BIGINT) AS profile_id, id AS company_id FROM range(1, 6) a(p), picked""",
    "criteria_hash": """
      WITH c AS (SELECT c_custkey, c_mktsegment AS t, c_nationkey % 5 + 1 AS w, c_nationkey AS n, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS p FROM customer)
      SELECT c_custkey, sha256('{"criteria":[{"key":"k1","polarity":"positive","test":"' || t || '","weight":' || w || '},{"key":"k' || n || '","polarity":"' || p
             || '","test":"' || t || '","weight":2}],"v":2}') AS fingerprint, true AS label_free, false AS weight_free FROM c""",
    "politeness_audit": """
      WITH t AS (SELECT user_id AS host, event_id AS id, epoch_us(ts) // 1000 AS us FROM events),
      g AS (SELECT host, id, us - lag(us) OVER (PARTITION BY host ORDER BY us, id) AS gap_us FROM t)
      SELECT * FROM g WHERE gap_us < 1000000""",
    "breaker_windows": """
      WITH t AS (SELECT event_id AS id, event_type = 'error' AS failed, epoch_us(ts) AS us FROM events),
      w AS (SELECT id, failed, max(CASE WHEN failed THEN us END) OVER (ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND 1 PRECEDING) AS tripped_us FROM t)
      SELECT id, failed, tripped_us IS NULL AS available, tripped_us FROM w""",
}
