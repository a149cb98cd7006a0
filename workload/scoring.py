"""Score, latest scan, chips, ranking, badges and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import display
from attesta.operators import latest as L
from attesta.operators import scoring as S
from attesta.operators.scoring import last_result_per_criterion
from attesta.session import new_folder
from attesta.sinks.export import HEADERS, crm_rows, write_crm_csv
from workload import proxies as P


#: The profile that lead lists, rankings and exports below are made for.
RANKED_PROFILE = 3


def summaries(spark: SparkSession, sf_dir: str, profile_id: int | None = None) -> DataFrame:
    """Latest scan per company and profile, or of one profile, scored. Only results of the scans
    picked are looked at."""
    newest = L.latest_scans(P.scans(spark, sf_dir), profile_id)
    own = P.raw_results(spark, sf_dir).join(newest.select("scan_id"), "scan_id", "left_semi")
    results = last_result_per_criterion(own, P.RESULT_ORDER, ("verdict", "source_url", "result_pos"))
    return S.score_scans(newest, P.profiles(spark), results, L.summary_aggregates())


def ranked(spark: SparkSession, sf_dir: str, scanned_only: bool = False) -> DataFrame:
    return L.ranked_leads(P.companies(spark, sf_dir), summaries(spark, sf_dir, RANKED_PROFILE), scanned_only)


def fit_score(spark, sf_dir):
    scans = P.scans(spark, sf_dir).select("scan_id", "company_id", "profile_id")
    scored = S.score_scans(scans, P.profiles(spark), P.results(spark, sf_dir, "verdict"))
    return scored.drop("n_known", "positives")


def fit_score_wide(spark, sf_dir):
    """Every scan against a profile of 21 criteria: red flags at any place count."""
    scans = P.scans(spark, sf_dir).select("scan_id", F.lit(1).cast("bigint").alias("profile_id"))
    scored = S.score_scans(scans, P.wide_profile(spark), P.wide_results(spark, sf_dir))
    return scored.select("scan_id", "earned_weight", "known_weight", "penalty", "score", "coverage")


def score_breakdown(spark, sf_dir):
    return S.score_breakdown(P.scans(spark, sf_dir), P.profiles(spark), P.results(spark, sf_dir, "verdict"))


def latest_scan(spark, sf_dir):
    return L.latest_scans(P.scans(spark, sf_dir)).select(
        "company_id", "scan_id", "profile_id", "status", F.date_format("finished_at", "yyyy-MM-dd").alias("finished_on"),
        "error")


def lead_chips(spark, sf_dir):
    return summaries(spark, sf_dir).select(
        "company_id", "profile_id", "scan_id",
        F.array_join("met_criteria", "; ").alias("met_criteria"),
        F.array_join("red_flags", "; ").alias("red_flags"))


def evidence_urls(spark, sf_dir):
    return (
        summaries(spark, sf_dir).filter(F.size("evidence_urls") > 0)
        .select("scan_id", F.array_join("evidence_urls", " ").alias("urls"),
                F.size("evidence_urls").cast("bigint").alias("n_urls")))


def lead_list(spark, sf_dir):
    leads = L.lead_list(P.companies(spark, sf_dir), summaries(spark, sf_dir, RANKED_PROFILE))
    return leads.orderBy("id").select(
        "id", "domain", "name", F.col("scan.scan_id").alias("scan_id"), F.col("scan.status").alias("status"),
        F.col("scan.score").alias("score"), F.col("scan.coverage").alias("coverage"),
        F.array_join("scan.met_criteria", "; ").alias("met_criteria"))


def lead_ranking(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", "name", "scan_id", "score", "coverage", "rank_value")


def lead_filter(spark, sf_dir):
    leads = ranked(spark, sf_dir)
    return L.filter_leads(leads, search=" MER#00000", scanned_only=True, min_score=40).select(
        "id", "name", "domain", "score")


def lead_badges(spark, sf_dir):
    score, status, coverage = F.col("score"), F.col("status"), F.col("coverage")
    return ranked(spark, sf_dir).select(
        "id", display.score_badge(score, status).alias("badge"), display.score_band(score).alias("band"),
        display.badge_hint(score, status, F.col("no_evidence_reason"), F.col("error")).alias("hint"),
        display.low_evidence(score, status, coverage).alias("low_evidence"))


def verdict_labels(spark, sf_dir):
    """How often each label is shown, over every stored result."""
    criteria = P.profiles(spark).select("profile_id", F.inline("criteria")).select(
        "profile_id", F.col("key").alias("criterion_key"), "polarity")
    shown = (
        P.results(spark, sf_dir, "verdict", "grounding")
        .join(P.scans(spark, sf_dir).select("scan_id", "profile_id"), "scan_id")
        .join(criteria, ["profile_id", "criterion_key"])
    )
    return (
        shown.select(
            "polarity", display.verdict_label(F.col("verdict"), F.col("polarity")).alias("verdict_label"),
            display.grounding_label(F.col("grounding")).alias("grounding_label"))
        .groupBy("polarity", "verdict_label", "grounding_label").agg(F.count("*").alias("n")))


def lead_display(spark, sf_dir):
    as_of = F.to_timestamp(F.lit("2001-08-02 00:00:10"))
    leads = P.companies(spark, sf_dir).join(
        L.latest_scans(P.scans(spark, sf_dir), RANKED_PROFILE).withColumnRenamed("company_id", "id"), "id", "left")
    link = display.href(F.col("domain"))
    return leads.select(
        "id", display.location(F.col("city"), F.col("state")).alias("location"), link.alias("href"),
        display.hostname(link).alias("host"),
        display.relative_time(F.col("finished_at"), as_of).alias("scanned"))


def crm_export(spark, sf_dir):
    return crm_rows(ranked(spark, sf_dir))


def crm_export_scanned(spark, sf_dir):
    """The export of scanned companies only, written as CSV and read back."""
    path = new_folder(spark, "export")
    write_crm_csv(crm_rows(ranked(spark, sf_dir, scanned_only=True)), path)
    return spark.read.csv(path, header=True, escape='"', schema=", ".join(f"`{h}` string" for h in HEADERS)).fillna("")


QUERIES = {
    f.__name__: f
    for f in (
        fit_score, fit_score_wide, score_breakdown, latest_scan, lead_chips, evidence_urls, lead_list, lead_ranking,
        lead_filter, lead_badges, verdict_labels, lead_display, crm_export, crm_export_scanned,
    )
}

_LATEST = """
latest AS (
  SELECT * FROM scans WHERE status IN ('done', 'error')
  QUALIFY row_number() OVER (PARTITION BY company_id, profile_id
    ORDER BY (status = 'done') DESC, finished_at DESC NULLS LAST, scan_id DESC) = 1)"""
_SUMMARY = f"""
chips AS (
  SELECT l.scan_id,
    coalesce((SELECT string_agg(label, '; ' ORDER BY weight DESC, pos) FROM (
       SELECT * FROM grid g WHERE g.scan_id = l.scan_id AND polarity = 'positive' AND verdict = 'met'
       ORDER BY weight DESC, pos LIMIT 3)), '') AS met_criteria,
    coalesce((SELECT string_agg(label, '; ' ORDER BY pos) FROM grid g
       WHERE g.scan_id = l.scan_id AND red_flag), '') AS red_flags
  FROM latest l),
first_urls AS (
  SELECT scan_id, source_url, min(result_pos) AS pos FROM results
  WHERE verdict IN ('met', 'not_met') GROUP BY ALL),
urls AS (
  SELECT scan_id, string_agg(source_url, ' ' ORDER BY pos) AS urls, count(*) AS n_urls
  FROM first_urls JOIN latest USING (scan_id) GROUP BY scan_id),
summary AS (
  SELECT l.*, s.score, s.coverage, c.met_criteria, c.red_flags, u.urls, u.n_urls
  FROM latest l JOIN scored s USING (scan_id) JOIN chips c USING (scan_id) LEFT JOIN urls u USING (scan_id)),
leads AS (
  SELECT c.*, s.scan_id, s.status, s.score, s.coverage, s.met_criteria, s.red_flags, s.urls, s.outreach_note,
         s.no_evidence_reason, s.error, s.finished_at,
         coalesce(s.score * coalesce(s.coverage, 0.0) / 100, -1.0) AS rank_value
  FROM companies c LEFT JOIN summary s ON s.company_id = c.id AND s.profile_id = {RANKED_PROFILE})"""
_WITH = f"WITH {P.SCAN_TABLES_SQL}, {P.COMPANIES_SQL}, {_LATEST}, {_SUMMARY}\n"
_SCANS = f"WITH {P.SCAN_TABLES_SQL}\n"

_EXPORT = _WITH + "SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '') AS \"{h}\"" for c, h in zip(
        ("name", "domain", "city", "state", "industry", "phone", "employee_range", "score", "coverage",
         "met_criteria", "red_flags", "outreach_note", "urls"), HEADERS)) + " FROM leads"

ORACLE = {
    "fit_score": _SCANS + "SELECT * FROM scored",
    "score_breakdown": _SCANS + """
      SELECT scan_id, CAST(pos - 1 AS INTEGER) AS pos, key, label, weight, polarity, verdict,
             CAST(earned AS INTEGER) AS earned, counted, red_flag, penalty,
             CAST(CASE WHEN counted THEN floor(100.0 * earned / weight + 0.5) ELSE 0 END AS INTEGER) AS earned_pct,
             CAST(CASE WHEN red_flag THEN floor(100.0::DOUBLE * weight / total + 0.5) ELSE 0 END AS INTEGER) AS penalty_points
      FROM grid""",
    "latest_scan": f"WITH {P.SCANS_SQL}, {_LATEST} SELECT company_id, scan_id, profile_id, status, "
                   "strftime(finished_at, '%Y-%m-%d') AS finished_on, error FROM latest",
    "lead_chips": _WITH + "SELECT l.company_id, l.profile_id, c.* FROM chips c JOIN latest l USING (scan_id)",
    "evidence_urls": _WITH + "SELECT * FROM urls",
    "lead_list": _WITH + "SELECT id, domain, name, scan_id, status, score, coverage, met_criteria FROM leads ORDER BY id",
    "lead_ranking": _WITH + "SELECT id, name, scan_id, score, coverage, rank_value FROM leads",
    "lead_filter": _WITH + """
      SELECT id, name, domain, score FROM leads
      WHERE (contains(lower(name), 'mer#00000') OR contains(lower(domain), 'mer#00000')) AND scan_id IS NOT NULL
        AND floor(coalesce(score, -1) + 0.5) >= 40""",
    "lead_badges": _WITH + f"""
      SELECT id, CASE WHEN status = 'error' THEN 'Error'
                      WHEN score IS NOT NULL THEN CAST(CAST(floor(score + 0.5) AS BIGINT) AS VARCHAR)
                      WHEN status = 'done' THEN 'No evidence' ELSE 'Not scanned' END AS badge,
             CASE WHEN score IS NULL THEN NULL WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS band,
             CASE WHEN status = 'error' THEN coalesce(error, 'Scan failed')
                  WHEN score IS NOT NULL OR status IS NULL OR status <> 'done' THEN NULL
                  WHEN no_evidence_reason = 'content_too_thin' THEN '{display.THIN_TEXT}'
                  WHEN no_evidence_reason = 'site_unreadable' THEN '{display.BLOCKED_TEXT}'
                  ELSE '{display.UNVERIFIED_TEXT}' END AS hint,
             score IS NOT NULL AND coalesce(status, '') <> 'error' AND coalesce(coverage < 40, false) AS low_evidence
      FROM leads""",
    "verdict_labels": _SCANS + """
      SELECT polarity,
             CASE WHEN polarity = 'negative' THEN
               CASE r.verdict WHEN 'met' THEN 'Red flag' WHEN 'not_met' THEN 'Not present' ELSE 'Unknown' END
             ELSE CASE r.verdict WHEN 'met' THEN 'Met' WHEN 'not_met' THEN 'Not met' ELSE 'Unknown' END END AS verdict_label,
             CASE r.grounding WHEN 'exact' THEN 'Verified · exact match' ELSE 'Unverified' END AS grounding_label,
             count(*) AS n
      FROM results r JOIN scans s USING (scan_id)
      JOIN criteria c ON c.profile_id = s.profile_id AND c.key = r.criterion_key GROUP BY ALL""",
    "lead_display": f"WITH {P.SCANS_SQL}, {P.COMPANIES_SQL}, {_LATEST}" + """
      , t AS (SELECT c.*, l.finished_at,
                epoch(TIMESTAMP '2001-08-02 00:00:10') - epoch(l.finished_at) AS s
              FROM companies c LEFT JOIN latest l ON l.company_id = c.id AND l.profile_id = 3)
      SELECT id, coalesce(state, 'Unknown') AS location, 'https://' || domain AS href, domain AS host,
             CASE WHEN finished_at IS NULL THEN '—' WHEN s < 45 THEN 'just now' WHEN s < 60 THEN '1m ago'
                  WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
                  WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
                  WHEN s < 2592000 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago'
                  WHEN s < 31536000 THEN CAST(floor(s / 2592000) AS BIGINT) || 'mo ago'
                  ELSE CAST(floor(s / 31536000) AS BIGINT) || 'y ago' END AS scanned
      FROM t""",
    "crm_export": _EXPORT,
    "crm_export_scanned": _EXPORT + " WHERE scan_id IS NOT NULL",
    "fit_score_wide": f"""WITH {P.WIDE_SQL}
      SELECT scan_id, CAST(earned AS INTEGER) AS earned_weight, CAST(known AS INTEGER) AS known_weight, {P.round1_sql("penalty")} AS penalty,
             CASE WHEN known > 0 THEN {P.round1_sql("greatest(0.0::DOUBLE, 100.0::DOUBLE * earned / known - penalty)")} END AS score,
             {P.round1_sql("100.0::DOUBLE * n_known / positives")} AS coverage FROM sums""",
}
