"""Evaluation, stored outputs and the whole batch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.urls import normalize_domain
from attesta.operators import evaluation as E
from attesta.operators import models as M
from attesta.operators.scoring import criteria_hash
from attesta.plans.scan_batch import run_scans
from attesta.schemas import CRITERIA
from attesta.session import literal_relation, new_folder, stage
from attesta.sinks import tables as K
from workload import proxies as P
from workload.verdicts import LINES_SQL, stored_facts


def _cases(spark, sf_dir):
    """Every order as a golden case, written as the JSON of a case file and read back."""
    o = P.table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit('{"domain": "'), F.col("o_orderpriority"), F.lit('", "icp": "sales", "expected_facts": ["COSTS 1", "qty '),
        F.substring("o_orderpriority", 1, 1), F.lit('"], "expected_verdicts": {"c1": "met", "c2": ["not_met", "unknown"], "c9": "met"}}'))
    read = o.select("o_orderkey", "o_totalprice", F.from_json(text, E.CASE).alias("c")).select("o_orderkey", "o_totalprice", "c.*")
    keyed = E.golden_cases(read.withColumn("icp", F.concat_ws("/", "o_orderkey", F.floor(F.col("o_totalprice") / 20000).cast("string"))))
    key = F.split("icp", "/")
    return keyed.select(
        key[0].cast("bigint").alias("scan_id"), "domain", key[1].cast("double").alias("latency"), "expected_facts", "accepted")


def _verdicts(spark, sf_dir):
    return P.results(spark, sf_dir, "verdict", "grounding", "source_url").withColumnRenamed("source_url", "evidence_quote")


def golden_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("scan_id", "domain", F.array_join("expected_facts", "|").alias("facts"), F.explode("accepted").alias("key", "v")).select(
        "scan_id", "domain", "facts", "key", F.array_join("v", "|").alias("accepted"))


def eval_agreement(spark, sf_dir):
    return E.agreement(_cases(spark, sf_dir), _verdicts(spark, sf_dir))


def eval_cases(spark, sf_dir):
    return E.evaluate(_cases(spark, sf_dir), stored_facts(spark, sf_dir), _verdicts(spark, sf_dir))


def eval_report(spark, sf_dir):
    return E.report(eval_cases(spark, sf_dir))


def scan_outputs(spark, sf_dir):
    """Scans, facts and results stored as two batches, the second written twice, and read back.

    Lines go to their scan once, where they are reduced and meet it; the tables are worked out once for all batches.
    """
    folder = new_folder(spark, "outputs")
    own = P.scans(spark, sf_dir).select("scan_id", "profile_id")
    facts = stored_facts(spark, sf_dir, by_scan=True).withColumn("evidence_quote", F.concat("evidence_quote", F.lit("\x00"))).join(own, "scan_id")
    results = P.results(spark, sf_dir, "verdict", "source_url", by_scan=True).join(own, "scan_id")
    made = new_folder(spark, "outputs-made")
    tables = {"scans": P.scans(spark, sf_dir), "facts": stage(facts, f"{made}/facts"), "results": stage(results, f"{made}/results")}
    for batch, part in (("0", "scan_id % 2 = 0"), ("1", "scan_id % 2 = 1"), ("1", "scan_id % 2 = 1")):
        K.write_scan_outputs(folder, batch, {name: rows.filter(part) for name, rows in tables.items()})
    row = lambda name, *said: K.read_table(spark, folder, name).select(
        F.lit(name).alias("name"), F.col("profile_id").cast("int").alias("profile_id"), "scan_id", F.concat_ws("|", *said).alias("said"))
    return row("scans", "status", "outreach_note").unionByName(row("facts", "id", "evidence_quote", "grounding")).unionByName(
        row("results", "criterion_key", "verdict", "source_url"))


def profile_compile(spark, sf_dir):
    """Customers as profiles whose description follows from their columns, compiled by rule."""
    c = P.table(spark, sf_dir, "customer")
    text = F.concat(
        F.lit("Shops for "), F.lower("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.lit(", family-run, 20+ Years old")).otherwise(F.lit("")),
        F.when(F.col("c_nationkey") < 10, F.lit(", hiring now")).otherwise(F.lit("")), F.lit(". Avoid FRANCHISES."))
    profiles = c.select(F.col("c_custkey").alias("profile_id"), text.alias("description_text"))
    return M.compile_criteria(profiles).select("profile_id", F.posexplode("criteria").alias("pos", "c")).select(
        "profile_id", "pos", "c.key", "c.weight", "c.polarity")


def _batch_profiles(spark):
    schema = T.StructType([T.StructField("profile_id", T.LongType()), T.StructField("profile_name", T.StringType()), T.StructField("criteria", CRITERIA)])
    owner = ("owner_operated", "Owner operated", 5, "Is the owner or family involved?", "positive")
    years = ("in_business_20_years", "20+ years", 4, "Founded over 20 years ago?", "positive")
    hiring = ("active_hiring", "Hiring", 3, "Are there open jobs?", "positive")
    group = ("franchise_or_group", "Franchise", 4, "Is it a franchise?", "negative")
    return literal_relation(spark, [(1, "Buyers", [owner, years, group]), (2, "Sellers", [hiring, years])], schema)


AS_OF = "2026-01-01"
FILLER = "We repair roofs, gutters and walls in the whole county and are happy to help you with any question. " * 7


def batch_inputs(spark, sf_dir):
    """Every host as a company and its pages as landed, with statements that follow from page_id.

    Some pages are home pages, some are stale, some landed twice, some hold nothing to read.
    """
    n, url = F.col("page_id"), F.col("url")
    address = F.when(n % 10 == 1, F.regexp_replace(url, "^[a-z]+://([^/]*)/.*$", "https://$1/")).otherwise(url)
    said = lambda shift, flag: F.when(n % 11 == 2, "<html><body><p>tiny</p></body></html>").otherwise(F.concat(
        F.lit("<html><title>Shop</title><body><p>Family owned and operated since "), (1950 + (n + shift) % 70).cast("string"), F.lit(", serving all. Over "),
        (10 + (n + shift) % 80).cast("string"), F.lit(" years of experience.</p>"),
        F.when(flag, F.lit("<p>We are a franchisee in the region.</p>")).otherwise(F.lit("")), F.lit(f"<p>{FILLER}</p></body></html>")))
    at = lambda day: F.to_timestamp(F.lit(day)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)
    table = P.table(spark, sf_dir, "pages").select("page_id", "url")
    first = table.select(
        address.alias("url"), said(0, url.contains("utm")).alias("html"),
        F.when(n % 7 == 3, at("2025-09-01")).otherwise(at("2025-12-01")).alias("fetched_at"))
    again = table.filter(n % 5 == 0).select(address.alias("url"), said(1, n % 3 == 0).alias("html"), at("2025-12-20").alias("fetched_at"))
    pages = first.unionByName(again).withColumn("via", F.lit("live"))
    companies = first.select(normalize_domain(F.col("url")).alias("domain")).distinct().withColumn("company_id", F.col("domain"))
    profiles = _batch_profiles(spark)
    worklist = companies.withColumn("profile_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).select(
        F.xxhash64("domain", "profile_id").alias("scan_id"), "company_id", F.col("domain").alias("name"), "domain", "profile_id")
    enrichments = companies.select(
        "domain", F.lit("wayback").alias("kind"), F.lit('[["timestamp"],["19990203040506"]]').alias("payload"), F.lit(None).cast("string").alias("fallback"),
        F.to_timestamp(F.lit("2025-12-25")).alias("fetched_at"))
    # one company in four has a finished scan of ten days ago, another one of seventy
    age = F.length("domain") % 4
    stored = worklist.filter(age < 2).join(profiles.select("profile_id", criteria_hash(F.col("criteria")).alias("criteria_hash")), "profile_id").select(
        F.lit(7).cast("bigint").alias("scan_id"), "company_id", "profile_id", "criteria_hash", F.lit("done").alias("status"),
        F.when(age == 0, F.to_timestamp(F.lit("2025-12-22"))).otherwise(F.to_timestamp(F.lit("2025-10-20"))).alias("finished_at"))
    return worklist, profiles, pages, enrichments, stored


def scan_batch(spark, sf_dir):
    """Pages to facts, verdicts, scores and notes, for every host and two profiles; requests that a
    stored scan answers are listed as reused."""
    worklist, profiles, pages, enrichments, stored = batch_inputs(spark, sf_dir)
    as_of = F.to_timestamp(F.lit(AS_OF))
    out = run_scans(worklist, profiles, pages, enrichments, as_of, new_folder(spark, "batch"), stored_scans=stored)
    records = out.facts.groupBy("scan_id").agg(F.count_if(F.col("grounding") == "record").alias("n_records"))
    columns = ["domain", "profile_id", "status", "score", "coverage", "penalty", "pages_fetched", "no_evidence_reason", "note_status", "n_records"]
    ran = out.scans.join(records, "scan_id", "left").select(*columns)
    reused = worklist.join(out.reused, "scan_id").select("domain", "profile_id", F.lit("reused").alias("status"))
    return ran.unionByName(reused, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (golden_cases, eval_agreement, eval_cases, eval_report, scan_outputs, profile_compile, scan_batch)}

_CASES = """
cases AS (SELECT o_orderkey AS scan_id, o_orderpriority AS domain, floor(o_totalprice / 20000) AS latency FROM orders),
want AS (SELECT scan_id, unnest(['c1', 'c2', 'c9']) AS criterion_key, unnest(['met', 'not_met|unknown', 'met']) AS expected FROM cases),
agree AS (
  SELECT scan_id, criterion_key, expected, coalesce(verdict, 'missing') AS got, CASE WHEN verdict IS NOT NULL THEN list_contains(string_split(expected, '|'), verdict) END AS agrees
  FROM want LEFT JOIN results USING (scan_id, criterion_key))"""
_EVAL = f"""
hay AS (SELECT scan_id, lower(string_agg(fact || ' ' || evidence_quote, ' ' ORDER BY id) FILTER (grounding <> 'none')) AS h, count(*) AS facts,
          count(*) FILTER (grounding = 'exact') AS exact, count(*) FILTER (grounding = 'record') AS record, count(*) FILTER (grounding = 'none') AS no_g FROM facts GROUP BY 1),
ok AS (SELECT scan_id, bool_and(verdict = 'unknown' OR grounding <> 'none') AS all_grounded FROM results GROUP BY 1),
ag AS (SELECT scan_id, count(agrees) AS judged, count(*) FILTER (agrees) AS agreed FROM agree GROUP BY 1),
per_case AS (
  SELECT scan_id, domain, coalesce(facts, 0) AS facts, coalesce(exact, 0) AS exact, CAST(0 AS BIGINT) AS fuzzy, coalesce(record, 0) AS record, coalesce(no_g, 0) AS "none",
         CAST(coalesce(contains(h, 'costs 1'), false) AS BIGINT) + CAST(coalesce(contains(h, 'qty ' || domain[1]), false) AS BIGINT) AS fact_hits, CAST(2 AS BIGINT) AS fact_expected,
         coalesce(judged, 0) AS judged, coalesce(agreed, 0) AS agreed, coalesce(all_grounded, true) AS all_grounded, latency, latency < 5 AS cached
  FROM cases LEFT JOIN hay USING (scan_id) LEFT JOIN ok USING (scan_id) LEFT JOIN ag USING (scan_id))"""
_BASE = f"WITH {P.RESULTS_SQL}, {LINES_SQL}, {_CASES}"

ORACLE = {
    "profile_compile": """
      WITH k AS (SELECT c_custkey AS profile_id, list_concat(CASE WHEN c_acctbal > 0 THEN [('owner_operated', 5, 'positive'), ('in_business_20_years', 4, 'positive')] ELSE [] END,
                   CASE WHEN c_nationkey < 10 THEN [('active_hiring', 4, 'positive')] ELSE [] END, [('franchise_or_group', 4, 'negative')]) AS l FROM customer)
      SELECT profile_id, CAST(i - 1 AS INTEGER) AS pos, l[i][1] AS key, CAST(l[i][2] AS INTEGER) AS weight, l[i][3] AS polarity FROM k, range(1, 6) r(i) WHERE i <= len(l)""",
    "golden_cases": f"""WITH {P.RESULTS_SQL}, {_CASES}
      SELECT scan_id, domain, 'COSTS 1|qty ' || domain[1] AS facts, criterion_key AS key, expected AS accepted FROM want JOIN cases USING (scan_id)""",
    "eval_agreement": _BASE + " SELECT * FROM agree",
    "eval_cases": f"{_BASE}, {_EVAL} SELECT * FROM per_case",
    "eval_report": f"""{_BASE}, {_EVAL}
      SELECT domain, count(*) AS cases, CAST(sum(facts) AS BIGINT) AS facts, CAST(sum(exact + fuzzy + record) AS BIGINT) AS grounded,
             CAST(floor(100.0 * sum(exact + fuzzy + record) / greatest(sum(facts), 1) + 0.5) AS BIGINT) AS grounded_pct, CAST(sum(exact) AS BIGINT) AS exact,
             CAST(sum(fuzzy) AS BIGINT) AS fuzzy, CAST(sum(record) AS BIGINT) AS record, CAST(sum("none") AS BIGINT) AS "none", CAST(sum(fact_hits) AS BIGINT) AS fact_hits,
             CAST(sum(fact_expected) AS BIGINT) AS fact_expected, CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(agreed) AS BIGINT) AS agreed, bool_and(all_grounded) AS all_grounded,
             count(*) FILTER (NOT cached) AS fresh_scans, avg(latency) FILTER (NOT cached) AS mean_latency
      FROM per_case GROUP BY ROLLUP (domain)""",
    "scan_outputs": f"""WITH {P.SCANS_SQL}, {P.RESULTS_SQL}, {LINES_SQL}
      SELECT 'scans' AS name, CAST(profile_id AS INTEGER) AS profile_id, scan_id, concat_ws('|', status, outreach_note) AS said FROM scans
      UNION ALL SELECT 'facts', CAST(profile_id AS INTEGER), scan_id, concat_ws('|', id, evidence_quote, grounding) FROM facts JOIN scans USING (scan_id)
      UNION ALL SELECT 'results', CAST(profile_id AS INTEGER), scan_id, concat_ws('|', criterion_key, verdict, source_url) FROM results JOIN scans USING (scan_id)""",
    "scan_batch": f"""
      WITH first AS (
        SELECT page_id, CASE WHEN page_id % 10 = 1 THEN regexp_replace(url, '^[a-z]+://([^/]*)/.*$', 'https://\\1/') ELSE url END AS url,
               contains(url, 'utm') AS flag, 0 AS shift, CASE WHEN page_id % 7 = 3 THEN DATE '2025-09-01' ELSE DATE '2025-12-01' END AS day FROM pages),
      landed AS (SELECT * FROM first UNION ALL SELECT page_id, url, page_id % 3 = 0, 1, DATE '2025-12-20' FROM first WHERE page_id % 5 = 0),
      newest AS (
        SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS domain, url SIMILAR TO '[a-z]+://[^/]*/' AS root, page_id % 11 <> 2 AS readable,
               (1950 + (page_id + shift) % 70) || ',' || (10 + (page_id + shift) % 80) || ',' || flag AS body
        FROM landed WHERE day >= DATE '2025-11-02' QUALIFY row_number() OVER (PARTITION BY url ORDER BY day DESC, page_id DESC) = 1),
      sites AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS domain FROM first),
      homes AS (SELECT domain, arg_min(url, (day, page_id)) FILTER (root) AS home, count(*) AS n FROM newest GROUP BY 1),
      placed AS (
        SELECT x.*, n >= 2 AND home IS NOT NULL AS whole,
               row_number() OVER (PARTITION BY domain ORDER BY url IS DISTINCT FROM home, NOT root, day, page_id) AS alone,
               row_number() OVER (PARTITION BY domain ORDER BY url IS DISTINCT FROM home, day, page_id) AS place
        FROM newest x JOIN homes USING (domain)),
      chosen AS (SELECT * FROM placed WHERE CASE WHEN whole THEN place <= 6 ELSE alone = 1 END),
      facts AS (SELECT domain, count(DISTINCT CASE WHEN readable THEN body ELSE 'tiny' END) AS pages, bool_or(readable) AS enough,
                  coalesce(bool_or(flag) FILTER (readable), false) AS flagged FROM chosen GROUP BY 1)
      SELECT domain, CAST(profile_id AS BIGINT) AS profile_id, CASE WHEN reused THEN 'reused' ELSE 'done' END AS status,
             CASE WHEN reused OR NOT enough THEN NULL WHEN profile_id = 1 AND flagged THEN 55.6 ELSE 100.0 END::DOUBLE AS score,
             CASE WHEN reused THEN NULL WHEN NOT enough THEN 0.0 WHEN profile_id = 1 THEN 100.0 ELSE 50.0 END::DOUBLE AS coverage,
             CASE WHEN reused THEN NULL WHEN profile_id = 1 AND flagged THEN 44.4 ELSE 0.0 END::DOUBLE AS penalty,
             CASE WHEN NOT reused THEN pages END AS pages_fetched, CASE WHEN reused OR enough THEN NULL WHEN pages = 0 THEN 'site_unreadable' ELSE 'content_too_thin' END AS no_evidence_reason,
             CASE WHEN reused THEN NULL WHEN NOT enough THEN 'skipped' WHEN profile_id = 1 AND flagged THEN 'red_flag' ELSE 'ok' END AS note_status,
             CASE WHEN NOT reused THEN CAST(1 AS BIGINT) END AS n_records
      FROM (SELECT domain, coalesce(pages, 0) AS pages, coalesce(enough, false) AS enough, coalesce(flagged, false) AS flagged, length(domain) % 4 = 0 AS reused FROM sites LEFT JOIN facts USING (domain)), range(1, 3) r(profile_id)""",
}
