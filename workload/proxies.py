"""The pipeline's tables, mapped from the driver's tables (see FIXTURES.md part B).

Every mapping exists twice: as DataFrame code and as the SQL text used in the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.scoring import last_result_per_criterion
from attesta.schemas import CRITERIA
from attesta.session import literal_relation

PROFILE_COUNT = 5
CRITERIA_COUNT = 7


#: Tables of texts and their keys. Text work is heavy per byte and these files may have one split
#: each, so their rows are always dealt out by key.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(TEXT_TABLES[name]) if name in TEXT_TABLES else rows


def criterion_rows(profile_id: int) -> list[tuple]:
    return [
        (f"c{n}", f"Label {n}", 1 + (n * profile_id) % 5, f"Does item {n} hold?",
         "negative" if n >= 6 else "positive")
        for n in range(1, CRITERIA_COUNT + 1)
    ]


def profiles(spark: SparkSession) -> DataFrame:
    """Five profiles of seven criteria; a constant of the check, hence of fixed size."""
    schema = T.StructType([
        T.StructField("profile_id", T.LongType()),
        T.StructField("profile_name", T.StringType()),
        T.StructField("criteria", CRITERIA),
    ])
    rows = [(p, f"Profile {p}", criterion_rows(p)) for p in range(1, PROFILE_COUNT + 1)]
    return literal_relation(spark, rows, schema)


WIDE_COUNT = 21


def wide_profile(spark: SparkSession) -> DataFrame:
    """One profile of 21 criteria, every second one negative; more than a cleaned profile holds."""
    schema = T.StructType([T.StructField("profile_id", T.LongType()), T.StructField("criteria", CRITERIA)])
    rows = [(f"w{n}", f"Label {n}", 1 + n % 5, f"Does item {n} hold?", "negative" if n % 2 else "positive") for n in range(WIDE_COUNT)]
    return literal_relation(spark, [(1, rows)], schema)


def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as results of the wide profile's criteria; the last line of a criterion counts."""
    rows = raw_results(spark, sf_dir).withColumn(
        "criterion_key", F.concat(F.lit("w"), ((F.col("result_pos") * 3 + F.col("l_suppkey") % 3) % WIDE_COUNT).cast("string")))
    return last_result_per_criterion(rows, [*RESULT_ORDER, "result_pos"], ("verdict",))


CRITERIA_SQL = """
criteria AS (
  SELECT p AS profile_id, n AS pos, 'c' || n AS key, 'Label ' || n AS label,
         CAST(1 + (n * p) % 5 AS INTEGER) AS weight, 'Does item ' || n || ' hold?' AS test,
         CASE WHEN n >= 6 THEN 'negative' ELSE 'positive' END AS polarity
  FROM range(1, 6) a(p), range(1, 8) b(n))"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example.com")).alias("domain"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
        F.lit(None).cast("string").alias("city"),
        F.col("n_name").alias("state"),
        F.when(F.col("c_acctbal") > 0, F.lit("11-50")).alias("employee_range"),
        F.lit(None).cast("string").alias("phone"),
    )


COMPANIES_SQL = """
companies AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) || '.example.com' AS domain, c_name AS name,
         c_mktsegment AS industry, CAST(NULL AS VARCHAR) AS city, n_name AS state,
         CASE WHEN c_acctbal > 0 THEN '11-50' END AS employee_range, CAST(NULL AS VARCHAR) AS phone
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_columns(table(spark, sf_dir, "orders"))


def scan_columns(orders: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "error")
        .otherwise("running")
    )
    return orders.select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("company_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("profile_id"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("finished_at"),
        F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("Note "), F.col("o_orderkey"))).alias("outreach_note"),
        F.when(F.col("o_totalprice") < 50000, F.lit("content_too_thin")).alias("no_evidence_reason"),
        F.when(status == "error", F.lit("HTTP 429")).alias("error"),
    )


SCANS_SQL = """
scans AS (
  SELECT o_orderkey AS scan_id, o_custkey AS company_id,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS profile_id,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'error' ELSE 'running' END AS status,
         o_orderdate AS finished_at,
         CASE WHEN o_totalprice > 250000 THEN 'Note ' || o_orderkey END AS outreach_note,
         CASE WHEN o_totalprice < 50000 THEN 'content_too_thin' END AS no_evidence_reason,
         CASE WHEN o_orderstatus = 'O' THEN 'HTTP 429' END AS error
  FROM orders)"""

RESULT_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_linestatus"]


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criterion results as written, repeats included; RESULT_ORDER gives the write order."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("scan_id"),
        F.concat(F.lit("c"), F.col("l_linenumber")).alias("criterion_key"),
        F.when(F.col("l_returnflag") == "A", "met")
        .when(F.col("l_returnflag") == "N", "not_met")
        .otherwise("unknown").alias("verdict"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("source_url"),
        F.when(F.col("l_linestatus") == "O", "exact").otherwise("none").alias("grounding"),
        F.col("l_linenumber").alias("result_pos"),
        *RESULT_ORDER,
    )


def results(spark: SparkSession, sf_dir: str, *payload: str, by_scan: bool = False) -> DataFrame:
    """The last result of each scan and criterion; left dealt out by scan if so asked."""
    raw = raw_results(spark, sf_dir)
    if by_scan:
        raw = raw.select("scan_id", "criterion_key", *payload, *RESULT_ORDER).repartition("scan_id")
    return last_result_per_criterion(raw, RESULT_ORDER, payload or None)


RESULTS_SQL = """
results AS (
  SELECT l_orderkey AS scan_id, 'c' || l_linenumber AS criterion_key,
         CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'not_met' ELSE 'unknown' END AS verdict,
         'p' || l_partkey AS source_url, CASE WHEN l_linestatus = 'O' THEN 'exact' ELSE 'none' END AS grounding,
         l_linenumber AS result_pos
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC, l_returnflag DESC,
             l_linestatus DESC) = 1)"""


def round1_sql(x: str) -> str:
    """One decimal, exact ties to even, exactly as attesta.functions.numbers.round1 defines it."""
    tens = f"(({x}) * 8.0::DOUBLE + ({x}) * 2.0::DOUBLE)"
    side = f"(({tens} - floor{tens} - 0.5::DOUBLE) + (({x}) * 2.0::DOUBLE - ({tens} - ({x}) * 8.0::DOUBLE)))"
    even = f"(floor{tens} % 2 = 0)"
    return (f"((CASE WHEN {side} > 0 OR ({side} = 0 AND NOT {even}) THEN floor{tens} + 1 "
            f"ELSE floor{tens} END) / 10.0::DOUBLE)")


SCORED_SQL = f"""
grid0 AS (
  SELECT s.scan_id, s.company_id, s.profile_id, c.pos, c.key, c.label, c.weight, c.polarity,
         CASE WHEN r.verdict IN ('met', 'not_met') THEN r.verdict ELSE 'unknown' END AS verdict,
         sum(CASE WHEN c.polarity = 'positive' THEN c.weight ELSE 0 END) OVER (PARTITION BY s.scan_id) AS total
  FROM scans s JOIN criteria c ON c.profile_id = s.profile_id
  LEFT JOIN results r ON r.scan_id = s.scan_id AND r.criterion_key = c.key),
grid AS (
  SELECT *, polarity = 'positive' AND verdict <> 'unknown' AS counted,
         polarity = 'negative' AND verdict = 'met' AS red_flag,
         CASE WHEN polarity = 'positive' AND verdict = 'met' THEN weight ELSE 0 END AS earned,
         CASE WHEN polarity = 'negative' AND verdict = 'met'
              THEN {round1_sql("100.0::DOUBLE * weight / total")} ELSE 0.0::DOUBLE END AS penalty
  FROM grid0),
sums AS (
  SELECT scan_id, company_id, profile_id, sum(earned) AS earned,
         sum(CASE WHEN counted THEN weight ELSE 0 END) AS known,
         sum(CASE WHEN counted THEN 1 ELSE 0 END) AS n_known,
         sum(CASE WHEN polarity = 'positive' THEN 1 ELSE 0 END) AS positives, min(total) AS total,
         coalesce(sum(penalty) FILTER (pos = 6), 0.0) + coalesce(sum(penalty) FILTER (pos = 7), 0.0) AS penalty
  FROM grid GROUP BY ALL),
scored AS (
  SELECT scan_id, company_id, profile_id, CAST(earned AS INTEGER) AS earned_weight,
         CAST(known AS INTEGER) AS known_weight, CAST(total AS INTEGER) AS total_weight,
         {round1_sql("penalty")} AS penalty,
         CASE WHEN known > 0 THEN {round1_sql("greatest(0.0::DOUBLE, 100.0::DOUBLE * earned / known - penalty)")} END AS score,
         {round1_sql("100.0::DOUBLE * n_known / positives")} AS coverage
  FROM sums)"""

WIDE_SQL = f"""
criteria AS (
  SELECT n AS pos, 'w' || n AS key, CAST(1 + n % 5 AS INTEGER) AS weight, CASE WHEN n % 2 = 1 THEN 'negative' ELSE 'positive' END AS polarity
  FROM range({WIDE_COUNT}) r(n)),
results AS (
  SELECT l_orderkey AS scan_id, 'w' || ((l_linenumber * 3 + l_suppkey % 3) % {WIDE_COUNT}) AS key,
         CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'not_met' ELSE 'unknown' END AS verdict
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, (l_linenumber * 3 + l_suppkey % 3) % {WIDE_COUNT}
    ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC, l_linenumber DESC) = 1),
total AS (SELECT sum(weight) AS total, count(*) AS positives FROM criteria WHERE polarity = 'positive'),
sums AS (
  SELECT o_orderkey AS scan_id, total, positives,
         coalesce(sum(weight) FILTER (polarity = 'positive' AND verdict = 'met'), 0) AS earned,
         coalesce(sum(weight) FILTER (polarity = 'positive' AND verdict IN ('met', 'not_met')), 0) AS known,
         count(*) FILTER (polarity = 'positive' AND verdict IN ('met', 'not_met')) AS n_known,
         list_reduce(list_prepend(0.0::DOUBLE, coalesce(list({round1_sql("100.0::DOUBLE * weight / total")} ORDER BY pos) FILTER (polarity = 'negative' AND verdict = 'met'), [])),
                     lambda a, b: a + b) AS penalty
  FROM orders CROSS JOIN total LEFT JOIN results ON results.scan_id = o_orderkey LEFT JOIN criteria USING (key) GROUP BY ALL)"""

SCAN_TABLES_SQL = ",".join([CRITERIA_SQL, SCANS_SQL, RESULTS_SQL, SCORED_SQL])
