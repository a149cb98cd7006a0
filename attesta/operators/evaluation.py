"""Evaluation of scans against hand-checked cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.schemas import DECISIVE

CACHED_BELOW_SECONDS = 5
CASE = (
    "struct<domain:string, icp:string, expected_facts:array<string>, expected_verdicts:map<string,string>>"
)


def accepted_verdicts(expected: Column) -> Column:
    """Map of criterion to its accepted verdicts; a value is one verdict or a list of them."""
    return F.transform_values(
        expected,
        lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))


def golden_cases(cases: DataFrame) -> DataFrame:
    """cases: one row per case as in the file. Null lists become empty."""
    return cases.select(
        "domain", "icp",
        F.coalesce("expected_facts", F.array().cast("array<string>")).alias("expected_facts"),
        accepted_verdicts(F.coalesce("expected_verdicts", F.expr("cast(map() as map<string,string>)"))).alias("accepted"),
    )


def read_golden(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Cases of a golden file, optionally those of one domain."""
    rows = spark.read.schema(f"cases array<{CASE}>").json(path, multiLine=True).select(F.inline("cases"))
    return golden_cases(rows if only is None else rows.filter(F.col("domain") == only))


def agreement(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per case and expected criterion: what was accepted, what came out, whether it agrees
    (null when the criterion is no longer judged).

    cases: scan_id, accepted; verdicts: scan_id, criterion_key, verdict.
    """
    expected = cases.select("scan_id", F.explode("accepted").alias("criterion_key", "ok"))
    got = verdicts.select("scan_id", "criterion_key", "verdict")
    return expected.join(got, ["scan_id", "criterion_key"], "left").select(
        "scan_id", "criterion_key", F.array_join("ok", "|").alias("expected"),
        F.coalesce("verdict", F.lit("missing")).alias("got"),
        F.array_contains("ok", F.col("verdict")).alias("agrees"))


def evaluate(cases: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Metrics of each case.

    cases: scan_id, domain, latency, expected_facts, accepted; facts: scan_id, id, fact,
    evidence_quote, grounding; verdicts: scan_id, criterion_key, verdict, grounding, evidence_quote.
    A scan holds at most 42 facts, whose texts are joined to look for the expected ones, and one
    verdict per criterion of its profile; each table is aggregated once.
    """
    said = F.struct("id", F.concat_ws(" ", "fact", F.coalesce("evidence_quote", F.lit(""))).alias("said"))
    count = lambda state: F.count_if(F.col("grounding") == state).alias(state)
    stated = facts.groupBy("scan_id").agg(
        F.count("*").alias("facts"), *[count(s) for s in ("exact", "fuzzy", "record", "none")],
        F.array_sort(F.collect_list(F.when(F.col("grounding") != "none", said))).alias("texts"))
    decisive = F.col("verdict").isin(*DECISIVE)
    backed = (F.col("grounding") != "none") & (F.coalesce("evidence_quote", F.lit("")) != "")
    judged = verdicts.groupBy("scan_id").agg(
        F.bool_and(~decisive | backed).alias("all_grounded"),
        F.map_from_entries(F.collect_list(F.when(F.col("verdict").isNotNull(), F.struct("criterion_key", "verdict")))).alias("got"))
    hay = F.lower(F.array_join(F.transform("texts", lambda t: t["said"]), " "))
    joined = cases.join(stated, "scan_id", "left").join(judged, "scan_id", "left").withColumn("hay", hay)
    hits = F.size(F.filter("expected_facts", lambda s: F.coalesce(F.contains(F.col("hay"), F.lower(s)), F.lit(False))))
    known = F.filter(F.map_keys("accepted"), lambda k: F.coalesce(F.map_contains_key("got", k), F.lit(False)))
    agreeing = F.filter(known, lambda k: F.array_contains(F.element_at("accepted", k), F.element_at("got", k)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "scan_id", "domain", *[zero(c) for c in ("facts", "exact", "fuzzy", "record", "none")],
        hits.cast("bigint").alias("fact_hits"), F.size("expected_facts").cast("bigint").alias("fact_expected"),
        F.size(known).cast("bigint").alias("judged"), F.size(agreeing).cast("bigint").alias("agreed"),
        F.coalesce("all_grounded", F.lit(True)).alias("all_grounded"), "latency",
        (F.col("latency") < CACHED_BELOW_SECONDS).alias("cached"))


def report(evaluated: DataFrame) -> DataFrame:
    """Totals per domain and over all (domain null)."""
    grounded = F.sum(F.col("exact") + F.col("fuzzy") + F.col("record"))
    total = lambda c: F.sum(c).alias(c)
    return evaluated.rollup("domain").agg(
        F.count("*").alias("cases"), total("facts"), grounded.alias("grounded"),
        F.floor(100.0 * grounded / F.greatest(F.sum("facts"), F.lit(1)) + 0.5).alias("grounded_pct"),
        total("exact"), total("fuzzy"), total("record"), total("none"), total("fact_hits"), total("fact_expected"),
        total("judged"), total("agreed"), F.bool_and("all_grounded").alias("all_grounded"),
        F.count_if(~F.col("cached")).alias("fresh_scans"),
        F.avg(F.when(~F.col("cached"), F.col("latency"))).alias("mean_latency"))


def render(totals: DataFrame, title: str = "Evaluation") -> str:
    """The grand total as a few lines of Markdown (one row reaches the driver)."""
    t = totals.filter(F.col("domain").isNull()).head(1)
    if not t or not t[0].cases:
        return f"# {title}\n\nNo cases.\n"
    t = t[0]
    latency = f"{t.mean_latency:.1f} s over {t.fresh_scans}" if t.fresh_scans else "no fresh scans"
    return "\n".join((
        f"# {title}", "",
        f"- Cases: {t.cases}, facts: {t.facts}, grounded: {t.grounded} ({t.grounded_pct}%): exact {t.exact}, "
        f"fuzzy {t.fuzzy}, record {t.record}, none {t.none}",
        f"- Expected facts found: {t.fact_hits} of {t.fact_expected}",
        f"- Verdicts as expected: {t.agreed} of {t.judged}",
        f"- Every decisive verdict has a verified quote: {'yes' if t.all_grounded else 'no'}",
        f"- Mean latency of fresh scans: {latency}", ""))
