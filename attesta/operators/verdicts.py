"""Judgments checked against grounded facts, and what a scan shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.operators.answers import valid_verdict
from attesta.operators.facts import is_grounded

MAX_JUDGE_FACTS = 30
REASON_LENGTH = 300

# Reasons given without a judgment.
NO_JUDGMENT = "Not judged."
NO_FACTS = "No verified facts available."
THIN_SITE = "Site returned almost no readable text."
UNREAD_SITE = "Site could not be read."


def facts_to_judge(facts: DataFrame, limit: int = MAX_JUDGE_FACTS) -> DataFrame:
    """Grounded facts offered for judging: record facts first, then by number; ``judge_pos`` from 1."""
    order = W.partitionBy("scan_id").orderBy((F.col("category") != "domain_record"), "id")
    return (
        facts.filter(is_grounded(F.col("grounding")))
        .withColumn("judge_pos", F.row_number().over(order)).filter(F.col("judge_pos") <= limit)
    )


def check_verdicts(scans: DataFrame, criteria: DataFrame, judgments: DataFrame, offered: DataFrame) -> DataFrame:
    """One row per scan and criterion with the verdict that survives.

    scans: scan_id, profile_id, no_evidence_reason; criteria: profile_id, criterion_key, pos;
    judgments: scan_id, judgment_pos, criterion_key, verdict, fact_ids, reasoning; offered: rows of
    ``facts_to_judge``. A decisive verdict that cites no offered fact becomes unknown; the first
    offered fact cited supplies the evidence.
    """
    last = judgments.groupBy("scan_id", "criterion_key").agg(
        F.max_by(F.struct("verdict", "fact_ids", "reasoning"), "judgment_pos").alias("j"))
    evidence = F.struct("evidence_quote", "source_url", "grounding")
    cited = (
        last.select("scan_id", "criterion_key", F.posexplode("j.fact_ids").alias("cite_pos", "id"))
        .join(offered.select("scan_id", "id", evidence.alias("evidence")), ["scan_id", "id"])
        # a citation list is one field of one answer, which bounds what is gathered here
        .groupBy("scan_id", "criterion_key").agg(
            F.array_sort(F.collect_list(F.struct("cite_pos", "id"))).alias("cites"),
            F.min_by("evidence", "cite_pos").alias("evidence"))
    )
    has_facts = offered.select("scan_id").distinct().withColumn("has_facts", F.lit(True))
    grid = (
        scans.select("scan_id", "profile_id", "no_evidence_reason")
        .join(criteria.select("profile_id", "criterion_key", "pos"), "profile_id")
        .join(has_facts, "scan_id", "left")
        .join(last, ["scan_id", "criterion_key"], "left")
        .join(cited, ["scan_id", "criterion_key"], "left")
    )
    unread = F.col("no_evidence_reason").isNotNull()
    skipped = unread | F.col("has_facts").isNull()
    judged = ~skipped & F.col("j").isNotNull()
    ids = F.when(judged, F.transform("cites", lambda c: c["id"]))
    decisive = F.col("j.verdict") != "unknown"
    downgraded = judged & decisive & F.col("cites").isNull()
    reasoning = (
        F.when(unread, F.when(F.col("no_evidence_reason") == "content_too_thin", THIN_SITE).otherwise(UNREAD_SITE))
        .when(skipped, NO_FACTS).when(~judged, NO_JUDGMENT)
        .when(downgraded, F.concat(F.lit("Downgraded: no verified fact cited. ("), F.coalesce("j.reasoning", F.lit("")), F.lit(")")))
        .otherwise(F.col("j.reasoning"))
    )
    return grid.select(
        "scan_id", "profile_id", "criterion_key", "pos",
        F.when(judged & ~downgraded, F.col("j.verdict")).otherwise(F.lit("unknown")).alias("verdict"),
        F.coalesce(ids, F.array().cast("array<int>")).alias("fact_ids"),
        F.substring(reasoning, 1, REASON_LENGTH).alias("reasoning"),
        F.when(judged, F.col("evidence.evidence_quote")).alias("evidence_quote"),
        F.when(judged, F.col("evidence.source_url")).alias("source_url"),
        F.when(judged, F.coalesce("evidence.grounding", F.lit("none"))).otherwise(F.lit("none")).alias("grounding"),
    )


def scan_details(scans: DataFrame, profiles: DataFrame, criteria: DataFrame, companies: DataFrame,
                 results: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per stored scan with its company, profile, criteria (definitions merged in, defaults
    where a criterion no longer exists), grounded facts, red flags and note status.

    A scan has at most eight results, which are nested in its row; facts are only counted.
    """
    definition = criteria.select("profile_id", "criterion_key", "label", "weight", "polarity", "test")
    merged = results.join(scans.select("scan_id", "profile_id"), "scan_id").join(
        definition, ["profile_id", "criterion_key"], "left")
    row = F.struct(
        "result_pos", F.col("criterion_key").alias("key"),
        F.coalesce("label", "criterion_key").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"),
        F.coalesce("polarity", F.lit("positive")).alias("polarity"), F.coalesce("test", F.lit("")).alias("test"),
        "verdict", "source_url", "grounding")
    per_scan = merged.groupBy("scan_id").agg(F.array_sort(F.collect_list(row)).alias("criteria"))
    counted = facts.groupBy("scan_id").agg(
        F.count("*").alias("n_facts"), F.count_if(F.col("grounding") != "none").alias("n_grounded"))
    company = companies.select(F.col("id").alias("company_id"), F.struct("id", "name", "domain").alias("company"))
    joined = (
        scans.join(profiles.select("profile_id", "profile_name"), "profile_id", "left")
        .join(company, "company_id", "left")
        .join(per_scan, "scan_id", "left").join(counted, "scan_id", "left")
        .withColumn("n_grounded", F.coalesce("n_grounded", F.lit(0)))
        .withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    )
    flags = F.transform(
        F.filter("criteria", lambda c: (c["polarity"] == "negative") & (c["verdict"] == "met")), lambda c: c["label"])
    return joined.withColumn("red_flags", F.coalesce(flags, F.array().cast("array<string>"))).withColumn(
        "note_status",
        note_status(F.col("outreach_note"), F.size("red_flags") > 0, F.col("no_evidence_reason"), F.col("n_grounded")))


def note_status(note: Column, has_flags: Column, reason: Column, n_grounded: Column) -> Column:
    return (
        F.when(F.coalesce(note, F.lit("")) != "", "ok").when(has_flags, "red_flag")
        .when(reason.isNotNull() | (n_grounded < 2), "skipped").otherwise("unverified")
    )


def numbered_facts(facts: DataFrame) -> DataFrame:
    """Stored facts (id, scan_id, …) with the number shown for them, from 1 in each scan. A scan
    stores at most 42."""
    return facts.withColumn("display_id", F.row_number().over(W.partitionBy("scan_id").orderBy("id")))
