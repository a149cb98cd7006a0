"""Request tables for the model calls: one row per call, its text assembled from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.schemas import FACT_CATEGORIES

# Our own instructions; a deployment may pass others.
EXTRACT_INSTRUCTIONS = (
    "List what this page states about the company. Quote it word for word, at most 200 characters. "
    "Categories: " + ", ".join(FACT_CATEGORIES) + ". Leave out anything the page does not say."
)
JUDGE_INSTRUCTIONS = (
    "Decide each criterion from the numbered facts alone: met or not_met with the ids of the facts "
    "that show it, otherwise unknown."
)
NOTE_INSTRUCTIONS = (
    "Write four plain sentences to the company's owner. Use exactly two of the facts, mark each as "
    "[F<id>] after the sentence that uses it, and state nothing else."
)


def fact_line(with_category: bool = True) -> Column:
    """id | category | fact | "quote" | source"""
    parts = [F.col("id").cast("string")] + ([F.col("category")] if with_category else [])
    quoted = F.concat(F.lit('"'), F.coalesce("evidence_quote", F.lit("")), F.lit('"'))
    return F.concat_ws(" | ", *parts, "fact", quoted, F.coalesce("source_url", F.lit("")))


def _lines(order: str, line: Column, name: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return F.array_join(F.transform(rows, lambda r: r["l"]), "\n").alias(name)


def extract_requests(pages: DataFrame) -> DataFrame:
    """pages: scan_id, domain, url, text."""
    text = F.concat(
        F.lit("Site "), "domain", F.lit(", address "), "url", F.lit("\n--- begin page ---\n"), "text", F.lit("\n--- end page ---"))
    return pages.withColumns({"instructions": F.lit(EXTRACT_INSTRUCTIONS), "request": text})


def judge_requests(scans: DataFrame, criteria: DataFrame, offered: DataFrame) -> DataFrame:
    """One request per scan that has offered facts (at most thirty) and a profile with criteria (at
    most eight), the sizes that bound its text.

    scans: scan_id, profile_id, name, domain, pages (text), records (text).
    """
    criterion = F.concat(
        F.lit("- "), "criterion_key", F.lit(" (weight "), F.col("weight").cast("string"), F.lit(", "),
        "polarity", F.lit("): "), "test")
    criteria_text = criteria.groupBy("profile_id").agg(_lines("pos", criterion, "criteria_lines"))
    facts_text = offered.groupBy("scan_id").agg(_lines("judge_pos", fact_line(), "fact_lines"))
    request = F.concat(
        F.lit("# Business\n"), F.coalesce("name", "domain"), F.lit(", "), "domain", F.lit("\n# Addresses read\n"),
        F.coalesce("pages", F.lit("-")), F.lit("\n# Public records\n"), F.coalesce("records", F.lit("-")),
        F.lit("\n# To decide\n"), "criteria_lines", F.lit("\n# Known facts by id\n"), "fact_lines")
    return scans.join(facts_text, "scan_id").join(criteria_text, "profile_id").select(
        "scan_id", F.lit(JUDGE_INSTRUCTIONS).alias("instructions"), request.alias("request"))


def note_requests(scans: DataFrame, met: DataFrame, to_cite: DataFrame) -> DataFrame:
    """One request per scan with facts to cite (at most twelve).

    scans: scan_id, profile_name, name, domain, feedback; met: scan_id, criterion_key, pos of the
    criteria met.
    """
    met_keys = F.array_sort(F.collect_list(F.struct("pos", "criterion_key")))
    met_text = met.groupBy("scan_id").agg(
        F.array_join(F.transform(met_keys, lambda m: m["criterion_key"]), ", ").alias("met"))
    facts_text = to_cite.groupBy("scan_id").agg(_lines("note_pos", fact_line(with_category=False), "fact_lines"))
    request = F.concat(
        F.lit("# Addressee\n"), F.coalesce("name", "domain"), F.lit(", "), "domain", F.lit("\n# Written for\n"), "profile_name",
        F.lit("\n# Fulfilled\n"), F.coalesce("met", F.lit("-")), F.lit("\n# Citable facts by id\n"), "fact_lines",
        F.when(F.coalesce("feedback", F.lit("")) != "", F.concat(F.lit("\n# Last draft\n"), "feedback")).otherwise(F.lit("")))
    return scans.join(facts_text, "scan_id").join(met_text, "scan_id", "left").select(
        "scan_id", F.lit(NOTE_INSTRUCTIONS).alias("instructions"), request.alias("request"))
