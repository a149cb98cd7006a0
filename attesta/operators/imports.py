"""Lead import: normalise, keep the first row per domain, add what is new, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import clean
from attesta.functions.urls import normalize_domain


def normalized_leads(raw: DataFrame) -> DataFrame:
    """Lead rows with a normalised domain (null when unusable) and cleaned fields."""
    fields = [c for c in raw.columns if c not in ("domain", "source", "row_pos")]
    return raw.select(
        normalize_domain(F.col("domain")).alias("domain"),
        *[clean(F.col(c)).alias(c) for c in fields],
        F.coalesce(clean(F.col("source")), F.lit("csv")).alias("source"),
        "row_pos",
    )


def first_per_domain(leads: DataFrame) -> DataFrame:
    """The first row of each domain in file order. ``min_by`` combines before the shuffle, so a
    domain repeated millions of times sends one row per task."""
    payload = [c for c in leads.columns if c not in ("domain", "row_pos")]
    return (
        leads.filter(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(F.min_by(F.struct(*payload), "row_pos").alias("row"))
        .select("domain", "row.*")
    )


def new_leads(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append to the companies table: insert if absent."""
    return first_per_domain(normalized_leads(raw)).join(existing.select("domain"), "domain", "left_anti")


def lookup_companies(requests: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (with ``wanted``, a website or domain) with the company they mean, and the companies
    to create for the others, once each: their name is the domain. What does not read as a domain is
    looked up as it is.

    companies: id, domain. ``company_id`` is null where the company is to be created.
    """
    asked = requests.withColumn("domain", F.coalesce(normalize_domain(F.col("wanted")), F.col("wanted")))
    found = asked.join(companies.groupBy("domain").agg(F.min("id").alias("company_id")), "domain", "left")
    new = found.filter(F.col("company_id").isNull() & F.col("domain").isNotNull()).select("domain").distinct()
    return found, new.select("domain", F.col("domain").alias("name"), F.lit("lookup").alias("source"))


def import_counters(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: total_rows, no_domain_skipped, duplicates_skipped (in file and in table), inserted."""
    per_domain = (
        raw.select(normalize_domain(F.col("domain")).alias("domain"))
        .groupBy("domain").agg(F.count("*").alias("n"))
    )
    known = existing.select("domain").distinct().withColumn("known", F.lit(True))
    new = F.when(F.col("domain").isNotNull() & F.col("known").isNull(), 1).otherwise(0)
    counted = per_domain.join(known, "domain", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("domain").isNull(), F.col("n"))), F.lit(0)).alias("no_domain_skipped"),
        F.coalesce(F.sum(new), F.lit(0)).alias("inserted"),
    )
    return counted.select(
        "total_rows", "no_domain_skipped",
        (F.col("total_rows") - F.col("no_domain_skipped") - F.col("inserted")).alias("duplicates_skipped"),
        "inserted",
    )
