"""Latest scan per company and what is shown of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import display
from attesta.operators.scoring import is_met, is_red_flag
from attesta.schemas import DECISIVE


def latest_order() -> Column:
    """A finished scan beats a later failed one; then the newest; ties by id."""
    return F.struct(F.col("status") == "done", F.col("finished_at"), F.col("scan_id"))


SCAN_KEYS = ("company_id", "profile_id")


def latest_scans(scans: DataFrame, profile_id: int | None = None, keys: tuple[str, ...] = SCAN_KEYS) -> DataFrame:
    """One finished scan per company and profile, of one profile if given. ``max_by`` combines
    map-side, so a company holding much of the table still sends one row per task."""
    if profile_id is not None:
        scans = scans.filter(F.col("profile_id") == profile_id)
    payload = [c for c in scans.columns if c not in keys]
    return (
        scans.filter(F.col("status").isin("done", "error"))
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), latest_order()).alias("row"))
        .select(*keys, "row.*")
    )


def summary_aggregates(top: int = 3) -> tuple[Column, ...]:
    """Aggregates over ``with_criteria`` rows for the lead list. The criteria of a scan's profile
    bound what is gathered per scan."""
    met = (F.col("polarity") == "positive") & is_met()
    chip = F.struct((-F.col("weight")).alias("w"), "pos", "label")
    flag = F.struct("pos", "label")
    decisive = F.col("verdict").isin(*DECISIVE) & F.col("source_url").isNotNull()
    source = F.struct("result_pos", "source_url")
    gather = lambda cond, row: F.array_sort(F.collect_list(F.when(cond, row)))
    return (
        F.transform(F.slice(gather(met, chip), 1, top), lambda r: r["label"]).alias("met_criteria"),
        F.transform(gather(is_red_flag(), flag), lambda r: r["label"]).alias("red_flags"),
        F.array_distinct(F.transform(gather(decisive, source), lambda r: r["source_url"])).alias("evidence_urls"),
    )


def lead_list(companies: DataFrame, summaries: DataFrame) -> DataFrame:
    """Companies with a nested summary of their latest scan, null when never scanned."""
    scan = F.struct(
        "scan_id", "status", "score", "coverage", "met_criteria", "red_flags",
        "no_evidence_reason", "finished_at", "error",
    )
    nested = summaries.select(F.col("company_id").alias("id"), scan.alias("scan"))
    return companies.join(nested, "id", "left")


def ranked_leads(companies: DataFrame, summaries: DataFrame, scanned_only: bool = False) -> DataFrame:
    """Companies with their summary columns and rank, best verified first, unscored last."""
    leads = companies.join(
        summaries.withColumnRenamed("company_id", "id"), "id", "inner" if scanned_only else "left"
    ).withColumn("rank_value", display.rank_value(F.col("score"), F.col("coverage")))
    return leads.orderBy(
        F.col("rank_value").desc(), F.coalesce(F.col("score"), F.lit(-1.0)).desc(), F.col("id").asc()
    )


def sort_leads(leads: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Interactive ordering by name, score, coverage or rank; missing numbers count as -1."""
    if by == "name":
        keys = [F.col("name")]
    elif by == "rank":
        keys = [
            display.rank_value(F.col("score"), F.col("coverage")),
            F.coalesce(F.col("score"), F.lit(-1.0)),
        ]
    elif by in ("score", "coverage"):
        keys = [F.coalesce(F.col(by), F.lit(-1.0))]
    else:
        raise ValueError(f"cannot sort leads by {by!r}")
    return leads.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def filter_leads(
    leads: DataFrame, search: str = "", scanned_only: bool = False, min_score: int | None = None
) -> DataFrame:
    """Search text in name or domain (any case), scanned leads only, lowest rounded score."""
    needle = search.strip().lower()
    if needle:
        leads = leads.filter(
            F.contains(F.lower("name"), F.lit(needle)) | F.contains(F.lower("domain"), F.lit(needle))
        )
    if scanned_only:
        leads = leads.filter(F.col("scan_id").isNotNull())
    if min_score is not None:
        shown = F.coalesce(F.col("score"), F.lit(-1.0))
        leads = leads.filter(display.rounded(shown) >= min_score)
    return leads
