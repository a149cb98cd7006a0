"""Leads from map elements (JSON answers of a map database)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import clean
from attesta.functions.urls import normalize_domain
from attesta.session import new_folder, stage

# Elements that are not service businesses.
SKIPPED_HOSTS = (
    "facebook.com", "yelp.com", "instagram.com", "linkedin.com", "google.com", "angi.com",
    "nextdoor.com", "kohler.com",
)
SKIPPED_NAMES = r"(?i)\b(supply|wholesale|distributors?|local\s+\d+|union|benefit|training center)\b"

ELEMENTS = "struct<elements: array<struct<type: string, id: bigint, tags: map<string,string>>>>"


def elements(answers: DataFrame) -> DataFrame:
    """answers: industry, answer_pos, answer (JSON). One row per element, in answer order."""
    parsed = answers.select(
        "industry", "answer_pos",
        F.posexplode(F.from_json("answer", ELEMENTS)["elements"]).alias("element_pos", "e"),
    )
    return parsed.select("industry", F.struct("answer_pos", "element_pos").alias("pos"), "e.*")


def candidate_leads(found: DataFrame) -> DataFrame:
    """Elements that look like service businesses with a site of their own."""
    tag = lambda *names: F.coalesce(
        *[F.nullif(F.try_element_at("tags", F.lit(n)), F.lit("")) for n in names], F.lit(""))
    domain = normalize_domain(F.split(tag("website", "contact:website"), ";")[0])
    skipped = F.exists(F.array(*[F.lit(h) for h in SKIPPED_HOSTS]), lambda h: F.endswith(F.col("domain"), h))
    return (
        found.select(
            "industry", "pos",
            domain.alias("domain"),
            clean(tag("name")).alias("name"),
            tag("addr:city").alias("city"),
            tag("addr:state").alias("state"),
            tag("phone", "contact:phone").alias("phone"),
            F.concat(F.lit("osm:"), "type", F.lit("/"), F.col("id").cast("string")).alias("source"),
        )
        .filter(F.col("domain").isNotNull() & F.col("name").isNotNull())
        .filter(~skipped & ~F.col("name").rlike(SKIPPED_NAMES))
    )


def element_leads(answers: DataFrame, industries: Sequence[str], per_industry: int = 65) -> DataFrame:
    """At most ``per_industry`` leads of each industry; a domain is taken once, by the first
    industry that keeps it. Industries build on each other; the candidates and the picks of each
    step are stage tables, so that the plan does not grow with their number."""
    folder = new_folder(answers.sparkSession, "elements")
    candidates = stage(candidate_leads(elements(answers)), f"{folder}/candidates")
    kept: DataFrame | None = None
    for place, industry in enumerate(industries):
        own = candidates.filter(F.col("industry") == industry)
        if kept is not None:
            own = own.join(kept.select("domain"), "domain", "left_anti")
        payload = [c for c in candidates.columns if c != "domain"]
        chosen = (
            own.groupBy("domain").agg(F.min_by(F.struct(*payload), "pos").alias("row"))
            .select("domain", "row.*").orderBy("pos").limit(per_industry)
        )
        chosen = stage(chosen, f"{folder}/{place}")
        kept = chosen if kept is None else kept.unionByName(chosen)
    return kept.drop("pos")
