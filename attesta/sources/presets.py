"""Preset profiles, their short names, and profile lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import literal_relation

# The two preset profiles and their aliases.
PRESETS = (
    (
        "Search-fund buy-box",
        "Established, owner-operated service businesses that could be acquired from a retiring "
        "founder. Ideally in business for 20+ years, family-run or founder-led with the owner still "
        "visibly involved, a small team (roughly 5–50 people), serving a local or regional market, and "
        "with no obvious succession plan. Signs of an under-invested digital presence (dated website, "
        "old copyright year, no careers page) are a plus because they point to operational upside after "
        "acquisition. Avoid franchises, private-equity-backed companies, and businesses that are clearly "
        "part of a larger group.",
    ),
    (
        "B2B sales ICP",
        "Growing small-to-mid-sized companies that are likely to buy B2B software or services now. "
        "Look for active hiring (careers page with open roles), multiple locations or recent expansion, "
        "a modern web stack or online booking/quoting, a clearly named decision-maker (owner, operations "
        "or IT lead) with public contact details, and signs of recent investment such as new services, "
        "certifications or awards. Deprioritize companies with no web presence, single-person "
        "operations, or signs of decline.",
    ),
)
PRESET_ALIASES = (("buybox", "Search-fund buy-box"), ("sales", "B2B sales ICP"))
PRESET_NAMES = tuple(name for name, _ in PRESETS)


def _text_columns(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def preset_profiles(spark: SparkSession) -> DataFrame:
    return literal_relation(spark, PRESETS, _text_columns("name", "description_text"))


def lookup_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests (with ``wanted``) and the profile they mean: a number is an id first; otherwise, or
    when no profile has it, the text is an alias or a name. Null when nothing fits."""
    aliases = F.create_map(*[F.lit(part) for pair in PRESET_ALIASES for part in pair])
    by_id = profiles.select(F.col("profile_id").alias("id_match"), F.col("profile_id").alias("_id"))
    by_name = profiles.select(F.col("profile_id").alias("name_match"), F.col("profile_name").alias("_name"))
    number = F.when(F.col("wanted").rlike("^[0-9]+$"), F.col("wanted").try_cast("bigint"))
    name = F.coalesce(F.try_element_at(aliases, F.col("wanted")), F.col("wanted"))
    return (
        requests.withColumns({"_number": number, "_text": name})
        .join(by_id, F.col("_number") == F.col("_id"), "left")
        .join(by_name, F.col("_text") == F.col("_name"), "left")
        .withColumn("profile_id", F.coalesce("id_match", "name_match"))
        .select(*requests.columns, "profile_id")
    )
