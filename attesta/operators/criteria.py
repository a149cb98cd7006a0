"""Profiles: cleaning of criteria, edits, creation, and what needs compiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numbers import let
from attesta.functions.text import clean, description_hash, slug
from attesta.schemas import CRITERIA
from attesta.session import with_computed
from attesta.sources.presets import PRESET_NAMES

MAX_CRITERIA = 8
KEY_LABEL = 80
TEST_LENGTH = 400
NAME_LENGTH = 120


def clean_criteria(raw: Column) -> Column:
    """Criteria as stored: unique slug keys, weights 1 to 5, a polarity, the first eight.

    raw: array of (key, label, weight, test, polarity), all strings. Works on one row's array in
    order, because a key depends on the keys before it.
    """
    filled = lambda c: F.nullif(c, F.lit(""))

    def tidied(c: Column) -> Column:
        return F.struct(
            slug(F.coalesce(filled(c["key"]), filled(c["label"]), F.lit(""))).alias("base"),
            filled(c["label"]).alias("label"),
            F.coalesce(F.nullif(F.trim(c["weight"]).try_cast("int"), F.lit(0)), F.lit(1)).alias("weight"),
            F.substring(F.coalesce(clean(c["test"]), F.lit("")), 1, TEST_LENGTH).alias("test"),
            F.when(F.lower(c["polarity"]) == "negative", F.lit("negative")).otherwise(F.lit("positive")).alias("polarity"),
        )

    def free_key(done: Column, base: Column) -> Column:
        taken = F.transform(done, lambda d: d["key"])
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(base, F.lit("_"), n.cast("string")))
        free = F.filter(numbered, lambda k: ~F.array_contains(taken, k))
        return F.when(~F.array_contains(taken, base), base).otherwise(F.try_element_at(free, F.lit(1)))

    def step(done: Column, c: Column) -> Column:
        def appended(key: Column) -> Column:
            label = F.coalesce(c["label"], F.replace(key, F.lit("_"), F.lit(" ")))
            return F.array_append(done, F.struct(
                key.alias("key"),
                F.substring(F.coalesce(clean(label), F.lit("")), 1, KEY_LABEL).alias("label"),
                F.greatest(F.lit(1), F.least(F.lit(5), c["weight"])).alias("weight"),
                c["test"].alias("test"),
                c["polarity"].alias("polarity"),
            ))

        return let(free_key(done, c["base"]), appended)

    # what depends on one criterion alone is worked out once; later ones than the first eight change nothing
    tidy = F.transform(F.slice(raw, 1, MAX_CRITERIA), tidied)
    return F.aggregate(tidy, F.array().cast(CRITERIA), step)


def needs_compile() -> Column:
    """No criteria yet, or the description has changed since they were made."""
    current = description_hash(F.col("description_text"))
    return (F.size("criteria") <= 0) | ~F.col("description_hash").eqNullSafe(current)


def compile_problem() -> Column:
    """Why a profile may not be compiled, null if it may."""
    return (
        F.when(F.col("name").isin(*PRESET_NAMES), F.lit("preset"))
        .when(clean(F.col("description_text")).isNull(), F.lit("empty description"))
    )


def update_profiles(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles after their edits, with ``problem`` where an edit was refused as a whole.

    profiles: profile_id, name, description_text, description_hash, criteria;
    edits: profile_id, new_name, new_description, new_criteria (raw array), null where untouched; one
    row per profile. Presets do not change, and edited criteria may not be empty. Edited criteria
    count for the current description; a new description alone calls for a new compilation.
    """
    cleaned = with_computed(edits, "new_criteria", clean_criteria(F.col("new_criteria")))
    described = F.coalesce(clean(F.col("new_description")), F.lit(""))
    joined = profiles.join(cleaned.withColumn("edited", F.lit(True)), "profile_id", "left").withColumn(
        "problem",
        F.when(F.col("edited") & F.col("name").isin(*PRESET_NAMES), "preset")
        .when(F.size("new_criteria") == 0, "criteria cannot be empty"))
    accepted = F.coalesce(F.col("edited"), F.lit(False)) & F.col("problem").isNull()
    changed = accepted & F.col("new_description").isNotNull() & (described != F.col("description_text"))
    text = F.when(changed, described).otherwise(F.col("description_text"))
    with_criteria = accepted & F.col("new_criteria").isNotNull()
    return joined.select(
        "profile_id",
        F.when(accepted & F.col("new_name").isNotNull(),
               F.substring(F.coalesce(clean(F.col("new_name")), F.lit("")), 1, NAME_LENGTH))
        .otherwise(F.col("name")).alias("name"),
        text.alias("description_text"),
        F.when(with_criteria, description_hash(text))
        .when(~changed, F.col("description_hash")).alias("description_hash"),
        F.when(with_criteria, F.col("new_criteria")).otherwise(F.col("criteria")).alias("criteria"),
        "problem",
    )


def new_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles to add: name given, trimmed and not in use; the first request for a name counts.

    requests: request_id, name, description_text.
    """
    name = F.substring(clean(F.col("name")), 1, NAME_LENGTH)
    wanted = requests.select("request_id", name.alias("name"), F.coalesce(clean(F.col("description_text")), F.lit("")).alias("description_text"))
    first = (
        wanted.filter(F.col("name").isNotNull())
        .groupBy("name").agg(F.min_by(F.struct("request_id", "description_text"), "request_id").alias("r"))
        .select("name", "r.*")
    )
    return first.join(profiles.select("name"), "name", "left_anti").withColumn(
        "criteria", F.array().cast(CRITERIA))
