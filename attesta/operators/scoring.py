"""Criteria grid, fit score, coverage and penalties.

Everything that depends on a profile alone (total weight, penalty share of each criterion) is
worked out once per criterion. A scan then only needs sums over its own results, which Spark
computes with partial aggregation on the partitioning the join has already made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numbers import round1
from attesta.functions.text import content_hash
from attesta.schemas import DECISIVE
from attesta.session import with_computed

SCORING_VERSION = 2  # part of the fingerprint: raising it retires stored scans


def last_result_per_criterion(
    results: DataFrame, order: list[str], payload: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per (scan, criterion): the last by ``order``. Copies collapse before the shuffle.

    Name the ``payload`` columns needed; fields inside the kept row cannot be pruned later.
    """
    if payload is None:
        payload = tuple(c for c in results.columns if c not in ("scan_id", "criterion_key", *order))
    return (
        results.groupBy("scan_id", "criterion_key")
        .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("row"))
        .select("scan_id", "criterion_key", "row.*")
    )


def criterion_rows(profiles: DataFrame) -> DataFrame:
    """One row per profile and criterion with its weight, polarity and penalty share."""
    negative = F.coalesce(F.col("c.polarity") == "negative", F.lit(False))
    weight = F.coalesce(F.nullif(F.col("c.weight"), F.lit(0)), F.lit(1))
    exploded = profile_totals(profiles, "criteria").select(
        "profile_id", "total_weight", "positives", F.posexplode("criteria").alias("pos", "c")
    )
    share = round1(F.try_divide(F.lit(100.0) * F.col("weight"), F.col("total_weight")))
    return exploded.select(
        "profile_id", "total_weight", "positives", "pos",
        F.col("c.key").alias("criterion_key"),
        F.coalesce("c.label", "c.key").alias("label"),
        weight.alias("weight"),
        F.when(negative, F.lit("negative")).otherwise(F.lit("positive")).alias("polarity"),
    ).withColumn("share", F.when(F.col("total_weight") > 0, share).otherwise(F.lit(100.0)))


def profile_totals(profiles: DataFrame, *keep: str) -> DataFrame:
    """Positive weight and number of positive criteria of each profile."""
    positive = F.filter("criteria", lambda c: ~F.coalesce(c["polarity"] == "negative", F.lit(False)))
    weight = F.aggregate(
        positive, F.lit(0), lambda total, c: total + F.coalesce(F.nullif(c["weight"], F.lit(0)), F.lit(1))
    )
    return profiles.select(
        "profile_id", weight.alias("total_weight"), F.size(positive).alias("positives"), *keep
    )


def with_criteria(scans: DataFrame, profiles: DataFrame, results: DataFrame) -> DataFrame:
    """Scans with their results and, where the profile still has the criterion, its definition."""
    rows = criterion_rows(profiles).drop("total_weight", "positives")
    return (
        scans.join(results, "scan_id", "left")
        .join(rows, ["profile_id", "criterion_key"], "left")
        .join(profile_totals(profiles), "profile_id")
    )


def _positive() -> Column:
    return F.col("polarity") == "positive"


def is_met() -> Column:
    return F.col("verdict") == "met"


def is_red_flag() -> Column:
    return (F.col("polarity") == "negative") & is_met()


def score_scans(
    scans: DataFrame, profiles: DataFrame, results: DataFrame, extra: tuple[Column, ...] = ()
) -> DataFrame:
    """Scans with their weights, penalty, score and coverage.

    scans: scan_id, profile_id, ...; profiles: profile_id, criteria; results: one row per
    (scan_id, criterion_key) with at least ``verdict``. ``extra`` are further aggregates over the
    rows of ``with_criteria``, computed in the same pass.
    """
    known = _positive() & F.col("verdict").isin(*DECISIVE)
    total = lambda flag, value: F.sum(F.when(flag, value).otherwise(F.lit(0)))
    # Penalties are doubles: gathered by place and added up in criteria order, the sum is exact.
    flags = F.array_sort(F.collect_list(F.when(is_red_flag(), F.struct("pos", "share"))))
    summed = (
        with_criteria(scans, profiles, results)
        .groupBy(*scans.columns, "total_weight", "positives")
        .agg(
            total(known & is_met(), F.col("weight")).cast("int").alias("earned_weight"),
            total(known, F.col("weight")).cast("int").alias("known_weight"),
            total(known, F.lit(1)).cast("int").alias("n_known"),
            flags.alias("_flags"),
            *extra,
        )
    )
    base = F.try_divide(F.lit(100.0) * F.col("earned_weight"), F.col("known_weight"))
    penalty = F.aggregate("_flags", F.lit(0.0), lambda total, flag: total + flag["share"])
    raw = F.struct(
        F.greatest(F.lit(0.0), base - penalty).alias("score"),
        F.try_divide(F.lit(100.0) * F.col("n_known"), F.col("positives")).alias("coverage"),
        penalty.alias("penalty"),
    )
    # computed apart, because rounding refers to its argument many times
    return with_computed(summed, "raw", raw).withColumns(
        {
            "score": F.when(F.col("known_weight") > 0, round1(F.col("raw.score"))),
            "coverage": F.when(F.col("positives") > 0, round1(F.col("raw.coverage"))).otherwise(F.lit(0.0)),
            "penalty": round1(F.col("raw.penalty")),
        }
    ).drop("raw", "_flags")


def score_breakdown(scans: DataFrame, profiles: DataFrame, results: DataFrame) -> DataFrame:
    """Every criterion of every scan, unknown where there is no decisive result, with the
    whole-number figures shown to people."""
    verdict = F.when(F.col("verdict").isin(*DECISIVE), F.col("verdict")).otherwise(F.lit("unknown"))
    counted = _positive() & (F.col("verdict") != "unknown")
    whole = lambda x: F.floor(x + F.lit(0.5)).cast("int")
    grid = (
        scans.select("scan_id", "profile_id")
        .join(criterion_rows(profiles), "profile_id")
        .join(results.select("scan_id", "criterion_key", "verdict"), ["scan_id", "criterion_key"], "left")
        .withColumn("verdict", verdict)
    )
    return grid.select(
        "scan_id", "pos", F.col("criterion_key").alias("key"), "label", "weight", "polarity", "verdict",
        F.when(counted & is_met(), F.col("weight")).otherwise(F.lit(0)).alias("earned"),
        counted.alias("counted"),
        is_red_flag().alias("red_flag"),
        F.when(is_red_flag(), F.col("share")).otherwise(F.lit(0.0)).alias("penalty"),
        F.when(counted & is_met(), F.lit(100)).otherwise(F.lit(0)).alias("earned_pct"),
        F.when(
            is_red_flag() & (F.col("total_weight") > 0),
            whole(F.try_divide(F.lit(100.0) * F.col("weight"), F.col("total_weight"))),
        ).otherwise(F.lit(0)).alias("penalty_points"),
    )


def criteria_hash(criteria: Column) -> Column:
    """Fingerprint of what was judged: key, weight, test and polarity in order, and the formula
    version. Labels do not take part."""
    judged = F.transform(
        criteria,
        lambda c: F.struct(
            c["key"].alias("key"), c["polarity"].alias("polarity"), c["test"].alias("test"),
            c["weight"].alias("weight"),
        ),
    )
    return content_hash(F.to_json(F.struct(judged.alias("criteria"), F.lit(SCORING_VERSION).alias("v"))))
