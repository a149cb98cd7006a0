"""Request-log audits: politeness gaps and the archive's circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.operators.asof import latest_within, micros

MIN_GAP_US = 1_000_000
COOLDOWN_US = 600_000_000


def is_failure(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def breaker_windows(
    responses: DataFrame, keys: list[str], cooldown_us: int = COOLDOWN_US, bucket_us: int = 60_000_000
) -> DataFrame:
    """Responses with ``available``: no failure of the same upstream in the cooldown before.

    responses: keys, ts, failed, id, …
    """
    timed = responses.withColumn("at_us", micros(F.col("ts")))
    failures = timed.filter("failed").select(*keys, F.col("at_us").alias("event_us"), F.col("id").alias("event_id"))
    looked_up = latest_within(
        timed, failures, keys, tolerance_us=cooldown_us, bucket_us=bucket_us, strict=True, inclusive=False)
    return looked_up.withColumn("available", F.col("event_us").isNull()).drop("at_us", "event_id").withColumnRenamed(
        "event_us", "tripped_us")


def politeness_audit(requests: DataFrame, gap_us: int = MIN_GAP_US) -> DataFrame:
    """Requests that came less than ``gap_us`` after the previous one to the same host.

    requests: host, ts, id. The previous request lies in the same or the preceding gap-long slot,
    so rows are grouped by (host, slot) and a busy host spreads over its slots.
    """
    timed = requests.withColumn("us", micros(F.col("ts"))).withColumn(
        "slot", F.floor(F.col("us") / F.lit(gap_us)).cast("bigint"))
    last_in_slot = timed.groupBy("host", "slot").agg(F.max("us").alias("before_us")).withColumn(
        "slot", F.col("slot") + 1)
    in_order = W.partitionBy("host", "slot").orderBy("us", "id")
    gap = F.col("us") - F.coalesce("previous_us", "before_us")
    return (
        timed.withColumn("previous_us", F.lag("us").over(in_order))
        .join(last_in_slot, ["host", "slot"], "left")
        .withColumn("gap_us", gap)
        .filter(F.col("gap_us") < gap_us)
        .drop("us", "slot", "previous_us", "before_us")
    )
