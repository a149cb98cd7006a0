"""As-of lookup: the newest event at or before each request, within a tolerance.

A window over all rows of a key would put a hot key into one task. Time is cut into buckets
instead: inside a bucket a window per (key, bucket) answers requests directly, and one carry row
per bucket brings in the newest event of the preceding buckets. Carries are computed from one
summary row per (key, bucket), again cut into blocks of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_within(
    requests: DataFrame,
    events: DataFrame,
    keys: list[str],
    tolerance_us: int,
    bucket_us: int,
    strict: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """``requests`` plus ``event_us`` and ``event_id`` of the newest matching event, or nulls.

    requests: keys, at_us, and any other columns; events: keys, event_us, event_id (the larger id
    wins a tie). ``strict`` looks only before ``at_us``; ``inclusive`` counts an event exactly
    ``tolerance_us`` old.
    """
    columns = requests.columns
    # one event per key and instant
    events = events.groupBy(*keys, "event_us").agg(F.max("event_id").alias("event_id"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(bucket_us)).cast("bigint")
    event = F.struct("event_us", "event_id")

    asked = requests.select(*keys, F.struct(*columns).alias("request"), F.col("at_us").alias("us"),
                            bucket("at_us").alias("bucket"))
    happened = events.select(*keys, event.alias("event"), F.col("event_us").alias("us"),
                             bucket("event_us").alias("bucket"))

    carries = _carries(asked, happened, keys, tolerance_us, bucket_us)
    no_event = F.lit(None).cast(happened.schema["event"].dataType)
    no_request = F.lit(None).cast(asked.schema["request"].dataType)
    # order at one instant: strict requests come before events, others after them
    request_rank, event_rank = (0, 1) if strict else (1, 0)
    lined_up = (
        happened.select(*keys, "bucket", "us", F.lit(event_rank).alias("rank"), "event", no_request.alias("request"))
        .unionByName(carries.select(*keys, "bucket", F.lit(None).cast("bigint").alias("us"), F.lit(0).alias("rank"),
                                    "event", no_request.alias("request")))
        .unionByName(asked.select(*keys, "bucket", "us", F.lit(request_rank).alias("rank"), no_event.alias("event"),
                                  "request"))
    )
    so_far = W.partitionBy(*keys, "bucket").orderBy(F.col("us").asc_nulls_first(), "rank").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    found = lined_up.withColumn("hit", F.last("event", ignorenulls=True).over(so_far)).filter(
        F.col("request").isNotNull())
    age = F.col("us") - F.col("hit.event_us")
    near = age <= tolerance_us if inclusive else age < tolerance_us
    return found.select(
        *[F.col(f"request.{c}").alias(c) for c in columns],
        F.when(near, F.col("hit.event_us")).alias("event_us"),
        F.when(near, F.col("hit.event_id")).alias("event_id"),
    )


def _carries(asked: DataFrame, happened: DataFrame, keys: list[str], tolerance_us: int, bucket_us: int) -> DataFrame:
    """For each (key, bucket) with requests, the newest event of earlier buckets in reach."""
    block = max(1, -(-tolerance_us // bucket_us)) + 1  # buckets an event can reach
    last = happened.groupBy(*keys, "bucket").agg(F.max("event").alias("event")).withColumn("asked", F.lit(False))
    wanted = asked.select(*keys, "bucket").distinct().withColumn("asked", F.lit(True))
    home = F.floor(F.col("bucket") / F.lit(block)).cast("bigint")
    # an event serves its own block and the next one
    spread = last.withColumn("block", F.explode(F.array(home, home + 1)))
    summary = spread.unionByName(
        wanted.withColumn("block", home).withColumn("event", F.lit(None).cast(last.schema["event"].dataType))
    )
    before = W.partitionBy(*keys, "block").orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    return (
        summary.withColumn("carried", F.last("event", ignorenulls=True).over(before))
        .filter(F.col("asked") & F.col("carried").isNotNull())
        .select(*keys, "bucket", F.col("carried").alias("event"))
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
