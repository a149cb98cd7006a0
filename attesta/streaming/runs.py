"""Structured Streaming jobs whose result equals the batch operator of the same meaning.

Upserts are streaming aggregations: ``max_by`` combines map-side, the state store keeps one row per
key, and every trigger appends only the rows that changed. With a life, keys are kept per span of
that length, and the watermark clears a span once nothing in it can be fresh. Imports keep the domains
met so far in the state store, so no trigger reads what earlier ones wrote. Log audits hold rows back
until the watermark has passed them, so a log may arrive out of order by a stated delay; rows later
than that go to a table of their own. A batch that is retried replaces its own output folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import imports as I
from attesta.operators import latest as L
from attesta.operators.asof import micros
from attesta.operators.cache import DAY_US, PAGE_DAYS, new_texts
from attesta.operators.traffic import COOLDOWN_US, MIN_GAP_US, breaker_windows, politeness_audit


def _batch_folder(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch}"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ---------------------------------------------------------------- upserts
def keep_newest(
    stream: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str, life_days: int | None = None
) -> StreamingQuery:
    """One row per key, the one with the largest ``order``: cached pages by address, record lookups
    by (domain, kind). Each trigger appends the rows that changed.

    With ``life_days`` the first column of ``order`` is the moment of a row, and a row is of no use that
    many days later. State is then kept by (key, span of that length) and cleared when the newest
    moment seen is a life past the span; rows that come in later than that are expired, and dropped.
    """
    payload = [c for c in stream.columns if c not in keys]
    spans = []
    if life_days is not None:
        stream, spans = stream.withWatermark(order[0], f"{life_days} days"), [F.window(order[0], f"{life_days} days")]
    newest = stream.groupBy(*keys, *spans).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("row"))

    def append(rows: DataFrame, batch: int) -> None:
        rows.select(*keys, "row.*").write.mode("overwrite").parquet(_batch_folder(folder, batch))

    return _start(newest, append, checkpoint, "update")


def latest_scans(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """The scan shown for each company and profile: done before failed, then the newest."""
    ended = stream.filter(F.col("status").isin("done", "error"))
    payload = [c for c in stream.columns if c not in L.SCAN_KEYS]
    best = ended.groupBy(*L.SCAN_KEYS).agg(F.max_by(F.struct(*payload), L.latest_order()).alias("row"))

    def append(rows: DataFrame, batch: int) -> None:
        rows.select(*L.SCAN_KEYS, "row.*").write.mode("overwrite").parquet(_batch_folder(folder, batch))

    return _start(best, append, checkpoint, "update")


def current(spark: SparkSession, folder: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The table an upsert stream stands for: of every key the row with the largest ``order``, or
    without one the last change."""
    rows = spark.read.parquet(folder)
    payload = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*(order or ["batch"]))).alias("row")).select(*keys, "row.*")


# ---------------------------------------------------------------- imports
def import_leads(stream: DataFrame, existing: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the companies that neither ``existing`` nor an earlier batch holds.

    The state store remembers every domain met and its first row, so a trigger reads its own rows and
    ``existing`` only. A domain is new if all its rows came with this trigger.
    """
    leads = I.normalized_leads(stream).filter(F.col("domain").isNotNull()).withColumn("arrived", F.current_timestamp())
    payload = [c for c in leads.columns if c not in ("domain", "row_pos", "arrived")]
    first = leads.groupBy("domain").agg(
        F.min_by(F.struct(*payload), "row_pos").alias("row"), F.min("arrived").alias("since"), F.max("arrived").alias("until"))

    def append(rows: DataFrame, batch: int) -> None:
        new = rows.filter(F.col("since") == F.col("until")).select("domain", "row.*")
        new.join(existing.select("domain"), "domain", "left_anti").write.mode("overwrite").parquet(_batch_folder(folder, batch))

    return _start(first, append, checkpoint, "update")


# ---------------------------------------------------------------- request logs
def audit_log(
    stream: DataFrame, keys: list[str], folder: str, checkpoint: str, audit: Callable[[DataFrame], DataFrame],
    expiry_us: int, carry_only: str = "true", delay_us: int = 0,
) -> StreamingQuery:
    """Run a batch ``audit`` over a log that arrives out of order by at most ``delay_us``.

    The watermark is the newest moment seen less the delay. Rows before it are audited, together with
    the last row of every key from the rows before them; rows from it on are held for the next batch
    (their findings as things stand are in ``open``). A row older than the watermark of an earlier
    batch comes too late to be put in order and goes to ``late``. Last rows older than ``expiry_us``,
    which no later row looks back to, are dropped. So what a batch reads is bounded by the keys of that
    time and the rows of the delay, however long the log is.
    """
    spark = stream.sparkSession
    us = micros(F.col("ts"))

    def append(rows: DataFrame, batch: int) -> None:
        def earlier(kind: str) -> DataFrame:
            if batch == 0:
                return spark.createDataFrame([], rows.schema)
            return spark.read.schema(rows.schema).parquet(_batch_folder(f"{folder}/{kind}", batch - 1))

        def write(df: DataFrame, kind: str) -> None:
            df.write.mode("overwrite").parquet(_batch_folder(f"{folder}/{kind}", batch))

        def findings(fresh: DataFrame, last: DataFrame) -> DataFrame:
            marked = fresh.withColumn("fresh", F.lit(True)).unionByName(last.withColumn("fresh", F.lit(False)))
            return audit(marked).filter("fresh").drop("fresh")

        seen = spark.read.parquet(_batch_folder(f"{folder}/clock", batch - 1)).first()["seen"] if batch > 0 else None
        newest = max((x for x in (seen, rows.agg(F.max(us)).first()[0]) if x is not None), default=None)
        settled, mark = (F.lit(None if x is None else x - delay_us).cast("long") for x in (seen, newest))
        too_late = F.coalesce(us < settled, F.lit(False))
        waiting = rows.filter(~too_late).unionByName(earlier("held"))
        ready, last = waiting.filter(us < mark), earlier("last")
        payload = [c for c in rows.columns if c not in keys]
        kept = ready.unionByName(last).filter(carry_only).filter(us >= mark - expiry_us).groupBy(*keys).agg(
            F.max_by(F.struct(*payload), F.struct(us, "id")).alias("row")).select(*keys, "row.*").select(*rows.columns)
        write(rows.filter(too_late), "late")
        write(findings(ready, last), "found")
        write(kept, "last")
        write(waiting.filter(F.coalesce(us >= mark, F.lit(True))), "held")
        here = lambda kind: spark.read.schema(rows.schema).parquet(_batch_folder(f"{folder}/{kind}", batch))
        write(findings(here("held"), here("last")), "open")
        write(spark.range(1).select(F.lit(newest).cast("long").alias("seen")), "clock")

    return _start(stream, append, checkpoint, "append")


def politeness(
    stream: DataFrame, folder: str, checkpoint: str, gap_us: int = MIN_GAP_US, delay_us: int = 0
) -> StreamingQuery:
    """Requests too close to the one before, per host. stream: host, ts, id."""
    return audit_log(
        stream, ["host"], folder, checkpoint, lambda rows: politeness_audit(rows, gap_us), gap_us, delay_us=delay_us)


def breaker(
    stream: DataFrame, keys: list[str], folder: str, checkpoint: str, cooldown_us: int = COOLDOWN_US, delay_us: int = 0
) -> StreamingQuery:
    """Availability of each upstream at each response. stream: keys, ts, id, failed."""
    return audit_log(
        stream, keys, folder, checkpoint, lambda rows: breaker_windows(rows, keys, cooldown_us), cooldown_us,
        carry_only="failed", delay_us=delay_us)


def new_page_texts(
    stream: DataFrame, folder: str, checkpoint: str, days: int = PAGE_DAYS, delay_us: int = 0
) -> StreamingQuery:
    """Page fetches whose text the address had at no time in the days before, as ``new_texts``.
    stream: url, content_hash, ts, id."""
    return audit_log(
        stream, ["url", "content_hash"], folder, checkpoint,
        lambda rows: new_texts(rows, days), days * DAY_US, delay_us=delay_us)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """Findings on all rows but late ones; those on rows still held are as things stand."""
    newest = spark.read.parquet(f"{folder}/clock").agg(F.max("batch")).first()[0]
    settled = spark.read.parquet(f"{folder}/found").drop("batch")
    return settled.unionByName(spark.read.schema(settled.schema).parquet(_batch_folder(f"{folder}/open", newest)))


def late(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came after the watermark had passed them."""
    return spark.read.parquet(f"{folder}/late").drop("batch")
