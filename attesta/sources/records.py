"""Public-record payloads: registration events and web-archive captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.urls import registrable_domain

# Registration events that are kept, and the names they are stored under.
REGISTRATION_EVENTS = {"registration": "registered", "expiration": "expires", "last changed": "last_changed"}

_EVENTS = "struct<events: array<struct<eventAction: string, eventDate: string>>>"
_INDEX = "array<array<string>>"
_AVAILABILITY = "struct<archived_snapshots: struct<closest: struct<available: boolean, url: string, timestamp: string>>>"


def registration_dates(payload: Column, as_of: Column) -> Column:
    """Struct of ok, the event dates (last event of a kind counts) and the age in calendar years."""
    events = F.from_json(payload, _EVENTS)["events"]

    def last_date(action: str) -> Column:
        same = F.filter(
            events,
            lambda e: (F.lower(e["eventAction"]) == action) & (F.coalesce(e["eventDate"], F.lit("")) != ""),
        )
        return F.substring(F.try_element_at(same, F.lit(-1))["eventDate"], 1, 10)

    dates = {name: last_date(action) for action, name in REGISTRATION_EVENTS.items()}
    year = F.substring(dates["registered"], 1, 4).try_cast("int")
    return F.struct(
        year.isNotNull().alias("ok"),
        *[value.alias(name) for name, value in dates.items()],
        (F.year(as_of) - year).alias("domain_age_years"),
    )


def _capture(stamp: Column, approximate: bool) -> Column:
    date = F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    return F.struct(
        date.alias("first_capture"),
        F.substring(stamp, 1, 4).try_cast("int").alias("first_capture_year"),
        F.lit(approximate).alias("approx"),
    )


def first_capture(index: Column, availability: Column) -> Column:
    """Earliest capture: the index (row 0 is its header) is exact and preferred over the nearest
    available snapshot, which is approximate. Null when neither has one."""
    exact = F.nullif(F.try_element_at(F.try_element_at(F.from_json(index, _INDEX), F.lit(2)), F.lit(1)), F.lit(""))
    closest = F.from_json(availability, _AVAILABILITY)["archived_snapshots"]["closest"]
    near = F.when(F.coalesce(closest["available"], F.lit(False)) & (F.length(closest["timestamp"]) >= 8),
                  closest["timestamp"])
    return F.coalesce(
        F.when(exact.isNotNull(), _capture(exact, False)), F.when(near.isNotNull(), _capture(near, True))
    )


def lookup_ok(as_of: Column) -> Column:
    """Whether a stored lookup (kind, payload, fallback) found what it asked for."""
    registered = registration_dates(F.col("payload"), as_of)["ok"]
    captured = first_capture(F.col("payload"), F.col("fallback")).isNotNull()
    return F.coalesce(F.when(F.col("kind") == "rdap", registered).otherwise(captured), F.lit(False))


def records_text(rdap: Column, wayback: Column) -> Column:
    """What the records say, for a request; null without any."""
    registered = F.when(F.coalesce(rdap["ok"], F.lit(False)), F.concat(F.lit("registered "), rdap["registered"]))
    captured = F.concat(F.lit("first captured "), wayback["first_capture"])
    return F.nullif(F.concat_ws("; ", registered, captured), F.lit(""))


def registration_source(domain: Column) -> Column:
    return F.concat(F.lit("https://rdap.org/domain/"), registrable_domain(domain))


def archive_source(domain: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/*/"), domain)


def with_records(companies: DataFrame, enrichments: DataFrame, as_of: Column) -> DataFrame:
    """Companies with ``rdap`` and ``wayback`` structs side by side, null where nothing is stored.

    enrichments: domain, kind, and the raw answers ``payload`` (registration events or archive
    index) and ``fallback`` (archive availability). One pass over them; (domain, kind) is its key.
    """
    of_kind = lambda kind, value: F.max_by(
        F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("fetched_at")))
    by_domain = enrichments.groupBy("domain").agg(
        of_kind("rdap", F.col("payload")).alias("events"),
        of_kind("wayback", F.col("payload")).alias("captures"),
        of_kind("wayback", F.col("fallback")).alias("nearest"),
    )
    return companies.join(by_domain, "domain", "left").select(
        *companies.columns,
        F.when(F.col("events").isNotNull(), registration_dates(F.col("events"), as_of)).alias("rdap"),
        first_capture(F.col("captures"), F.col("nearest")).alias("wayback"),
    )
