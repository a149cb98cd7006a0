"""Labels and compact texts shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_EVIDENCE_BELOW = 40  # coverage in percent

# Display texts.
VERDICT_LABELS = {"met": "Met", "not_met": "Not met", "unknown": "Unknown"}
AVOID_VERDICT_LABELS = {"met": "Red flag", "not_met": "Not present", "unknown": "Unknown"}
GROUNDING_LABELS = {
    "exact": "Verified · exact match",
    "fuzzy": "Verified · fuzzy match",
    "record": "Public record",
    "none": "Unverified",
}
THIN_TEXT = (
    "This site returned almost no readable text (likely rendered in the browser). Nothing was scored."
)
BLOCKED_TEXT = (
    "The site could not be fetched (blocked, offline, or disallowed by robots.txt). Nothing was scored."
)
UNVERIFIED_TEXT = (
    "Scanned, but no criterion could be verified from the public website — nothing was scored."
)
NOTE_UNVERIFIED_TEXT = (
    "No note — the draft referenced something not in the verified facts, so it was discarded"
)
NOTE_SKIPPED_TEXT = "No note — fewer than two verified facts"


def lookup(labels: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def rounded(value: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(value + F.lit(0.5))


def location(city: Column, state: Column) -> Column:
    parts = F.filter(F.array(city, state), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.when(F.size(parts) == 0, F.lit("Unknown")).otherwise(F.array_join(parts, ", "))


def hostname(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).when(host == "", url).otherwise(
        F.regexp_replace(host, r"^www\.", "")
    )


def href(domain_or_url: Column) -> Column:
    return F.when(domain_or_url.rlike("(?i)^https?://"), domain_or_url).otherwise(
        F.concat(F.lit("https://"), domain_or_url)
    )


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(rounded(value).cast("string"), F.lit("%")), F.lit("—"))


def relative_time(moment: Column, as_of: Column) -> Column:
    """How long before ``as_of`` something happened, in the largest whole unit."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    seconds = F.greatest(F.lit(0), rounded(micros / F.lit(1e6)))
    unit = lambda size, mark: F.concat(
        F.floor(seconds / size).cast("string"), F.lit(mark + " ago"))
    return (
        F.when(moment.isNull(), F.lit("—"))
        .when(seconds < 45, F.lit("just now"))
        .when(seconds < 60, F.lit("1m ago"))
        .when(seconds < 3600, unit(60, "m"))
        .when(seconds < 86400, unit(3600, "h"))
        .when(seconds < 2592000, unit(86400, "d"))
        .when(seconds < 31536000, unit(2592000, "mo"))
        .otherwise(unit(31536000, "y"))
    )


def rank_value(score: Column, coverage: Column) -> Column:
    """Score weighted by how much could be verified; -1 when there is no score."""
    return F.coalesce(score * F.coalesce(coverage, F.lit(0.0)) / 100, F.lit(-1.0))


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= 70, F.lit("high"))
        .when(score >= 40, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def score_badge(score: Column, status: Column) -> Column:
    return (
        F.when(status == "error", F.lit("Error"))
        .when(score.isNotNull(), rounded(score).cast("string"))
        .when(status == "done", F.lit("No evidence"))
        .otherwise(F.lit("Not scanned"))
    )


def badge_hint(score: Column, status: Column, reason: Column, error: Column) -> Column:
    return (
        F.when(status == "error", F.coalesce(error, F.lit("Scan failed")))
        .when(score.isNotNull() | ~F.coalesce(status == "done", F.lit(False)), F.lit(None).cast("string"))
        .when(reason == "content_too_thin", F.lit(THIN_TEXT))
        .when(reason == "site_unreadable", F.lit(BLOCKED_TEXT))
        .otherwise(F.lit(UNVERIFIED_TEXT))
    )


def low_evidence(score: Column, status: Column, coverage: Column) -> Column:
    shown = score.isNotNull() & ~F.coalesce(status == "error", F.lit(False))
    return shown & F.coalesce(coverage < LOW_EVIDENCE_BELOW, F.lit(False))


def verdict_label(verdict: Column, polarity: Column) -> Column:
    return F.when(polarity == "negative", lookup(AVOID_VERDICT_LABELS, verdict)).otherwise(
        lookup(VERDICT_LABELS, verdict)
    )


def grounding_label(grounding: Column) -> Column:
    return lookup(GROUNDING_LABELS, grounding)


def note_text(note: Column, note_status: Column, red_flags: Column) -> Column:
    flags = F.when(F.size(red_flags) > 0, F.array_join(red_flags, ", ")).otherwise(
        F.lit("avoid criterion present"))
    return (
        F.when(F.coalesce(note, F.lit("")) != "", note)
        .when(note_status == "red_flag", F.concat(F.lit("No outreach suggested: red flag ("), flags, F.lit(")")))
        .when(note_status == "unverified", F.lit(NOTE_UNVERIFIED_TEXT))
        .otherwise(F.lit(NOTE_SKIPPED_TEXT))
    )
