"""Model answers: parsing, limits, error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.schemas import CRITERIA_ANSWER, FACT_ANSWER, JUDGMENT_ANSWER, NOTE_ANSWER, VERDICTS

# Limits of the answer formats.
CRITERIA_COUNT = (4, 8)
MAX_FACTS = 20
# Error texts that mean "try again later".
TRANSIENT = r"429|RESOURCE_EXHAUSTED|QUOTA|RATE LIMIT|OVERLOADED|503"
# Errors are stored as "Type: text"; lost connections and time-outs are told by their type.
TRANSIENT_TYPE = r"(?i)^[\w.]*(timeout|timedout|connection|connect|ratelimit)[a-z]*(error|exception)?:"

SCHEMAS = {"criteria": CRITERIA_ANSWER, "facts": FACT_ANSWER, "judgments": JUDGMENT_ANSWER, "note": NOTE_ANSWER}


def valid_verdict(verdict: Column) -> Column:
    return verdict.isin(*VERDICTS)


def _any(rows: Column, bad) -> Column:
    return F.exists(rows, lambda r: F.coalesce(bad(r), F.lit(True)))


def answer_problem(kind: str, parsed: Column) -> Column:
    """The first limit an answer breaks, null when it keeps to its format."""
    if kind == "criteria":
        rows = parsed["criteria"]
        weight = lambda r: r["weight"].try_cast("int")
        return (
            F.when(rows.isNull(), "malformed")
            .when(~F.size(rows).between(*CRITERIA_COUNT), "count")
            .when(_any(rows, lambda r: ~weight(r).between(1, 5)), "weight")
            .when(_any(rows, lambda r: ~r["polarity"].isin("positive", "negative")), "polarity")
        )
    if kind == "facts":
        rows = parsed["facts"]
        return (
            F.when(rows.isNull(), "malformed").when(F.size(rows) > MAX_FACTS, "count")
            .when(_any(rows, lambda r: ~r["confidence"].between(0.0, 1.0)), "confidence")
        )
    if kind == "judgments":
        rows = parsed["judgments"]
        return F.when(rows.isNull(), "malformed").when(_any(rows, lambda r: ~valid_verdict(r["verdict"])), "verdict")
    if kind == "note":
        return F.when(parsed["note"].isNull() | parsed["fact_ids"].isNull(), "malformed")
    raise ValueError(f"no answer format {kind!r}")


def parse_answers(answers: DataFrame, kind: str, column: str = "answer") -> DataFrame:
    """Answers with ``parsed`` (null when refused) and ``problem`` (null when accepted)."""
    read = answers.withColumn("_read", F.from_json(column, SCHEMAS[kind])).withColumn(
        "problem", answer_problem(kind, F.col("_read")))
    return read.withColumn("parsed", F.when(F.col("problem").isNull(), F.col("_read"))).drop("_read")


def error_class(error: Column, code: Column | None = None) -> Column:
    """transient (retry the scan later) or genuine; null without an error."""
    transient = F.upper(error).rlike(TRANSIENT) | error.rlike(TRANSIENT_TYPE)
    if code is not None:
        transient = F.coalesce(code.isin(429, 503), F.lit(False)) | transient
    return F.when(error.isNotNull(), F.when(transient, "transient").otherwise("genuine"))


def scan_status(error: Column) -> tuple[Column, Column]:
    """Status and stored error text of a scan; what was completed before the error is kept."""
    return F.when(error.isNull(), "done").otherwise("error"), F.substring(error, 1, 500)
