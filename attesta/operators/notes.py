"""Outreach notes: who gets one, what may be cited, and whether a draft keeps to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import normalize, normalize_plain
from attesta.operators.facts import is_grounded

MAX_NOTE_FACTS = 12
# Figures that must come from the cited facts, and the reference marker.
FIGURE = r"(?iU)\b(\d{2,}|million|billion|thousand|%)"
MARKER = r"\[F(\d+)\]"
SENTENCES = (3, 5)


def note_gate(scans: DataFrame, verdicts: DataFrame, facts: DataFrame) -> DataFrame:
    """Per scan, ``gate``: skipped, red_flag or write.

    scans: scan_id, no_evidence_reason; verdicts: scan_id, polarity, verdict; facts: scan_id, grounding.
    """
    flags = verdicts.groupBy("scan_id").agg(
        F.bool_or((F.col("polarity") == "negative") & (F.col("verdict") == "met")).alias("flagged"))
    grounded = facts.groupBy("scan_id").agg(F.count_if(is_grounded(F.col("grounding"))).alias("n_grounded"))
    gate = (
        F.when(F.col("no_evidence_reason").isNotNull(), "skipped")
        .when(F.coalesce("flagged", F.lit(False)), "red_flag")
        .when(F.coalesce("n_grounded", F.lit(0)) < 2, "skipped")
        .otherwise("write")
    )
    return scans.select("scan_id", "no_evidence_reason").join(flags, "scan_id", "left").join(
        grounded, "scan_id", "left").select("scan_id", gate.alias("gate"))


def facts_to_cite(facts: DataFrame, cited: DataFrame, limit: int = MAX_NOTE_FACTS) -> DataFrame:
    """Grounded facts offered to the note writer: those a verdict cites first, then by number.

    cited: scan_id, id. ``note_pos`` counts from 1.
    """
    marked = facts.filter(is_grounded(F.col("grounding"))).join(
        cited.select("scan_id", "id").distinct().withColumn("cited", F.lit(True)), ["scan_id", "id"], "left")
    order = W.partitionBy("scan_id").orderBy(F.col("cited").isNull(), "id")
    return marked.withColumn("note_pos", F.row_number().over(order)).filter(F.col("note_pos") <= limit)


def offered_per_scan(to_cite: DataFrame) -> DataFrame:
    """scan_id, offered: at most twelve (id, fact, evidence_quote) in the order they were offered."""
    row = F.struct("note_pos", "id", "fact", "evidence_quote")
    return to_cite.groupBy("scan_id").agg(F.array_sort(F.collect_list(row)).alias("offered"))


def _cited_text(offered: Column, ids: Column) -> Column:
    return F.array_join(
        F.transform(
            F.filter(offered, lambda f: F.array_contains(ids, f["id"])),
            lambda f: F.concat_ws(" ", f["fact"], f["evidence_quote"])),
        " ")


def note_problem(drafts: DataFrame) -> DataFrame:
    """Drafts (note, fact_ids, offered, …) with ``problem``, the first rule broken, null when none.

    Rules in order: exactly two different ids; both offered; figures occur in the cited facts;
    markers name exactly those ids; three to five sentences; no other brackets.
    """
    body = F.regexp_replace("note", MARKER, "")
    prepared = drafts.withColumns({
        "_ids": F.array_distinct("fact_ids"),
        "_body": body,
        "_markers": F.array_distinct(F.transform(
            F.regexp_extract_all("note", F.lit(MARKER), F.lit(1)), lambda m: m.cast("int"))),
        "_figures": F.transform(F.regexp_extract_all(body, F.lit(FIGURE), F.lit(1)), lambda x: x),
    })
    prepared = prepared.withColumn("_cited", F.split(normalize(_cited_text(F.col("offered"), F.col("_ids"))), " "))
    allowed = F.transform("offered", lambda f: f["id"])
    foreign = F.filter(
        "_figures", lambda x: (x != "%") & ~F.array_contains(F.col("_cited"), normalize_plain(x)))
    n_sentences = F.size(F.filter(F.split("_body", "[.!?]"), lambda s: F.regexp_replace(s, r"[\s\p{Z}]+", "") != ""))
    problem = (
        F.when(F.size("_ids") != 2, "fact_ids")
        .when(F.size(F.array_except("_ids", allowed)) > 0, "not_offered")
        .when(F.size(foreign) > 0, "figures")
        .when((F.size(F.array_except("_ids", "_markers")) > 0) | (F.size(F.array_except("_markers", "_ids")) > 0), "markers")
        .when((n_sentences < SENTENCES[0]) | (n_sentences > SENTENCES[1]), "sentences")
        .when(F.col("_body").rlike(r"[\[\]]"), "brackets")
    )
    return prepared.withColumn("problem", problem).drop("_ids", "_body", "_markers", "_figures", "_cited")


# What a writer is told about a refused draft.
FEEDBACK = {
    "empty": "The last answer was empty. Return the note and its fact ids.",
    "fact_ids": "The last answer must cite exactly two different fact ids.",
    "not_offered": "The last answer cites ids that are not in the list.",
    "figures": "The last answer states figures that the two cited facts do not contain.",
    "markers": "The last answer must mark both cited facts, and no others, as [F<id>].",
    "sentences": "The last answer must have four sentences.",
    "brackets": "The last answer contains placeholders in brackets.",
}


def feedback(problem: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in FEEDBACK.items() for x in item]), problem)
