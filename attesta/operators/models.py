"""Model calls as pluggable batch functions, with deterministic defaults.

A model is a function from a pandas Series of request texts to a Series of JSON answers, asked one
request at a time inside ``mapInPandas``, a bounded number of them under way in each task. Without a
model the defaults below answer by rule, in the JVM.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.answers import TRANSIENT, TRANSIENT_TYPE, parse_answers
from attesta.operators.criteria import clean_criteria
from attesta.operators.notes import feedback, note_problem
from attesta.session import new_folder, stage

Model = Callable[[pd.Series], pd.Series]

# Our own rules for the defaults: words in a criterion, and the fact category that settles it.
CRITERION_WORDS = (
    ("family|owner|founder", "ownership_leadership"),
    ("year|established|founded|since", "founding_history"),
    ("franchise|equity|group|subsidiary|brand|corporate", "affiliations"),
    ("hiring|career|jobs", "hiring"),
    ("team|employee|people", "team_size"),
    ("location|local|regional|area", "locations_service_area"),
    ("online|technology|software|booking", "services_tech"),
    ("award|certif", "certifications_awards"),
    ("domain|web presence|archive", "domain_record"),
)
# Phrases of a description, and the criterion each calls for.
DESCRIPTION_WORDS = (
    ("family|owner-operated|founder", "owner_operated", "Owner operated", 5, "Is the owner or founder involved?", "positive"),
    ("years|established", "in_business_20_years", "20+ years in business", 4, "Founded over 20 years ago?", "positive"),
    ("small team|people|employees", "small_team", "Small team", 3, "Is the team small?", "positive"),
    ("local|regional", "local_market", "Local market", 2, "Does it serve a local area?", "positive"),
    ("hiring|open roles", "active_hiring", "Active hiring", 4, "Are there open jobs?", "positive"),
    ("multiple locations|expansion", "several_locations", "Several locations", 3, "Are there several locations?", "positive"),
    ("online booking|web stack|website", "digital_presence", "Digital presence", 2, "Is there online booking or technology?", "positive"),
    ("decision-maker", "named_decision_maker", "Named decision-maker", 3, "Is an owner or manager named?", "positive"),
    ("certification|award", "certified_or_awarded", "Certified or awarded", 1, "Are certifications or awards stated?", "positive"),
    ("franchise|private-equity|larger group", "franchise_or_group", "Franchise or group", 4, "Is it a franchise or part of a group?", "negative"),
)


#: Requests to a model under way at a time in a task, attempts at one, and seconds before the second attempt.
IN_FLIGHT, TRIES, WAIT_S = 2, 3, 0.5


def _passes(error: Exception) -> bool:
    """Whether another attempt may help: rate limits, time limits and refused connections."""
    said = f"{type(error).__name__}: {error}"
    return bool(re.search(TRANSIENT, said.upper()) or re.search(TRANSIENT_TYPE, said))


def call_model(
    requests: DataFrame, model: Model, request: str = "request", calls: int | None = None,
    in_flight: int = IN_FLIGHT, tries: int = TRIES, wait_s: float = WAIT_S,
) -> DataFrame:
    """Requests with ``answer`` and ``error``, each with an outcome of its own.

    A task keeps ``in_flight`` requests under way, in a queue that is refilled as the first is answered;
    with ``calls`` there are that many tasks, so calls * in_flight bounds the requests at a time. An error
    that may pass is met with up to ``tries`` attempts, with twice the wait before each. What then remains
    is the error of that one request.
    """
    rows = requests.repartition(calls) if calls else requests
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def ask(text: str) -> tuple[str | None, str | None]:
        for attempt in range(tries):
            try:
                found = model(pd.Series([text], dtype=object)).iloc[0]
                return (None, None) if found is None or found != found else (str(found), None)
            except Exception as e:  # noqa: BLE001 - the error is data: it decides the scan's status
                error = e
                if not _passes(e):
                    break
                if attempt + 1 < tries:
                    time.sleep(wait_s * 2**attempt)
        return None, f"{type(error).__name__}: {error}"[:500]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                waiting, outcomes = deque(), []
                for text in batch[request]:
                    waiting.append(pool.submit(ask, text))
                    if len(waiting) >= in_flight:
                        outcomes.append(waiting.popleft().result())
                outcomes += [w.result() for w in waiting]
                answers, errors = zip(*outcomes) if outcomes else ((), ())
                yield batch.assign(answer=pd.Series(answers, batch.index, dtype=object), error=pd.Series(errors, batch.index, dtype=object))

    return rows.mapInPandas(answer, schema)


def call_new(requests: DataFrame, model: Model, known: DataFrame | None = None, calls: int | None = None) -> DataFrame:
    """Requests with ``request_hash``, ``answer`` and ``error``; what ``known`` (request_hash, answer) has
    answered word for word before is not asked again."""
    hashed = requests.withColumn("request_hash", F.sha2("request", 256))
    if known is None:
        return call_model(hashed, model, calls=calls)
    once = known.groupBy("request_hash").agg(F.min("answer").alias("answer"))
    found = hashed.join(once, "request_hash").withColumn("error", F.lit(None).cast("string"))
    return call_model(hashed.join(once, "request_hash", "left_anti"), model, calls=calls).unionByName(found)


# ---------------------------------------------------------------- criteria from a description
def _ruled_criteria(description: Column) -> Column:
    found = [
        F.when(
            F.lower(description).rlike(words),
            F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(str(weight)).alias("weight"),
                     F.lit(test).alias("test"), F.lit(polarity).alias("polarity")))
        for words, key, label, weight, test, polarity in DESCRIPTION_WORDS
    ]
    return clean_criteria(F.array_compact(F.array(*found)))


def compile_criteria(profiles: DataFrame, model: Model | None = None, folder: str | None = None, calls: int | None = None) -> DataFrame:
    """Profiles (…, description_text) with new ``criteria``.

    A model's answers are stored under ``folder`` (a new shared one by default), so that no profile is
    asked about twice; criteria are null where the answer failed or was refused, and ``criteria_error``
    says why.
    """
    kept = profiles.drop("criteria")
    if model is None:
        return kept.withColumn("criteria", _ruled_criteria(F.col("description_text")))
    called = stage(call_model(kept, model, "description_text", calls), f"{folder or new_folder(profiles.sparkSession, 'criteria')}/answers")
    answered = parse_answers(called, "criteria").withColumn("criteria_error", F.coalesce("error", F.col("problem").cast("string")))
    return answered.withColumn("criteria", clean_criteria(F.col("parsed.criteria"))).drop("parsed", "problem", "answer", "error")


# ---------------------------------------------------------------- verdicts
def ruled_judgments(scans: DataFrame, criteria: DataFrame, offered: DataFrame) -> DataFrame:
    """A criterion is met when a fact of the category its words point to is offered, which is cited.

    scans: scan_id, profile_id; criteria: profile_id, criterion_key, pos, label, test.
    """
    text = F.lower(F.concat_ws(" ", "criterion_key", "label", "test"))
    rules = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(c).alias("category")) for w, c in CRITERION_WORDS])
    pointed = criteria.select(
        "profile_id", "criterion_key", "pos", F.explode(F.filter(rules, lambda r: F.rlike(text, r["words"]))).alias("r")
    ).select("profile_id", "criterion_key", "pos", "r.category")
    first = offered.groupBy("scan_id", "category").agg(F.min("id").alias("id"))
    hits = scans.select("scan_id", "profile_id").join(first, "scan_id").join(pointed, ["profile_id", "category"])
    return hits.groupBy("scan_id", "criterion_key").agg(
        F.min("pos").alias("judgment_pos"), F.min("id").alias("id")).select(
        "scan_id", "judgment_pos", "criterion_key", F.lit("met").alias("verdict"), F.array("id").alias("fact_ids"),
        F.lit("A fact of the matching kind is stated.").alias("reasoning"))


def answered_judgments(answers: DataFrame) -> DataFrame:
    """Judgments in model answers (scan_id, answer); a refused answer judges nothing."""
    parsed = parse_answers(answers, "judgments")
    return parsed.select("scan_id", F.posexplode("parsed.judgments").alias("judgment_pos", "j")).select(
        "scan_id", "judgment_pos", "j.*")


# ---------------------------------------------------------------- notes
def _ruled_note(drafts: DataFrame) -> DataFrame:
    first, second = F.col("offered")[0], F.try_element_at("offered", F.lit(2))
    marker = lambda f: F.concat(F.lit(" [F"), f["id"].cast("string"), F.lit("]."))
    said = lambda f: F.regexp_replace(F.regexp_replace(f["fact"], r"\.+$", ""), r"[.!?](?=\s)", ",")
    return drafts.withColumn("note", F.concat(
        F.lit("I came across your company and wanted to write. "), said(first), marker(first), F.lit(" "),
        said(second), marker(second), F.lit(" I would be glad to talk whenever it suits you."))
    ).withColumn("fact_ids", F.array(first["id"], second["id"]))


def write_notes(requests: DataFrame, folder: str, model: Model | None = None, attempts: int = 2, calls: int | None = None) -> DataFrame:
    """Notes for requests (scan_id, request, offered): scan_id, note, fact_ids, note_status, error.

    A draft that breaks a rule is asked for once more with the reason; after that it is given up as
    unverified. Each round is stored under ``folder``, so a model is never asked twice for a row.
    """
    columns = ["scan_id", "note", "fact_ids", "error"]
    if model is None:
        checked = note_problem(_ruled_note(requests)).withColumn("error", F.lit(None).cast("string"))
        return checked.select(
            "scan_id", F.when(F.col("problem").isNull(), F.col("note")).alias("note"), "fact_ids",
            F.when(F.col("problem").isNull(), "ok").otherwise("unverified").alias("note_status"), "error")
    done: DataFrame | None = None
    asked = requests.withColumn("feedback", F.lit(""))
    for attempt in range(attempts):
        text = F.concat("request", F.when(F.col("feedback") != "", F.concat(F.lit("\n"), "feedback")).otherwise(F.lit("")))
        parsed = parse_answers(call_model(asked.withColumn("request", text), model, calls=calls), "note")
        drafts = parsed.withColumns({"note": F.col("parsed.note"), "fact_ids": F.col("parsed.fact_ids"),
                                     "refused": F.col("problem")}).drop("problem", "parsed", "answer")
        checked = note_problem(drafts).withColumn("problem", F.when(F.col("refused").isNotNull(), "empty").otherwise(F.col("problem")))
        checked = stage(checked.drop("refused"), f"{folder}/round={attempt}")
        good = checked.filter(F.col("problem").isNull()).select(*columns, F.lit("ok").alias("note_status"))
        done = good if done is None else done.unionByName(good)
        rejected = checked.filter(F.col("problem").isNotNull())
        # the request as first asked, with what was wrong about the answer
        asked = requests.join(rejected.select("scan_id", feedback(F.col("problem")).alias("feedback")), "scan_id")
    # an answer that never came is an error of the scan if it may come later (see error_class)
    given_up = rejected.select(
        "scan_id", F.lit(None).cast("string").alias("note"), F.lit(None).cast("array<int>").alias("fact_ids"),
        "error", F.lit("unverified").alias("note_status"))
    return done.unionByName(given_up)
