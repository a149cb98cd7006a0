"""Facts of a scan: union of sources, deduplication, grounding, ranking, record facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import clean, normalize
from attesta.operators.answers import parse_answers
from attesta.operators.grounding import demote_new_numbers, ground_asked, with_quote_form
from attesta.schemas import FACT_CATEGORIES, GROUNDED

MAX_FACTS = 40
FACT_LENGTH = 300
QUOTE_LENGTH = 400


def known_category(category: Column) -> Column:
    return F.when(category.isin(*FACT_CATEGORIES), category).otherwise(F.lit("other"))


def answered_facts(answers: DataFrame) -> DataFrame:
    """Facts in model answers (…, url, answer JSON): statement and quote present, category known,
    texts trimmed to their stored length. An answer that breaks its format (too many facts, a
    confidence out of range, no JSON) is refused as a whole and has no facts."""
    kept = [c for c in answers.columns if c != "answer"]
    rows = parse_answers(answers, "facts").select(*kept, F.posexplode("parsed.facts").alias("answer_pos", "f"))
    trimmed = lambda c, n: F.substring(F.coalesce(clean(F.col(c)), F.lit("")), 1, n)
    return rows.filter(
        (F.coalesce("f.fact", F.lit("")) != "") & (F.coalesce("f.evidence_quote", F.lit("")) != "")
    ).select(
        *kept, "answer_pos",
        known_category(F.col("f.category")).alias("category"),
        trimmed("f.fact", FACT_LENGTH).alias("fact"),
        trimmed("f.evidence_quote", QUOTE_LENGTH).alias("evidence_quote"),
        F.col("url").alias("source_url"),
        F.col("f.confidence").alias("confidence"),
    )


def raw_facts(signals: DataFrame, answered: DataFrame) -> DataFrame:
    """Both sources as one table: page by page, the page's signals before its answered facts."""
    columns = ["scan_id", "category", "fact", "evidence_quote", "source_url", "confidence"]
    place = lambda source, pos: F.struct(
        F.col("page_pos").cast("bigint").alias("page"), F.lit(source).alias("source"),
        F.col(pos).cast("bigint").alias("pos")).alias("arrival")
    return signals.select(*columns, place(0, "signal_pos")).unionByName(
        answered.select(*columns, place(1, "answer_pos")))


def distinct_facts(facts: DataFrame) -> DataFrame:
    """The first of all facts of a scan that say the same. This comes before grounding, so an
    unfounded first copy also suppresses a founded later one. The facts are left dealt out by scan."""
    payload = [c for c in facts.columns if c not in ("scan_id", "arrival")]
    # generated, so that the matching form is worked out once; empty statements drop out here
    said = facts.select("*", F.explode(F.filter(F.array(normalize(F.col("fact"))), lambda s: s != "")).alias("said"))
    return (
        said.repartition("scan_id").groupBy("scan_id", "said")
        .agg(F.min_by(F.struct(*payload, "arrival"), "arrival").alias("row"))
        .select("scan_id", "said", "row.*")
    )


def rank_facts(grounded: DataFrame, limit: int = MAX_FACTS) -> DataFrame:
    """Exact before fuzzy before ungrounded, then by confidence, then by arrival; numbered from 1.
    Only the first ``limit`` of a scan are kept, which Spark applies before the shuffle."""
    grade = F.when(F.col("grounding") == "exact", 0).when(F.col("grounding") == "fuzzy", 1).otherwise(2)
    order = W.partitionBy("scan_id").orderBy(grade, F.col("confidence").desc(), "arrival")
    return grounded.withColumn("id", F.row_number().over(order)).filter(F.col("id") <= limit)


def page_facts(facts: DataFrame, pages: DataFrame, limit: int = MAX_FACTS, fuzzy: bool = True) -> DataFrame:
    """Facts of each scan grounded against the scan's pages, ranked and capped.

    facts: scan_id, arrival, category, fact, evidence_quote, source_url, confidence;
    pages: scan_id, page_pos, url, text and, for the links shown, display_url.
    """
    # arrival is unique in a scan; number facts by page, source and position for the lookup
    numbered = distinct_facts(with_quote_form(facts)).withColumn(
        "fact_id", (F.col("arrival.page") * 2 + F.col("arrival.source")) * 1_000_000 + F.col("arrival.pos"))
    grounded = ground_asked(numbered, pages, fuzzy).withColumn(
        "grounding", demote_new_numbers(F.col("grounding"), F.col("said"), F.col("evidence_quote")))
    ranked = rank_facts(grounded, limit).withColumn("page_url", F.coalesce("matched_url", "source_url"))
    if "display_url" in pages.columns:
        shown = pages.select("scan_id", F.col("url").alias("page_url"), "display_url")
        ranked = ranked.join(shown, ["scan_id", "page_url"], "left")
    else:
        ranked = ranked.withColumn("display_url", F.col("page_url"))
    return ranked.select(
        "scan_id", "id", "category", "fact", "evidence_quote",
        F.coalesce("display_url", "page_url").alias("source_url"), "confidence", "grounding")


# The sentences below are stored outputs.
def record_facts(scans: DataFrame) -> DataFrame:
    """Facts stated by public records, numbered after the ``n_facts`` page facts of the scan.

    scans: scan_id, domain, n_facts, rdap and wayback structs, rdap_source, wayback_source.
    """
    registered = F.col("rdap.registered")
    captured, approx = F.col("wayback.first_capture"), F.coalesce("wayback.approx", F.lit(False))
    has_rdap = F.coalesce(F.col("rdap.ok"), F.lit(False)) & registered.isNotNull()
    has_wayback = captured.isNotNull()
    age = F.coalesce(F.col("rdap.domain_age_years").cast("string"), F.lit("?"))
    registration = F.struct(
        F.lit(1).alias("place"),
        F.concat(F.lit("Domain "), "domain", F.lit(" was registered on "), registered, F.lit(" ("), age, F.lit(" years ago).")).alias("fact"),
        F.concat(F.lit("registration: "), registered).alias("evidence_quote"),
        F.col("rdap_source").alias("source_url"), F.lit(1.0).alias("confidence"))
    capture = F.struct(
        F.when(has_rdap, F.lit(2)).otherwise(F.lit(1)).alias("place"),
        F.when(approx, F.concat(F.lit("Earliest Wayback Machine snapshot found: "), captured, F.lit(" (approximate).")))
        .otherwise(F.concat(F.lit("The website was first archived by the Wayback Machine on "), captured, F.lit("."))).alias("fact"),
        F.concat(F.when(approx, F.lit("earliest snapshot found")).otherwise(F.lit("first capture")), F.lit(": "), captured).alias("evidence_quote"),
        F.col("wayback_source").alias("source_url"), F.when(approx, F.lit(0.8)).otherwise(F.lit(1.0)).alias("confidence"))
    stated = F.array_compact(F.array(F.when(has_rdap, registration), F.when(has_wayback, capture)))
    return scans.select("scan_id", "n_facts", F.explode(stated).alias("r")).select(
        "scan_id", (F.col("n_facts") + F.col("r.place")).cast("int").alias("id"), F.lit("domain_record").alias("category"),
        "r.fact", "r.evidence_quote", "r.source_url", "r.confidence", F.lit("record").alias("grounding"))


def with_record_facts(facts: DataFrame, scans: DataFrame) -> DataFrame:
    """Page facts and record facts of the scans; scans as in ``record_facts`` without ``n_facts``."""
    counts = facts.groupBy("scan_id").agg(F.max("id").alias("n_facts"))
    numbered = scans.join(counts, "scan_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    return facts.unionByName(record_facts(numbered))


def is_grounded(grounding: Column) -> Column:
    return grounding.isin(*GROUNDED)


def grounding_counts(facts: DataFrame) -> DataFrame:
    """Per scan, the number of facts in each grounding state."""
    count = lambda state: F.count_if(F.col("grounding") == state)
    return facts.groupBy("scan_id").agg(
        F.count("*").alias("facts"), count("exact").alias("exact"), count("fuzzy").alias("fuzzy"),
        count("record").alias("record"), count("none").alias("none"))
