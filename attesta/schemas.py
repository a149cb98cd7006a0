"""Table schemas and fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, data_type) for name, data_type in columns.items()])


CRITERION = _table(key=_S, label=_S, weight=_I, test=_S, polarity=_S)
CRITERIA = T.ArrayType(CRITERION)

COMPANIES = _table(
    id=_L, domain=_S, name=_S, industry=_S, city=_S, state=_S, employee_range=_S,
    revenue_estimate=_S, phone=_S, linkedin_url=_S, source=_S, reachable=_B, created_at=_TS,
)
PROFILES = _table(id=_L, name=_S, description_text=_S, description_hash=_S, criteria=CRITERIA)
SCANS = _table(
    id=_L, company_id=_L, icp_id=_L, status=_S, score=_D, coverage=_D, outreach_note=_S,
    model_versions=T.MapType(_S, _S), criteria_hash=_S, content_chars=_L, no_evidence_reason=_S,
    pages_fetched=_L, fallback_used=_B, started_at=_TS, finished_at=_TS, error=_S,
)
FACTS = _table(
    id=_L, scan_id=_L, category=_S, fact=_S, evidence_quote=_S, source_url=_S,
    confidence=_D, grounding=_S,
)
CRITERION_RESULTS = _table(
    id=_L, scan_id=_L, criterion_key=_S, verdict=_S, evidence_quote=_S, source_url=_S,
    grounding=_S, confidence=_D,
)
PAGES = _table(
    url=_S, domain=_S, status_code=_I, text=_S, content_hash=_S, fetched_at=_TS, via=_S,
)
ENRICHMENTS = _table(domain=_S, kind=_S, payload=_S, fetched_at=_TS)

# Shapes of the structured model answers.
RAW_CRITERION = _table(key=_S, label=_S, weight=_S, test=_S, polarity=_S)
RAW_FACT = _table(category=_S, fact=_S, evidence_quote=_S, confidence=_D)
FACT_ANSWER = _table(facts=T.ArrayType(RAW_FACT))
RAW_JUDGMENT = _table(criterion_key=_S, verdict=_S, fact_ids=T.ArrayType(_I), reasoning=_S)
JUDGMENT_ANSWER = _table(judgments=T.ArrayType(RAW_JUDGMENT))
NOTE_ANSWER = _table(note=_S, fact_ids=T.ArrayType(_I))
CRITERIA_ANSWER = _table(criteria=T.ArrayType(RAW_CRITERION))

# Vocabularies shared with stored data.
FACT_CATEGORIES = (
    "founding_history", "ownership_leadership", "team_size", "locations_service_area", "hiring",
    "services_tech", "contact", "certifications_awards", "affiliations", "website_signals", "other",
)
DECISIVE = ("met", "not_met")
VERDICTS = ("met", "not_met", "unknown")
GROUNDED = ("exact", "fuzzy", "record")
GROUNDINGS = ("exact", "fuzzy", "record", "none")
