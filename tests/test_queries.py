"""A sample of the registered queries against their SQL (all of them: oracle_check.py)."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck
from workload import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "fit_score", "lead_ranking", "lead_import", "element_leads", "page_text", "fresh_scan", "breaker_windows",
    "grounding_join", "grounding_corpus", "fact_rank", "verdict_check", "note_validation", "eval_report", "criteria_clean",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_listed_once_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and df.columns == ["id", "name", "scan_id", "score", "coverage", "rank_value"]
