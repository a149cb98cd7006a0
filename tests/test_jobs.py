"""Streams over several batches, stored tables, models and the whole batch on small tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.operators import evaluation, latest, models, traffic
from attesta.operators.scoring import criteria_hash
from attesta.plans.scan_batch import run_scans
from attesta.session import literal_relation
from attesta.sinks import tables
from attesta.streaming import runs
from workload.jobs import _batch_profiles


def in_files(df, folder, order, n):
    """Write rows as n files in the given order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def log(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return events.select(
        F.lit("a").alias("upstream"), (F.col("user_id") % 5).alias("host"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))


def test_breaker_stream_equals_batch(spark, log, tmp_path):
    # ten events in quick succession around every logged one, so that cooldowns cross batches
    dense = log.withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 50).cast("bigint"))).drop("host")
    stream = in_files(dense, str(tmp_path / "in"), "ts", 4)
    runs.breaker(stream, ["upstream"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in runs.found(spark, str(tmp_path / "out")).select("id", "available", "tripped_us").collect()}
    want = {tuple(r) for r in traffic.breaker_windows(dense, ["upstream"]).select("id", "available", "tripped_us").collect()}
    assert got == want and {a for _, a, _ in got} == {True, False}


def test_politeness_stream_equals_batch(spark, log, tmp_path):
    dense = log.select("host", F.timestamp_micros((F.unix_micros("ts") / 3000).cast("bigint")).alias("ts"), "id")
    stream = in_files(dense, str(tmp_path / "in"), "ts", 3)
    runs.politeness(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in runs.found(spark, str(tmp_path / "out")).select("host", "id", "gap_us").collect()}
    want = {tuple(r) for r in traffic.politeness_audit(dense).select("host", "id", "gap_us").collect()}
    assert got == want and got


def test_latest_stream_equals_batch(spark, tmp_path):
    from workload.proxies import scans

    rows = scans(spark, "/root/testdata/sf0.001")
    stream = in_files(rows, str(tmp_path / "in"), "scan_id", 4)
    runs.latest_scans(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    keys = ["company_id", "profile_id"]
    got = {(r.company_id, r.profile_id): r.scan_id for r in runs.current(spark, str(tmp_path / "out"), keys).collect()}
    assert got == {(r.company_id, r.profile_id): r.scan_id for r in latest.latest_scans(rows).collect()}


def test_import_stream_adds_each_domain_once(spark, tmp_path):
    rows = [(f"n{i}", f"www.site{i % 7}.com", None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, domain string, source string, row_pos long")
    stream = in_files(df, str(tmp_path / "in"), "row_pos", 4)
    known = spark.createDataFrame([("site3.com",)], "domain string")
    runs.import_leads(stream, known, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.domain: r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"site{i}.com": f"n{i}" for i in range(7) if i != 3}


def test_stored_tables(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 5, "a\x00b")], "scan_id long, profile_id int, text string")
    tables.write_scan_outputs(folder, "0", {"scans": rows, "facts": rows})
    for _ in range(2):  # a retry replaces what the batch wrote
        tables.write_scan_outputs(folder, "1", {"scans": rows.withColumn("extra", F.lit("x")), "facts": rows})
    assert sorted((r.text, r.extra or "") for r in tables.read_table(spark, folder, "scans").collect()) == [("ab", ""), ("ab", "x")]
    wide = tables.with_columns_of(rows, tables.read_table(spark, folder, "scans").schema)
    assert wide.columns == ["scan_id", "text", "extra", "batch", "profile_id"] and wide.head().extra is None


def test_golden_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"note": "x", "cases": [
        {"domain": "a.com", "icp": "sales", "expected_facts": ["1994"], "expected_verdicts": {"k": ["met", "unknown"], "m": "met"}},
        {"domain": "b.com", "icp": "buybox"}]}, indent=1))
    rows = {r.domain: r for r in evaluation.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert rows["a.com"].accepted == {"k": ["met", "unknown"], "m": ["met"]}
    assert rows["b.com"].expected_facts == [] and rows["b.com"].accepted == {}
    assert evaluation.read_golden(spark, str(tmp_path / "g.json"), only="b.com").count() == 1


def test_report_text(spark):
    cases = spark.createDataFrame(
        [(1, "a", 9.0, ["Ten"], {"k": ["met"], "gone": ["met"]}), (2, "b", 1.0, ["x"], {"k": ["met"]})],
        "scan_id long, domain string, latency double, expected_facts array<string>, accepted map<string,array<string>>")
    facts = spark.createDataFrame([(1, 1, "ten people", "we are ten", "exact"), (2, 1, "f", "x", "none")],
                                  "scan_id long, id int, fact string, evidence_quote string, grounding string")
    verdicts = spark.createDataFrame([(1, "k", "met", "exact", "q"), (2, "k", "not_met", "none", None)],
                                     "scan_id long, criterion_key string, verdict string, grounding string, evidence_quote string")
    text = evaluation.render(evaluation.report(evaluation.evaluate(cases, facts, verdicts)))
    for part in ("Cases: 2, facts: 2, grounded: 1 (50%)", "found: 1 of 2", "expected: 1 of 2", "quote: no", "9.0 s over 1"):
        assert part in text


def test_note_retry(spark, tmp_path):
    offered = [(1, 1, "Founded in 1985.", "since 1985"), (2, 2, "Ten people.", "team")]
    asked = spark.createDataFrame(
        [(1, "write A", offered), (2, "write B", offered), (3, "write C", offered)],
        "scan_id long, request string, offered array<struct<note_pos:int,id:int,fact:string,evidence_quote:string>>")
    good = "You began in 1985 [F1]. You are a team [F2]. We like it. Talk soon."

    def model(requests: pd.Series) -> pd.Series:
        def answer(r):
            if "write A" in r or ("write B" in r and "exactly two" in r):
                return json.dumps({"note": good, "fact_ids": [1, 2]})
            return json.dumps({"note": good, "fact_ids": [1]}) if "write B" in r else "no json"
        return requests.map(answer)

    got = {r.scan_id: (r.note, r.note_status) for r in models.write_notes(asked, str(tmp_path), model).collect()}
    assert got == {1: (good, "ok"), 2: (good, "ok"), 3: (None, "unverified")}


def test_failing_model_marks_rows(spark):
    def broken(requests: pd.Series) -> pd.Series:
        raise TimeoutError("429 slow down")

    row = models.call_model(spark.createDataFrame([(1, "x")], "scan_id long, request string"), broken).head()
    assert row.answer is None and row.error == "TimeoutError: 429 slow down"


def batch(spark, tmp_path, more_pages=(), **model):
    long = "We repair roofs, gutters and walls in the whole county and are happy to help you with any question. " * 8
    page = lambda body: f"<html><title>Shop</title><body><p>{body}</p><p>{long}</p></body></html>"
    rows = [
        ("https://a.com/", page("Family owned and operated since 1985, serving the county."), 1),
        ("https://a.com/about", page("Over 30 years of experience."), 2), ("https://a.com/copy", page("Over 30 years of experience."), 3),
        ("https://b.com/", page("We are a franchisee here. Locally owned and operated by neighbours."), 1), ("https://c.com/", "<p>tiny</p>", 1)]
    pages = spark.createDataFrame(rows, "url string, html string, n int").select(
        "url", "html", F.timestamp_seconds(F.col("n") + 1766000000).alias("fetched_at"), F.lit("live").alias("via"))
    profiles = _batch_profiles(spark)
    work = [(10 * i + p, i, d, d, p) for i, d in enumerate(["a.com", "b.com", "c.com", "d.com"]) for p in (1, 2)]
    worklist = spark.createDataFrame(work, "scan_id long, company_id long, name string, domain string, profile_id long")
    records = spark.createDataFrame(
        [("a.com", "rdap", '{"events":[{"eventAction":"registration","eventDate":"1999-05-01T00:00:00Z"}]}', None)],
        "domain string, kind string, payload string, fallback string").withColumn("fetched_at", F.timestamp_seconds(F.lit(1766000000)))
    if more_pages:
        pages = pages.unionByName(spark.createDataFrame(more_pages, "url string, html string, n long").select(
            "url", "html", F.timestamp_seconds("n").alias("fetched_at"), F.lit("live").alias("via")))
    out = run_scans(worklist, profiles, pages, records, F.to_timestamp(F.lit("2026-01-01")), str(tmp_path), **model)
    return out, {(r.domain, r.profile_id): r for r in out.scans.collect()}


def test_whole_batch_by_rule(spark, tmp_path):
    out, got = batch(spark, tmp_path)
    a = got["a.com", 1]
    assert (a.score, a.coverage, a.note_status, a.status) == (100.0, 100.0, "ok", "done")
    assert (got["a.com", 2].score, got["a.com", 2].coverage) == (100.0, 50.0)
    b = got["b.com", 1]  # a franchise: owner 5 of 5 known, minus the share of the red flag
    assert (b.score, b.coverage, b.note_status) == (55.6, 50.0, "red_flag")
    assert [got[d, 1].no_evidence_reason for d in ("a.com", "b.com", "c.com", "d.com")] == [None, None, "content_too_thin", "site_unreadable"]
    assert got["c.com", 1].score is None and got["d.com", 2].note_status == "skipped"
    facts = [(r.id, r.category, r.grounding) for r in out.facts.filter("scan_id = 1").orderBy("id").collect()]
    assert [f[2] for f in facts] == ["exact"] * (len(facts) - 1) + ["record"] and facts[-1][1] == "domain_record"
    assert "[F" not in a.outreach_note


def test_whole_batch_with_models(spark, tmp_path):
    def extract(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: json.dumps({"facts": [
            {"category": "hiring", "fact": "They repair roofs.", "evidence_quote": "We repair roofs, gutters and walls", "confidence": 0.8},
            {"category": "hiring", "fact": "They fly.", "evidence_quote": "We fly to the moon every week", "confidence": 0.9}]}))

    def judge(requests: pd.Series) -> pd.Series:
        if requests.str.contains("b.com").any() and len(requests) == 1:
            raise TimeoutError("503")
        return requests.map(lambda r: json.dumps({"judgments": [
            {"criterion_key": "owner_operated", "verdict": "not_met", "fact_ids": [1], "reasoning": "r"},
            {"criterion_key": "active_hiring", "verdict": "met", "fact_ids": [99], "reasoning": "r"}]}))

    out, got = batch(spark, tmp_path, extract=extract, judge=judge)
    said = {(r.fact, r.grounding) for r in out.facts.filter("scan_id = 1").collect()}
    assert ("They repair roofs.", "exact") in said and ("They fly.", "none") in said
    assert (got["a.com", 1].score, got["a.com", 2].score) == (0.0, None)
    assert {r.reasoning for r in out.results.filter("scan_id = 2 and criterion_key = 'active_hiring'").collect()} == {
        "Downgraded: no verified fact cited. (r)"}


def busy_model():
    def model(requests):
        raise ConnectionError("429")

    return model


def test_recrawled_and_stale_pages_count_once(spark, tmp_path):
    now = 1766000100
    more = [("https://a.com/about", "<html><body><p>" + "Newly written page of the same address. " * 5 + "</p></body></html>", now),
            ("https://a.com/old", "<html><body><p>" + "A page of long ago. " * 9 + "</p></body></html>", 1700000000),
            ("https://a.com/later", "<html><body><p>" + "A page of tomorrow. " * 9 + "</p></body></html>", 1800000000)]
    out, got = batch(spark, tmp_path, more_pages=more)
    assert got["a.com", 1].pages_fetched == 3  # home, the new /about and /copy, which no longer repeats it
    assert out.facts.filter("scan_id = 1").groupBy("id").count().filter("count > 1").isEmpty()


def test_passing_trouble_of_any_call_ends_the_scan_as_error(spark, tmp_path):
    _, got = batch(spark, tmp_path / "x", extract=busy_model())
    assert {got[d, p].status for d in ("a.com", "b.com") for p in (1, 2)} == {"error"}
    assert (got["a.com", 1].error, got["a.com", 1].score) == ("ConnectionError: 429", None)
    assert got["c.com", 1].status == "done"  # nothing was asked for it
    out, got = batch(spark, tmp_path / "j", judge=busy_model())
    assert (got["a.com", 1].status, got["a.com", 1].score) == ("error", None) and not out.facts.filter("scan_id = 1").isEmpty()
    assert out.results.filter("scan_id = 1").isEmpty()
    out, got = batch(spark, tmp_path / "n", write_note=busy_model())
    assert (got["a.com", 1].status, got["a.com", 1].score, got["a.com", 1].note_status) == ("error", 100.0, None)
    assert (got["b.com", 1].status, got["b.com", 1].note_status) == ("done", "red_flag")


def test_requests_are_made_once_and_hold_pages_and_records(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def note(kind, answer):
        def model(requests):
            with open(f"{seen}-{kind}", "a") as f:
                f.writelines(json.dumps(r) + "\n" for r in requests)
            return answer(requests)
        return model

    said_once = lambda requests: requests.map(lambda r: json.dumps({"facts": [
        {"category": "hiring", "fact": "They repair roofs.", "evidence_quote": "We repair roofs, gutters and walls", "confidence": 0.8}]}))
    judged = lambda requests: requests.map(lambda r: json.dumps({"judgments": []}))
    calls = {"extract": note("extract", said_once), "judge": note("judge", judged)}
    batch(spark, tmp_path / "run", **calls)
    asked = [json.loads(x) for x in open(f"{seen}-extract")]
    assert len(asked) == len(set(asked)) == 3  # two different pages of a.com, one of b.com
    request = next(r for r in map(json.loads, open(f"{seen}-judge")) if "a.com" in r)
    assert "https://a.com/, https://a.com/about" in request and "registered 1999-05-01" in request
    before = {k: len(open(f"{seen}-{k}").readlines()) for k in calls}
    _, got = batch(spark, tmp_path / "run", resume=True, **calls)  # nothing is asked again
    assert before == {k: len(open(f"{seen}-{k}").readlines()) for k in calls} and got["a.com", 1].status == "done"


def test_stored_scans_robots_and_outputs(spark, tmp_path):
    prints = _batch_profiles(spark).select("profile_id", criteria_hash(F.col("criteria")).alias("criteria_hash"))
    stored = prints.select(
        F.lit(99).cast("bigint").alias("scan_id"), F.lit(0).cast("bigint").alias("company_id"), "profile_id", "criteria_hash", F.lit("done").alias("status"),
        F.when(F.col("profile_id") == 1, F.to_timestamp(F.lit("2025-12-01"))).otherwise(F.to_timestamp(F.lit("2025-01-01"))).alias("finished_at"))
    robots = spark.createDataFrame([("https://b.com", 200, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    out, got = batch(spark, tmp_path / "run", stored_scans=stored, robots=robots, outputs=str(tmp_path / "out"))
    assert [tuple(r) for r in out.reused.collect()] == [(1, 99)] and ("a.com", 1) not in got and got["a.com", 2].score == 100.0
    assert got["b.com", 1].no_evidence_reason == "site_unreadable"
    assert tables.read_table(spark, str(tmp_path / "out"), "scans").count() == len(got) == 7


def test_literal_relation_handles_nulls(spark):
    schema = spark.createDataFrame([], "a int, b array<string>").schema
    assert [tuple(r) for r in literal_relation(spark, [(1, ["x"]), (None, [])], schema).collect()] == [(1, ["x"]), (None, [])]
    assert literal_relation(spark, [], schema).count() == 0


def test_lines_dealt_out_by_scan_meet_their_scan_without_another_exchange(spark, tmp_path):
    from workload import proxies, verdicts

    day = "timestamp'2020-01-01'"
    spark.sql(f"""SELECT * FROM VALUES (1, 1, 5, 6, 2.0D, {day}, 9.5D, 'A', 'O'), (1, 1, 5, 7, 3.0D, {day}, 9.5D, 'N', 'O'), (1, 1, 5, 7, 3.0D, {day}, 9.5D, 'N', 'O'),
      (1, 2, 4, 6, 40.0D, {day}, 1.5D, 'R', 'F'), (2, 1, 3, 3, 11.0D, {day}, 0.5D, 'A', 'F'), (null, 1, 3, 3, 11.0D, {day}, 0.5D, 'A', 'F')
      AS t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice, l_returnflag, l_linestatus)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    own = spark.sql("SELECT * FROM VALUES (1, 10), (1, 11), (2, 12) AS t(scan_id, profile_id)").repartition(3)
    makers = [lambda **by: proxies.results(spark, str(tmp_path), "verdict", "source_url", **by), lambda **by: verdicts.stored_facts(spark, str(tmp_path), **by)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for make in makers:
            dealt, plain = (rows.join(own, "scan_id") for rows in (make(by_scan=True), make()))
            assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect())) and dealt.count() == 5
            plans = [rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") for rows in (dealt, plain)]
            assert plans == [2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
