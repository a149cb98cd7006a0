"""Streams that expire, hold back and remember, and model calls that are not made twice."""

import json
import threading
import time

import pandas as pd
from pyspark.sql import functions as F

from attesta.operators import models, traffic
from attesta.operators.cache import scan_worklist
from attesta.plans.scan_batch import landed_pages
from attesta.streaming import runs
from test_jobs import batch

DAY = 86_400


def arrive(spark, rows, schema, folder, run):
    """Each list of ``rows`` is one arrival; the queries of all of them."""
    done = []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        query = run(spark.readStream.schema(schema).parquet(folder))
        query.awaitTermination()
        done.append(query)
    return done


def moments(rows):
    return rows.withColumn("ts", F.timestamp_seconds("s"))


def test_state_of_expired_keys_is_cleared(spark, tmp_path):
    schema = "url string, s long, id long"
    first = [(f"u{k}", k, k) for k in range(50)]
    parts = [first, [("u1", DAY, 100), ("u2", 1, 101)], [("v", 400 * DAY, 102)], [("w", 400 * DAY + 1, 103), ("u3", 2, 104)]]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    queries = arrive(spark, parts, schema, str(tmp_path / "in"), lambda s: runs.keep_newest(moments(s), ["url"], ["ts", "id"], out, state, life_days=30))
    held = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in queries]
    assert held[0] == held[1] == 50 and held[-1] <= 2
    got = {r.url: r.id for r in runs.current(spark, out, ["url"], ["ts", "id"]).collect()}
    # an expired row of a key whose newer row is stored does not come back
    assert got == {**{f"u{k}": k for k in range(50)}, "u1": 100, "v": 102, "w": 103, "u2": 2}


def test_older_rows_that_arrive_later_do_not_win(spark, tmp_path):
    out, state, schema = str(tmp_path / "out"), str(tmp_path / "state"), "url string, s long, id long"
    parts = [[("a", 40 * DAY, 1)], [("a", 20 * DAY, 2)], [("a", 41 * DAY, 3)]]
    arrive(spark, parts, schema, str(tmp_path / "in"), lambda s: runs.keep_newest(moments(s), ["url"], ["ts", "id"], out, state, life_days=30))
    assert [r.id for r in runs.current(spark, out, ["url"], ["ts", "id"]).collect()] == [3]


def test_import_reads_its_own_rows_only(spark, tmp_path):
    schema = "name string, domain string, source string, row_pos long"
    parts = [[(f"n{k}-{p}", f"site{k % 30}.com", None, 1000 * p + k) for k in range(100)] for p in range(4)]
    parts[2].append(("new", "late.com", None, 2500))
    known = spark.createDataFrame([("site3.com",)], "domain string")
    out = str(tmp_path / "out")
    queries = arrive(spark, parts, schema, str(tmp_path / "in"), lambda s: runs.import_leads(s, known, out, str(tmp_path / "state")))
    assert [q.lastProgress["numInputRows"] for q in queries] == [100, 100, 101, 100]
    got = {r.domain: r.name for r in spark.read.parquet(out).collect()}
    assert got == {**{f"site{k}.com": f"n{k}-0" for k in range(30) if k != 3}, "late.com": "new"}
    assert spark.read.parquet(out).count() == 30


def test_out_of_order_audits_equal_batch_and_set_late_rows_aside(spark, tmp_path):
    schema = "host string, s long, id long"
    log = [(f"h{k % 3}", 10 * k + k % 4, k) for k in range(200)]
    # rows come up to 300 s after their moment
    by_arrival = sorted(log, key=lambda r: r[1] + hash((r[2], 7)) % 300)
    parts = [by_arrival[k : k + 50] for k in range(0, 200, 50)]
    assert any(max(r[1] for r in a) > min(r[1] for r in b) for a, b in zip(parts, parts[1:]))
    late = [("h0", 1, 900), ("h1", 2, 901)]
    parts[-1] = parts[-1] + late
    gap, delay = 35_000_000, 400_000_000
    out = str(tmp_path / "out")
    run = lambda s: runs.politeness(moments(s).drop("s"), out, str(tmp_path / "state"), gap, delay)
    arrive(spark, parts, schema, str(tmp_path / "in"), run)
    rows = moments(spark.createDataFrame(log, schema)).drop("s")
    want = {tuple(r) for r in traffic.politeness_audit(rows, gap).select("host", "id", "gap_us").collect()}
    assert {tuple(r) for r in runs.found(spark, out).select("host", "id", "gap_us").collect()} == want and want
    assert sorted(r.id for r in runs.late(spark, out).collect()) == [900, 901]
    held = spark.read.parquet(f"{out}/held")
    assert 0 < held.filter("batch = 3").count() < 100  # the delay's rows, not the log


def test_one_bad_request_marks_one_row(spark):
    requests = spark.createDataFrame([(k, f"r{k}") for k in range(300)], "scan_id long, request string")

    def model(texts: pd.Series) -> pd.Series:
        if (texts == "r7").any():
            raise ValueError("refused")
        return texts.map(lambda t: None if t == "r8" else json.dumps({"said": t}))

    rows = {r.scan_id: r for r in models.call_model(requests, model, calls=3).collect()}
    assert [k for k, r in rows.items() if r.error] == [7] and rows[7].error == "ValueError: refused"
    assert rows[8].answer is None and rows[9].answer == '{"said": "r9"}' and len(rows) == 300


def test_passing_errors_are_tried_again_and_calls_are_bounded(spark):
    requests = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "scan_id long, request string")

    class Model:
        """Refuses every first attempt, and all at r5; answers with the most calls seen at a time."""

        def __getstate__(self):
            return {}

        def __call__(self, texts: pd.Series) -> pd.Series:
            own, name = self.__dict__, texts.iloc[0]
            lock, tries = own.setdefault("lock", threading.Lock()), own.setdefault("tries", {})
            with lock:
                own["now"] = own.get("now", 0) + 1
                own["most"] = max(own.get("most", 0), own["now"])
                tries[name] = tries.get(name, 0) + 1
            time.sleep(0.01)
            with lock:
                own["now"] -= 1
            if tries[name] == 1 or name == "r5":
                raise RuntimeError("429 slow down")
            return pd.Series([f"{own['most']},{tries[name]}"])

    rows = models.call_model(requests, Model(), calls=1, in_flight=4, tries=3, wait_s=0.01).collect()
    assert {r.scan_id for r in rows if r.error} == {5}
    answered = [tuple(map(int, r.answer.split(","))) for r in rows if r.answer]
    assert max(m for m, _ in answered) <= 4 and {t for _, t in answered} == {2}


def test_second_batch_over_unchanged_pages_asks_no_model(spark, tmp_path):
    def extract(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: json.dumps({"facts": [
            {"category": "hiring", "fact": "They repair roofs.", "evidence_quote": "We repair roofs, gutters and walls", "confidence": 0.8}]}))

    def judge(requests: pd.Series) -> pd.Series:
        return requests.map(lambda r: json.dumps({"judgments": []}))

    def forbidden(requests: pd.Series) -> pd.Series:
        raise ValueError("asked again")

    first, rows = batch(spark, tmp_path / "first", extract=extract, judge=judge)
    answers = spark.createDataFrame(first.answers.collect(), first.answers.schema)
    again, same = batch(spark, tmp_path / "again", extract=forbidden, judge=forbidden, known_answers=answers)
    assert answers.count() > 3 and {k: (r.score, r.status) for k, r in same.items()} == {k: (r.score, r.status) for k, r in rows.items()}
    assert again.facts.count() == first.facts.count() and again.answers.count() == answers.count()
    # a changed page is asked about again, and only that page
    changed, _ = batch(spark, tmp_path / "changed", extract=forbidden, judge=judge, known_answers=answers,
                       more_pages=[("https://a.com/about", "<p>" + "We opened a second shop this year. " * 30 + "</p>", 1766000100)])
    assert changed.answers.count() < answers.count()


def test_criteria_of_a_model_keep_their_errors(spark):
    profiles = spark.createDataFrame([(1, "a"), (2, "b")], "profile_id long, description_text string")

    def model(texts: pd.Series) -> pd.Series:
        if texts.iloc[0] == "b":
            raise ValueError("no")
        return texts.map(lambda t: "not json")

    got = {r.profile_id: (r.criteria, r.criteria_error) for r in models.compile_criteria(profiles, model).collect()}
    assert got[2] == (None, "ValueError: no") and got[1][0] is None and got[1][1]


def test_landed_pages_of_wanted_sites_only(spark):
    rows = [("https://a.com/", "x", 1), ("https://a.com/", "y", 2), ("https://www.b.com/p", "z", 1)]
    pages = spark.createDataFrame(rows, "url string, html string, n long").select("url", "html", F.timestamp_seconds("n").alias("fetched_at"))
    sites = spark.createDataFrame([("a.com",)], "domain string")
    assert [(r.url, r.html) for r in landed_pages(pages, F.timestamp_seconds(F.lit(3)), sites=sites).collect()] == [("https://a.com/", "y")]


def test_work_list_has_no_constant_key(spark):
    companies = spark.createDataFrame([(k, f"i{k % 2}") for k in range(9)], "id long, industry string")
    profiles = spark.createDataFrame([(1,), (2,)], "profile_id long")
    queued = scan_worklist(companies, profiles, 5)
    assert queued.count() == 10 and "Cartesian" not in queued._jdf.queryExecution().toString() and "NestedLoop" not in queued._jdf.queryExecution().toString()
