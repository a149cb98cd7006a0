"""Operators on hand-made tables."""

import csv
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.similarity import LongText, Site, find_pages, similar
from attesta.operators import asof, criteria, facts, grounding, imports, latest, notes, pages, robots, scoring, signals
from attesta.schemas import CRITERIA
from attesta.sources import crawl, leads

PROFILE = T.StructType([T.StructField("profile_id", T.LongType()), T.StructField("criteria", CRITERIA)])


def crit(key, weight, polarity="positive", label=None):
    return (key, label or key, weight, f"{key}?", polarity)


def score(spark, rows, verdicts):
    profiles = spark.createDataFrame([(1, rows)], PROFILE)
    scans = spark.createDataFrame([(7, 1)], "scan_id long, profile_id long")
    results = spark.createDataFrame([(7, k, v) for k, v in verdicts.items()], "scan_id long, criterion_key string, verdict string")
    return scoring.score_scans(scans, profiles, results).head()


def test_worked_score(spark):
    rows = [crit("founder", 5), crit("years", 4), crit("dated", 3), crit("franchise", 4, "negative")]
    r = score(spark, rows, {"founder": "met", "years": "unknown", "dated": "not_met", "franchise": "met"})
    assert (r.score, r.coverage, r.earned_weight, r.known_weight, r.penalty) == (29.2, 66.7, 5, 8, 33.3)
    r = score(spark, rows, {"founder": "met", "dated": "not_met", "franchise": "not_met"})
    assert (r.score, r.coverage) == (62.5, 66.7)


def test_score_edges(spark):
    rows = [crit("a", 1), crit("b", 5, "negative")]
    assert score(spark, rows, {}).score is None
    assert score(spark, rows, {"b": "met"}).score is None
    assert score(spark, rows, {"a": "met", "b": "met"}).score == 0.0
    only_negative = score(spark, [crit("b", 5, "negative")], {"b": "met"})
    assert (only_negative.score, only_negative.coverage, only_negative.penalty) == (None, 0.0, 100.0)
    assert score(spark, rows, {"a": "perhaps"}).score is None


def test_score_matches_plain_python(spark):
    rng = random.Random(11)
    n, profiles, results, want = 400, [], [], {}
    for i in range(n):
        rows = [crit(f"k{j}", rng.randint(1, 5), rng.choice(["positive", "positive", "negative"])) for j in range(rng.randint(1, 8))]
        verdicts = {r[0]: rng.choice(["met", "not_met", "unknown"]) for r in rows}
        profiles.append((i, rows))
        results += [(i, k, v) for k, v in verdicts.items()]
        positive = [r for r in rows if r[4] == "positive"]
        total, known = sum(r[2] for r in positive), sum(r[2] for r in positive if verdicts[r[0]] != "unknown")
        earned, penalty = sum(r[2] for r in positive if verdicts[r[0]] == "met"), 0.0
        for r in rows:
            if r[4] == "negative" and verdicts[r[0]] == "met":
                penalty += round(100.0 * r[2] / total, 1) if total else 100.0
        want[i] = round(max(0.0, 100.0 * earned / known - penalty), 1) if known else None
    scans = spark.createDataFrame([(i, i) for i in range(n)], "scan_id long, profile_id long")
    got = scoring.score_scans(
        scans, spark.createDataFrame(profiles, PROFILE),
        spark.createDataFrame(results, "scan_id long, criterion_key string, verdict string")).collect()
    assert {r.scan_id: r.score for r in got} == want
    assert all(r.score is None or 0 <= r.score <= 100 for r in got)


def test_fingerprint_ignores_labels_only(spark):
    def print_of(rows):
        return spark.createDataFrame([(1, rows)], PROFILE).select(scoring.criteria_hash(F.col("criteria")).alias("h")).head().h

    a, b = crit("a", 1), crit("b", 2, "negative")
    assert print_of([a, b]) == print_of([crit("a", 1, label="other"), b])
    assert len({print_of([a, b]), print_of([b, a]), print_of([crit("a", 2), b])}) == 3


def test_latest_prefers_done(spark):
    rows = [(1, 10, "done", "2024-01-01"), (1, 11, "error", "2024-02-01"), (2, 12, "error", "2024-01-01"), (2, 13, "error", "2024-01-02"),
            (3, 14, "running", "2024-01-01"), (4, 15, "done", None), (4, 16, "done", "2020-01-01")]
    df = spark.createDataFrame(rows, "company_id long, scan_id long, status string, day string").withColumn("finished_at", F.to_timestamp("day"))
    one = df.withColumn("profile_id", F.lit(1).cast("bigint"))
    both = one.unionByName(one.filter("scan_id in (11, 16)").withColumns({"profile_id": F.lit(2).cast("bigint"), "scan_id": F.col("scan_id") + 100}))
    got = {(r.company_id, r.profile_id): r.scan_id for r in latest.latest_scans(both).collect()}
    assert got == {(1, 1): 10, (2, 1): 13, (4, 1): 16, (1, 2): 111, (4, 2): 116}
    assert {r.company_id: r.scan_id for r in latest.latest_scans(both, profile_id=2).collect()} == {1: 111, 4: 116}


def test_import_twice_adds_nothing(spark):
    raw = spark.createDataFrame(
        [(" Acme ", "https://www.acme.com/x", "", 1), ("Second", "ACME.com", "list", 2), ("None", "n/a", None, 3), ("Beta", "beta.org", " ", 4)],
        "name string, domain string, source string, row_pos long")
    empty = spark.createDataFrame([], "domain string")
    new = imports.new_leads(raw, empty)
    assert {(r.domain, r.name, r.source) for r in new.collect()} == {("acme.com", "Acme", "csv"), ("beta.org", "Beta", "csv")}
    count = lambda known: imports.import_counters(raw, known).head().asDict()
    assert count(empty) == {"total_rows": 4, "no_domain_skipped": 1, "duplicates_skipped": 1, "inserted": 2}
    assert count(new) == {"total_rows": 4, "no_domain_skipped": 1, "duplicates_skipped": 3, "inserted": 0}


def test_lead_csv(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "utf8.csv").write_bytes(
        '﻿Info,URL,Company name,"State / Region"\nx,https://www.a.com,"Ünï, ""q""",TX\ny,b.com,"Two\nlines",\n'.encode())
    (tmp_path / "a" / "latin.csv").write_bytes('Info,URL,Company name,"State / Region"\nz,c.com,Café,OK\n'.encode("latin-1"))
    (tmp_path / "a" / "turned.csv").write_text("Website,Company,State\n\nd.com,Four,\ne.com\n")  # another header order, a short row
    (tmp_path / "a" / "again.csv").write_text("Company,Website\nSix,f.com\n")
    rows = leads.read_lead_csv(spark, str(tmp_path / "a"))
    got = {r.domain: (r.name, r.state) for r in rows.collect()}
    assert got == {"https://www.a.com": ('Ünï, "q"', "TX"), "b.com": ("Two\nlines", None), "c.com": ("Café", "OK"),
                   "d.com": ("Four", None), "e.com": (None, None), "f.com": ("Six", None)}
    (tmp_path / "b.csv").write_text("Company,Phone\nx,1\n")
    try:
        leads.read_lead_csv(spark, str(tmp_path / "b.csv"))
        raise AssertionError("a list without a website column must be refused")
    except ValueError as e:
        assert "website" in str(e)


def test_lead_csv_of_many_splits(spark, tmp_path):
    rng = random.Random(8)
    fields = ['plain', '"a, b"', '"two\nlines"', '"said ""so"""', '"\n\n"', 'in"side', '""', '"x"" \n""y"', "", "é" * 40, '"' + "long\n" * 60 + '"']
    for name in ("one", "two"):
        rows = [f"{rng.choice(fields)},d{i}.com,{rng.choice(fields)}" for i in range(300)]
        header = 'Company,"Domain",City,"Notes\nof ours"' if name == "two" else "Company,Domain,City"
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *rows, ""]), encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        raw = spark.read.text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 40
        got = leads.read_lead_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", encoding="utf-8", newline="") as f:
            want = [(r[0] or None, r[1], r[2] or None) for r in list(csv.reader(f))[1:]]
        mine = sorted((r for r in got if r.row_pos.file.endswith(f"{name}.csv")), key=lambda r: (r.row_pos.block, r.row_pos.row))
        assert [(r.name, r.domain, r.city) for r in mine] == want


def test_seed_header_maps_to_every_field():
    assert set(leads.column_positions(leads.SEED_HEADER)) == set(leads.LEAD_FIELDS)
    assert leads.column_positions(["Website", "web-site", None, "URL"]) == {"domain": 1}
    assert leads.column_positions(["Name", "Company", "Site"]) == {"name": 1, "domain": 2}
    assert leads.column_positions(["Site", "SITE!"]) == {"domain": 1}


def signal_rows(spark, text):
    df = spark.createDataFrame([(0, "https://x.com/", text)], "page int, url string, text string")
    return [(r.category, r.fact, r.evidence_quote) for r in signals.signal_facts(df).orderBy("signal_pos").collect()]


def test_signals(spark):
    said = lambda t: [s[1] for s in signal_rows(spark, t)]
    assert said("Who we are. North Pole is a flagship brand of Polar Home Group Inc., with branches.") == [
        "The company describes itself as a brand of Polar Home Group Inc."]
    both = (
        "Who we are. North Pole is a leading brand of Polar Home Group LLC., which offers heating, cooling, plumbing, drain cleaning, "
        "water heaters, sewer lines, insulation, ducts and indoor air services to homes and offices from company-owned locations across "
        "the northern states. We care.")
    assert said(both) == [
        "The company describes itself as a brand of Polar Home Group LLC.",
        "The company operates company-owned locations across the northern states."]
    assert said("Our shop is a wholly-owned subsidiary of River Holdings Inc.") == ["The company describes itself as a subsidiary of River Holdings Inc."]
    assert said("Last year it was acquired by Cobalt Equity Partners.") == ["The company states it is acquired by Cobalt Equity Partners."]
    assert said("This branch is an independently owned and operated franchise.") == ["The company describes itself as a franchise or franchisee."]
    assert said("Family-run since 1972. Over 25 years in business.") == [
        "The company describes itself as family-run.", "The page mentions 25+ years of business or experience."]


def test_signals_ignore_generic_words(spark):
    for text in (
        "Join our plan and become part of our family today.", "All work is backed by our own guarantee.", "A division of tasks keeps us fast.",
        "We repair every brand of Carrier equipment.", "Owned by Jane Doe since 1990, and proud.", "Owned by the Lopez family.",
    ):
        assert [s for s in signal_rows(spark, text) if s[0] == "affiliations"] == [], text
    assert signal_rows(spark, '"I called them, in town since 1990" - Pat') == []


def test_signal_caps_and_long_sentences(spark):
    many = " ".join(f"We have worked here since {y}." for y in (1990, 1991, 1992))
    assert [s[1][-5:-1] for s in signal_rows(spark, many)] == ["1990", "1991"]
    long = "word " * 60 + "established in 1999 " + "tail " * 60
    (quote,) = [s[2] for s in signal_rows(spark, long)]
    assert len(quote) <= 200 and "established in 1999" in quote and quote.startswith("word") and quote.endswith("tail")


def test_looks_ahead_lose_no_match(spark):
    starts = ["is brand of Acme", "as a brand of Acme", "Is brand of Acme", "subsidiary of Acme", "a wholly-owned division of Acme", "the subsidiary of Acme",
              "owned by Acme Inc", "acquired by Acme LLC", "COMPANY-owned branches across town", "owned and operated franchise", "a franchise of Acme",
              "each location is independently owned and operated", "franchisee", "FAMILY run", "Owner-operated", "locally owned and operated", "\u017fince 1999",
              "\u0130since 1999", "s\u0131nce 1999", "SINCE 1999", "E\u017ftablished in 1999", "est. 1999", "Founded in 1999", "serving all since 1999", "over 20 years of service",
              "More than 20 year\u017f in business", "nearly 20 years in service", "For 20+ years of experience", "sister since 1999", "misis brand of Acme"]
    rows = spark.createDataFrame([(i, f"Well{gap}{s} then.") for i, s in enumerate(starts) for gap in (" ", "x", ". ", "-")], "i int, t string")
    for category, kind, pattern in signals.PHRASES:
        plain = re.sub(r"(?:\(\?-iU:)?\(\?=(?:\[[^\]]*\]|\w)+\)\)?(?=\\b)", "", pattern, count=1)
        assert len(plain) < len(pattern) and plain.count("\\b") == pattern.count("\\b"), pattern
        found = rows.select("t", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect()
        assert all(r.a == r.b for r in found) and any(r.a for r in found), kind


def test_criteria_cleaning(spark):
    raw = [("Key", None, "9", None, "Negative"), ("key", "L", "x", "t", None), ("key_2", None, None, "t", "positive"), (None, "My Label", "3", None, "")]
    df = spark.createDataFrame([(raw,)], "raw array<struct<key:string,label:string,weight:string,test:string,polarity:string>>")
    got = df.select(criteria.clean_criteria(F.col("raw")).alias("c")).head().c
    assert [(c.key, c.label, c.weight, c.polarity) for c in got] == [
        ("key", "key", 5, "negative"), ("key_2", "L", 1, "positive"), ("key_2_2", "key 2 2", 1, "positive"), ("my_label", "My Label", 3, "positive")]


def test_criteria_are_tidied_once_each(spark):
    raw = [("Same", None, None, None, None)] * 12
    df = spark.createDataFrame([(raw,), (None,), ([],), ([None, ("a", " b ", "2", " c ", "x")],)],
                               "raw array<struct<key:string,label:string,weight:string,test:string,polarity:string>>")
    cleaned = df.select(criteria.clean_criteria(F.col("raw")).alias("c"))
    got = [r.c for r in cleaned.collect()]
    assert [c.key for c in got[0]] == ["same"] + [f"same_{n}" for n in range(2, 9)]
    assert got[1:3] == [None, []] and [tuple(c) for c in got[3]] == [
        ("criterion", "criterion", 1, "", "positive"), ("a", "b", 2, "c", "positive")]
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1  # not once more for each use of a key


def brute_similar(q, t, threshold=90):
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    q, t = sorted((q, t), key=len)
    windows = [(q, t[i:i + len(q)]) for i in range(len(t) - len(q) + 1)]
    windows += [(q, w) for n in range(1, len(q)) for w in (t[:n], t[-n:])]
    if len(q) == len(t):
        windows += [(t, w) for n in range(1, len(q)) for w in (q[:n], q[-n:])]
    return any(200 * common(a, b) >= threshold * (len(a) + len(b)) for a, b in windows)


def test_best_window_similarity_equals_brute_force():
    rng, hits = random.Random(5), 0
    for k in range(600):
        letters = "abcde " if k % 2 else "abcdefghijklmnop "
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 90)))
        start = rng.randrange(0, len(t))
        q = list(t[max(0, start - 12): start + rng.randrange(4, 50)])
        for _ in range(int(len(q) * rng.choice([0, 0.05, 0.1, 0.15]))):
            i = rng.randrange(len(q))
            q[i: i + rng.choice([0, 1])] = rng.choice(["", rng.choice(letters)])
        q = "".join(q)
        if len(q) < 3:
            continue
        want = brute_similar(q, t)
        hits += want
        assert LongText(t).reaches(q) == want, (q, t)
    assert 100 < hits < 600


def test_similarity_of_many_pairs_at_once_equals_brute_force():
    """Quotes over one, two and three words of 64 bits, several to a page; some pages are shorter than their quote."""
    rng, pairs = random.Random(11), []
    for _ in range(12):
        t = "".join(rng.choice("abcdefgh é語") for _ in range(rng.choice([40, 64, 131, 160])))
        page = LongText(t)
        for size in (20, 63, 64, 65, 128, 129):
            start = rng.randrange(0, max(len(t) - size, 1))
            q = list(t[start: start + size])
            for _ in range(int(len(q) * rng.choice([0, 0.06, 0.1, 0.13]))):
                i = rng.randrange(len(q))
                q[i: i + rng.choice([0, 1])] = rng.choice(["", "x", "ab"])
            pairs.append(("".join(q), page))
    pairs += [("", LongText("a")), ("a", LongText("")), ("a" * 200, LongText("b" * 300)), ("é", LongText("é"))]
    want = [bool(q and page.text) and brute_similar(q, page.text) for q, page in pairs]
    assert similar(pairs).tolist() == want
    assert 10 < sum(want) < len(want) - 10


def test_altered_quotes_of_a_long_text_are_found_at_their_place(monkeypatch):
    """Few words make every run of four characters common; its place must not be searched for over the whole text."""
    rng, searched = random.Random(17), []
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    sentences = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 25))) for _ in range(500)]
    page, promising = LongText(" ".join(sentences)), LongText.promising
    monkeypatch.setattr(LongText, "promising", lambda self, quote: searched.append(quote) or promising(self, quote))
    quotes = [s[:5] + s[6:] for s in sentences]
    assert similar([(q, page) for q in quotes]).all() and len(searched) <= 5
    assert not similar([(" ".join(reversed(q.split())), page) for q in quotes[:40]]).any() and len(searched) > 30


def test_pages_holding_quotes_equal_brute_force():
    rng = random.Random(23)
    texts = ["".join(rng.choice("ab é語") for _ in range(n)) for n in (0, 5, 16, 300, 700)] + ["ab " * 400, "ab " * 400]
    quotes = [t[i: i + rng.randrange(8, 140)] for t in texts for i in range(0, max(len(t) - 8, 0), 9)]
    quotes = [q for q in quotes if len(q) >= 8] + [texts[4], texts[4] + "a", "ab " * 30, "b" * 40]
    site = Site([*range(len(texts))], [f"p{k}" for k in range(len(texts))], texts)
    want = {q: [k for k, t in enumerate(texts) if q in t] for q in quotes}
    assert site.holding(quotes + quotes[:50]) == {q: k for q, k in want.items() if k}
    asked = [(quotes[0], "p4", site), (quotes[0], None, site), (None, "p1", site), (quotes[0], "p1", None)]
    first = want[quotes[0]][0]
    assert find_pages(asked, False) == [("exact", 4 if 4 in want[quotes[0]] else first), ("exact", first), (None, None), (None, None)]


def test_facts_cross_to_their_scan_once(spark):
    """One exchange for the facts and one for the pages; all facts come out, with or without a scan's pages."""
    rows = spark.createDataFrame([(1, 1, "one two three four", "u", 7), (1, 2, "no", "u", 8), (2, 1, "one two three four", "u", 9), (None, None, "one two three four", "u", 10)],
                                 "scan_id long, fact_id long, evidence_quote string, source_url string, more int")
    page = spark.createDataFrame([(1, 0, "u", "Zero one, two: three four.")], "scan_id long, page_pos int, url string, text string")
    found = grounding.ground_facts(rows, page)
    assert found.columns == [*rows.columns, "matched_url", "grounding"]
    assert {(r.more, r.grounding, r.matched_url) for r in found.collect()} == {(7, "exact", "u"), (8, "none", None), (9, "none", None), (10, "none", None)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2


def test_grounding_order(spark):
    text = {
        "p1": "We opened the shop in 1985 and serve the whole valley with care.",
        "p2": "We opened the shop in 1985 and served the whole valley with care!",
        "p3": "Straße in Köln: unsere große Werkstatt.",
    }
    page_rows = spark.createDataFrame([(1, i, u, t) for i, (u, t) in enumerate(text.items())], "scan_id long, page_pos int, url string, text string")
    quotes = [
        (1, "opened the shop in 1985", "p2", "exact", "p2"),
        (2, "we opened the shop in 1985 and served the whole valley", "p1", "fuzzy", "p1"),  # fuzzy at the source beats exact elsewhere
        (3, "we opened the shop in 1986 and serve the whole valley", "p1", "none", None),  # another number
        (4, "the shop", "p1", "none", None),  # too short
        (5, "UNSERE GROSSE werkstatt", "p1", "exact", "p3"),
        (6, "we opened tho shop in 1985 and serve the whole valley", None, "fuzzy", "p1"),
        (7, "something that nobody has ever said here", "p9", "none", None),
    ]
    rows = spark.createDataFrame([(1, q[0], q[1], q[2]) for q in quotes], "scan_id long, fact_id long, evidence_quote string, source_url string")
    got = {r.fact_id: (r.grounding, r.matched_url) for r in grounding.ground_facts(rows, page_rows).collect()}
    assert got == {q[0]: (q[3], q[4]) for q in quotes}


def test_short_quotes_meet_few_texts(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(grounding, "stage", lambda df, path: kept.setdefault(path.rsplit("/", 1)[1], df.cache()))
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    docs = [(i, f"{x}nda the {y}vel. ui the {y}velorum so {x}on the {y}") for i, (x, y) in enumerate(zip(names, reversed(names)))]
    quotes = [(i, f"{x}nda the {y}") for i, (x, y) in enumerate(zip(names, reversed(names)))]
    quotes += [(200, "nda the akvel ui"), (201, "i the akvelor"), (202, "a the akveloru"), (203, "a the klvel or")]
    got = {r.quote_id: (r.n_docs, r.first_doc_id) for r in grounding.find_quotes(
        spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    plain = [t.replace(".", "") for _, t in docs]
    for i, q in quotes:
        hits = [d for d, t in enumerate(plain) if q in t] if len(q) >= 12 else []
        assert got[i] == (len(hits), min(hits, default=None)), (i, q)
    met = kept["rarest"].join(kept["hits"], "run").count()
    assert met < len(docs) ** 2 / 5  # by the word "the" alone every quote would meet every text


def test_find_quotes_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))) for i in range(60)]
    docs += [(100 + i, docs[0][1]) for i in range(20)]  # copies
    quotes = []
    for i in range(80):
        t = docs[rng.randrange(60)][1]
        s = rng.randrange(len(t))
        quotes.append((i, t[s: s + rng.randrange(6, 40)].strip() or "x"))
    quotes += [(200 + i, "alpha beta " + words[i]) for i in range(3)]
    from attesta.functions import text as X

    q = spark.createDataFrame(quotes, "quote_id long, quote string")
    ok = {r.quote_id for r in q.filter(X.quote_eligible(X.normalize(F.col("quote")))).collect()}
    got = {r.quote_id: (r.n_docs, r.first_doc_id) for r in grounding.find_quotes(q, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, quote in quotes:
        hits = [d for d, t in docs if quote in t] if i in ok else []
        assert got[i] == (len(hits), min(hits, default=None)), (i, quote)


def test_asof_equals_brute_force(spark):
    rng = random.Random(4)
    events = [(rng.randrange(3), rng.randrange(0, 400), i) for i in range(120)]
    requests = [(rng.randrange(4), rng.randrange(0, 400), 1000 + i) for i in range(200)]
    ev = spark.createDataFrame(events, "k long, event_us long, event_id long")
    rq = spark.createDataFrame(requests, "k long, at_us long, r long")
    for strict, inclusive in ((False, True), (True, False)):
        got = {x.r: x.event_id for x in asof.latest_within(rq, ev, ["k"], 25, 10, strict, inclusive).collect()}
        for k, at, r in requests:
            seen = [(t, i) for kk, t, i in events if kk == k and (t < at if strict else t <= at) and (at - t <= 25 if inclusive else at - t < 25)]
            assert got[r] == (max(seen)[1] if seen else None)


def test_note_rules(spark):
    offered = [(1, "Founded in 1985.", "since 1985"), (2, "Ten people.", "team of 10")]
    good = "We saw you began in 1985 [F1]. Your team is small [F2]. We like that. Could we talk?"
    cases = {
        good: ([1, 2], None), good + " ": ([2, 1, 2], None), good + "  ": ([1, 1], "fact_ids"), good + "   ": ([1, 7], "not_offered"),
        good.replace("1985", "1986"): ([1, 2], "figures"), good.replace("small", "worth a million"): ([1, 2], "figures"),
        good.replace(" [F2]", ""): ([1, 2], "markers"), "Since 1985 [F1] and [F2].": ([1, 2], "sentences"),
        "A [F1]. B [F2]. C. D. E. F.": ([1, 2], "sentences"), "A [Name] [F1]. B [F2]. C.": ([1, 2], "brackets"),
        good.replace("We like that", "5 of us") + "    ": ([1, 2], None)}
    df = spark.createDataFrame([(n, i, offered) for n, (i, _) in cases.items()],
                               "note string, fact_ids array<int>, offered array<struct<id:int,fact:string,evidence_quote:string>>")
    assert {r.note: r.problem for r in notes.note_problem(df).collect()} == {n: p for n, (_, p) in cases.items()}


def test_fact_dedupe_comes_first_and_ids_follow_rank(spark):
    place = lambda p, s, n: (p, s, n)
    rows = [
        (1, place(0, 0, 0), "other", "We have ten people.", "nowhere to be found here", "u", 0.9),
        (1, place(0, 1, 0), "other", "we have TEN people", "a team of ten people works", "u", 1.0),
        (1, place(0, 1, 1), "other", "Second statement", "a team of ten people works", "u", 0.2),
        (1, place(0, 1, 2), "other", "Third says 12", "a team of ten people works", "u", 0.9)]
    df = spark.createDataFrame(rows, "scan_id long, arrival struct<page:bigint,source:int,pos:bigint>, category string, fact string, evidence_quote string, source_url string, confidence double")
    page = spark.createDataFrame([(1, 0, "u", "Here a team of ten people works daily.")], "scan_id long, page_pos int, url string, text string")
    got = facts.page_facts(df, page).orderBy("id").collect()
    assert [(r.id, r.fact, r.grounding) for r in got] == [
        (1, "Second statement", "exact"), (2, "We have ten people.", "none"), (3, "Third says 12", "none")]


def test_robots(spark):
    body = "User-agent: bad\nUser-agent: worse\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\n"
    robots_rows = spark.createDataFrame(
        [("https://a.com", 200, body), ("https://b.com", 403, None), ("https://c.com", 500, None)], "origin string, status int, body string")
    rows = ["https://a.com/", "https://a.com/private/x", "https://a.com/private/ok/1", "https://a.com/x.pdf", "https://a.com/x.pdf?y", "https://b.com/", "https://c.com/private", "https://d.com/"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    got = {r.url: r.allowed for r in robots.robots_gate(df, robots_rows, "leadbot").collect()}
    assert [got[u] for u in rows] == [True, False, True, False, True, False, True, True]
    assert not any(r.allowed for r in robots.robots_gate(df.filter("url like 'https://a%'"), robots_rows, "Worse").collect())


def test_fetch_outcomes(spark):
    long = "t" * 100
    rows = [
        (1, True, True, None, None, None, long, None, "cached"), (2, False, False, None, None, None, None, None, "robots"),
        (3, True, False, 429, None, "text/html", None, long, "blocked"), (4, True, False, 410, None, "text/html", None, long, "not_found"),
        (5, True, False, 503, None, "text/html", None, long, "ok"), (6, True, False, 200, None, "text/html", "thin", "thin", "empty"),
        (7, True, False, 200, None, "image/png", long, None, "error"), (8, True, False, None, "ReadTimeout", None, None, None, "timeout"),
        (9, True, False, None, "ValueError", None, None, long, "error"), (10, True, False, 204, None, "text/html", None, long, "error"),
        (11, True, False, 200, None, "text/html", long, None, "ok")]
    df = spark.createDataFrame(rows, "id int, allowed boolean, cached boolean, status int, error string, content_type string, text string, archived_text string, want string")
    got = crawl.classify_fetches(df).collect()
    assert [(r.id, r.outcome) for r in got if r.outcome != r.want] == []
    assert {r.id: r.via for r in got if r.via == "wayback"} == {5: "wayback", 6: "wayback"}
    assert {r.id for r in got if r.kept_text} == {1, 5, 11}


def test_page_plan(spark):
    site = "https://a.com"
    def plan(links, sitemap=()):
        df = spark.createDataFrame([(site + "/", [site + x for x in links], [site + x for x in sitemap])], "home_url string, links array<string>, sitemap array<string>")
        return [u[len(site):] for u in pages.plan_pages(df).head().urls]

    assert plan([]) == ["/", "/about", "/team", "/careers", "/contact"]
    assert plan(["/logo.png", "/z", "/contact-us", "/our-story", "/y", "/x", "/w", "/v"]) == ["/", "/our-story", "/contact-us", "/z", "/y", "/x"]
    assert plan(["/about"], ["/about", "/company", "/jobs"]) == ["/", "/about", "/company", "/jobs"]


def test_presets_and_lookup(spark):
    from attesta.operators.criteria import compile_problem, needs_compile
    from attesta.operators.models import compile_criteria
    from attesta.sources.presets import lookup_profiles, preset_profiles

    presets = preset_profiles(spark)
    compiled = compile_criteria(presets)
    assert {r.name: 4 <= len(r.criteria) <= 8 for r in compiled.collect()} == {"Search-fund buy-box": True, "B2B sales ICP": True}
    state = compiled.withColumn("description_hash", F.lit(None).cast("string"))
    assert [tuple(r) for r in state.select(needs_compile(), compile_problem()).collect()] == [(True, "preset")] * 2
    stored = spark.createDataFrame([(1, "Search-fund buy-box"), (2, "B2B sales ICP"), (3, "7")], "profile_id long, profile_name string")
    asked = spark.createDataFrame([("buybox",), ("2",), ("B2B sales ICP",), ("7",), ("nobody",)], "wanted string")
    assert {r.wanted: r.profile_id for r in lookup_profiles(asked, stored).collect()} == {
        "buybox": 1, "2": 2, "B2B sales ICP": 2, "7": 3, "nobody": None}


def test_record_payloads(spark):
    from attesta.sources import records

    events = '{"events":[{"eventAction":"Registration","eventDate":"2001-02-03T00:00:00Z"},{"eventAction":"registration","eventDate":"2002-03-04"},{"eventAction":"expiration"}]}'
    d = spark.range(1).select(records.registration_dates(F.lit(events), F.to_date(F.lit("2025-01-01"))).alias("d")).head().d
    assert (d.ok, d.registered, d.expires, d.domain_age_years) == (True, "2002-03-04", None, 23)
    near = '{"archived_snapshots":{"closest":{"available":true,"url":"u","timestamp":"19990102030405"}}}'
    capture = lambda index, near: spark.range(1).select(records.first_capture(F.lit(index), F.lit(near)).alias("c")).head().c
    assert tuple(capture('[["timestamp"],["20050607080910"]]', near)) == ("2005-06-07", 2005, False)
    assert tuple(capture('[["timestamp"]]', near)) == ("1999-01-02", 1999, True)
    assert capture("[]", '{"archived_snapshots":{}}') is None


def test_new_texts_sort_one_row_per_span_and_equal_brute_force(spark):
    import datetime as dt

    from attesta.operators.cache import new_texts

    rng, day = random.Random(31), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), day + dt.timedelta(days=rng.randrange(0, 900, 3), seconds=rng.choice([0, 0, 1])), i)
            for i in range(300)]
    rows += [("a", "x", None, 900), ("a", "x", None, 901), ("c", "x", day, 950), ("c", "x", day + dt.timedelta(days=60), 951),
             ("d", "x", day, 960), ("d", "x", day + dt.timedelta(days=60, microseconds=1), 961)]
    found = new_texts(spark.createDataFrame(rows, "url string, content_hash string, ts timestamp, id long"))
    first = {}
    for url, text, ts, i in rows:
        if text is not None:
            first[url, text, ts] = min(i, first.get((url, text, ts), i))
    want = [i for (url, text, ts), i in first.items() if ts is None or not any(
        (u, t) == (url, text) and other is not None and other < ts <= other + dt.timedelta(days=60) for u, t, other in first)]
    assert found.columns == ["url", "content_hash", "ts", "id"]
    assert sorted(r.id for r in found.collect()) == sorted(want) and len(want) > 20
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
