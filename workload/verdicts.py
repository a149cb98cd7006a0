"""Verdict checks, prompts, notes, answers, scan details."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import answers as A
from attesta.operators import criteria as C
from attesta.operators import notes as N
from attesta.operators import prompts as R
from attesta.operators import verdicts as V
from workload import proxies as P

_RESULT = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = [*P.RESULT_ORDER, "l_quantity"]


def lines(spark, sf_dir, by_order=False):
    """One line per order and number, the last in write order; left dealt out by order if so asked."""
    line = P.table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int"))
    if by_order:
        line = line.select(*_RESULT, *_LINE_ORDER).repartition("l_orderkey")
    return line.groupBy(*_RESULT).agg(F.max(F.struct(*_LINE_ORDER)).alias("r")).select(*_RESULT, "r.*")


LINES_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC,
    l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC, l_quantity DESC) = 1),
facts AS (
  SELECT l_orderkey AS scan_id, l_linenumber AS id, CASE WHEN l_quantity < 10 THEN 'domain_record' ELSE 'other' END AS category,
         'part ' || l_partkey || ' costs ' || l_quantity AS fact, 'qty ' || l_quantity AS evidence_quote, 'p' || l_suppkey AS source_url,
         CASE WHEN l_quantity < 10 THEN 'record' WHEN l_linestatus = 'O' THEN 'exact' ELSE 'none' END AS grounding FROM lines),
offered AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY category <> 'domain_record', id) AS judge_pos FROM facts WHERE grounding <> 'none')"""


def stored_facts(spark, sf_dir, by_scan=False):
    n = F.col("l_quantity")
    return lines(spark, sf_dir, by_scan).select(
        F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("id"),
        F.when(n < 10, "domain_record").otherwise("other").alias("category"),
        F.concat(F.lit("part "), "l_partkey", F.lit(" costs "), n).alias("fact"),
        F.concat(F.lit("qty "), n).alias("evidence_quote"), F.concat(F.lit("p"), "l_suppkey").alias("source_url"),
        F.when(n < 10, "record").when(F.col("l_linestatus") == "O", "exact").otherwise("none").alias("grounding"))


def _criteria(spark):
    return P.profiles(spark).select("profile_id", F.posexplode("criteria").alias("pos", "c")).select(
        "profile_id", "pos", F.col("c.key").alias("criterion_key"), "c.label", "c.weight", "c.polarity", "c.test")


def _judgments(spark, sf_dir):
    """A line judges its own criterion, citing the fact after it, its own and one that may be absent."""
    k = F.col("l_linenumber")
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("scan_id"), k.alias("judgment_pos"), F.concat(F.lit("c"), k).alias("criterion_key"),
        F.when(F.col("l_returnflag") == "A", "met").when(F.col("l_returnflag") == "N", "not_met").otherwise("unknown").alias("verdict"),
        F.array(k + 1, k, F.lit(3)).alias("fact_ids"), F.concat(F.lit("because "), "l_partkey").alias("reasoning"))


def _checked(spark, sf_dir):
    offered = V.facts_to_judge(stored_facts(spark, sf_dir))
    return V.check_verdicts(P.scans(spark, sf_dir), _criteria(spark), _judgments(spark, sf_dir), offered)


def verdict_check(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "scan_id", "criterion_key", "verdict", F.array_join("fact_ids", ",").alias("fact_ids"), "reasoning",
        "evidence_quote", "source_url", "grounding")


def judge_prompt(spark, sf_dir):
    scans = P.scans(spark, sf_dir).select(
        "scan_id", "profile_id", F.concat(F.lit("Firm "), "company_id").alias("name"),
        F.concat(F.lit("firm"), "company_id", F.lit(".example.com")).alias("domain"),
        F.lit(None).cast("string").alias("pages"), F.lit("domain registered 1999-01-01").alias("records"))
    asked = R.judge_requests(scans, _criteria(spark), V.facts_to_judge(stored_facts(spark, sf_dir)))
    return asked.select("scan_id", "request")


def note_prompt(spark, sf_dir):
    checked = _checked(spark, sf_dir)
    cited = checked.select("scan_id", F.explode("fact_ids").alias("id"))
    to_cite = N.facts_to_cite(stored_facts(spark, sf_dir), cited)
    met = checked.filter(F.col("verdict") == "met").select("scan_id", "criterion_key", "pos")
    scans = P.scans(spark, sf_dir).select(
        "scan_id", F.concat(F.lit("Profile "), "profile_id").alias("profile_name"), F.lit(None).cast("string").alias("name"),
        F.concat(F.lit("firm"), "company_id", F.lit(".example.com")).alias("domain"), F.lit("").alias("feedback"))
    return R.note_requests(scans, met, to_cite).select("scan_id", "request")


def _many_facts(spark, sf_dir):
    """A customer's lines as the facts of one scan: more than are ever offered."""
    owner = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey"))
    return stored_facts(spark, sf_dir).join(owner, "scan_id").select(
        F.col("o_custkey").alias("scan_id"), (F.col("scan_id") * 8 + F.col("id")).alias("id"), "category", "fact", "evidence_quote", "grounding")


def offered_to_judge(spark, sf_dir):
    """Which facts of a long list the judge is offered: thirty at most."""
    return V.facts_to_judge(_many_facts(spark, sf_dir)).select("scan_id", "id", "judge_pos")


def offered_to_note(spark, sf_dir):
    """Which facts of a long list a note may cite: twelve at most, cited ones first."""
    facts = _many_facts(spark, sf_dir)
    return N.facts_to_cite(facts, facts.filter("id % 8 = 2").select("scan_id", "id")).select("scan_id", "id", "note_pos")


def extract_prompt(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("scan_id"), F.col("source").alias("domain"), F.concat(F.lit("d"), "doc_id").alias("url"), "text")
    return R.extract_requests(docs).select("scan_id", "request")


def note_gate(spark, sf_dir):
    verdicts = _checked(spark, sf_dir).join(_criteria(spark).select("profile_id", "criterion_key", "polarity"), ["profile_id", "criterion_key"])
    return N.note_gate(P.scans(spark, sf_dir), verdicts, stored_facts(spark, sf_dir))


def note_validation(spark, sf_dir):
    """Assistant turns as drafts. Markers, figures and citations vary with the turn's own text."""
    c = P.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    text, size = F.col("text"), F.length("text")
    note = F.concat(
        text, F.when(size < 300, F.lit(" Since 1985 it grew")).otherwise(F.lit("")),
        F.when(text.contains("é"), F.lit(" with 77 people")).otherwise(F.lit("")),
        F.when(text.contains("nd"), F.lit(" [F1]")).otherwise(F.lit(" [F2]")), F.lit(" and [F2]."),
        F.when(size > 700, F.lit(" [Name]")).otherwise(F.lit("")))
    ids = (
        F.when(text.startswith("A"), F.array(F.lit(1), F.lit(1))).when(text.startswith("E"), F.array(F.lit(1), F.lit(9)))
        .otherwise(F.array(F.lit(2), F.lit(1), F.lit(2))))
    fact = lambda n, said, quote: F.struct(F.lit(n).alias("id"), F.lit(said).alias("fact"), F.lit(quote).alias("evidence_quote"))
    drafts = c.select("conv_id", "turn", note.alias("note"), ids.alias("fact_ids"), F.array(
        fact(1, "Founded in 1985.", "since 1985"), fact(2, "It has a team.", "our team"), fact(3, "77 people", "77")).alias("offered"))
    return N.note_problem(drafts).select("conv_id", "turn", "problem", N.feedback(F.col("problem")).alias("feedback"))


def response_parse(spark, sf_dir):
    """Answers built from lines, some malformed or outside their limits: how many of each kind."""
    line = P.table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    judgment = F.struct(F.concat(F.lit("c"), n).alias("criterion_key"),
                        F.when(q > 40, "maybe").otherwise("met").alias("verdict"), F.array(n).alias("fact_ids"), F.lit("r").alias("reasoning"))
    judged = F.when(q < 5, F.lit("{oops")).otherwise(F.to_json(F.struct(F.array(judgment).alias("judgments"))))
    criterion = F.struct(F.lit("k").alias("key"), F.lit("l").alias("label"), (F.col("l_tax") * 100).cast("int").cast("string").alias("weight"),
                         F.lit("t").alias("test"), F.when(F.col("l_linestatus") == "O", "positive").otherwise("neutral").alias("polarity"))
    criteria = F.to_json(F.struct(F.array_repeat(criterion, n + 2).alias("criteria")))
    facts = F.to_json(F.struct(F.array_repeat(F.struct(F.lit("hiring").alias("category"), F.lit("f").alias("fact"), F.lit("q").alias("evidence_quote"),
                                                       (q / 30.0).alias("confidence")), n * 4).alias("facts")))
    note = F.when(q < 25, F.lit('{"note": "n", "fact_ids": [1, 2]}')).otherwise(F.lit('{"note": "n"}'))
    rows = None
    for kind, answer in (("judgments", judged), ("criteria", criteria), ("facts", facts), ("note", note)):
        part = A.parse_answers(line.select(answer.alias("answer")), kind).groupBy(F.lit(kind).alias("kind"), "problem").agg(
            F.count("*").alias("n"), F.count("parsed").alias("accepted"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def error_class(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    message = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "quota exceeded for model").when(F.col("o_orderpriority") == "2-HIGH", "Error 429")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "model is Overloaded").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.when(F.col("o_custkey") % 3 == 0, "ReadTimeout: no answer").when(
            F.col("o_custkey") % 3 == 1, "httpx.ConnectError: refused").otherwise(F.lit("ValueError: bad answer, no timeout"))))
    code = F.when(F.col("o_totalprice") > 300000, 503).otherwise(200)
    return o.select("o_orderkey", A.error_class(message, code).alias("error_class"))


def scan_status(spark, sf_dir):
    """Scans end as done or error; those that failed keep the facts stored before."""
    o = P.table(spark, sf_dir, "orders")
    error = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("TimeoutError: "), F.repeat(F.col("o_orderpriority"), 100)))
    status, text = A.scan_status(error)
    kept = stored_facts(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("n_facts"))
    return (
        o.select(F.col("o_orderkey").alias("scan_id"), status.alias("status"), text.alias("error"))
        .join(kept, "scan_id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0))))


def scan_detail(spark, sf_dir):
    results = P.results(spark, sf_dir, "verdict", "source_url", "grounding", "result_pos").withColumn(
        "criterion_key", F.when(F.col("criterion_key") == "c5", "retired").otherwise(F.col("criterion_key")))
    detail = V.scan_details(
        P.scans(spark, sf_dir), P.profiles(spark), _criteria(spark), P.companies(spark, sf_dir), results, stored_facts(spark, sf_dir))
    shown = F.transform("criteria", lambda c: F.concat_ws("|", c["label"], c["weight"].cast("string"), c["polarity"], c["verdict"]))
    return detail.select(
        "scan_id", "profile_name", F.col("company.name").alias("company"), F.array_join(shown, ";").alias("criteria"),
        F.array_join("red_flags", ";").alias("red_flags"), "n_facts", "n_grounded", "note_status")


def fact_display_ids(spark, sf_dir):
    facts = stored_facts(spark, sf_dir).filter(F.col("grounding") != "record")
    return V.numbered_facts(facts).select("scan_id", "id", "display_id")


def _raw_criteria(spark, sf_dir):
    """Customers as profiles whose raw criteria repeat keys, collide and hold odd weights."""
    c = lambda key, label, weight, polarity: F.struct(
        key.alias("key"), label.alias("label"), weight.alias("weight"), F.lit(" Does it? ").alias("test"), polarity.alias("polarity"))
    none, empty = F.lit(None).cast("string"), F.lit("")
    seg = F.col("c_mktsegment")
    raw = F.array(
        c(seg, none, F.lit("9"), F.lit("Negative")), c(F.lower(seg), F.lit(" Given "), F.lit("x"), none),
        c(empty, F.concat(seg, F.lit(" 2")), F.lit("3"), empty), c(none, none, none, F.lit("positive")),
        c(F.concat(F.lit("--"), seg, F.lit("!")), none, F.lit("0"), F.lit("negative")), c(F.lit("a"), none, F.lit("-4"), empty),
        c(F.lit("A"), none, F.lit("4"), empty), c(F.lit("a_2"), none, F.lit("2"), empty), c(F.lit("ninth"), none, F.lit("1"), empty))
    # much work a row, while a file of them may have one split: they are dealt out
    dealt = P.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition("c_custkey", "c_name")
    return dealt.select(F.col("c_custkey").alias("profile_id"), "c_name", "c_acctbal", "c_mktsegment", raw.alias("raw"))


def criteria_clean(spark, sf_dir):
    cleaned = _raw_criteria(spark, sf_dir).select("profile_id", F.posexplode(C.clean_criteria(F.col("raw"))).alias("pos", "c"))
    return cleaned.select("profile_id", "pos", "c.*")


def profile_update(spark, sf_dir):
    """Customers as profiles, a batch of edits from their own columns."""
    from attesta.functions.text import description_hash

    rows = _raw_criteria(spark, sf_dir)
    preset = F.when(F.col("c_acctbal") > 9000, F.lit("B2B sales ICP")).otherwise(F.col("c_name"))
    one = F.slice(C.clean_criteria(F.col("raw")), 1, 1)
    profiles = rows.select(
        "profile_id", preset.alias("name"), F.col("c_mktsegment").alias("description_text"),
        description_hash(F.col("c_mktsegment")).alias("description_hash"),
        F.when(F.col("c_acctbal") > 0, one).otherwise(F.slice(one, 1, 0)).alias("criteria"))
    edits = rows.filter(F.col("c_acctbal") > 1000).select(
        "profile_id", F.concat(F.lit("  Renamed "), "profile_id", F.lit(" ")).alias("new_name"),
        F.when(F.col("c_acctbal") > 3000, F.lit(" New text ")).alias("new_description"),
        F.when(F.col("c_acctbal") > 8000, F.slice("raw", 1, 0)).when(F.col("c_acctbal") > 5000, F.col("raw")).alias("new_criteria"))
    updated = C.update_profiles(profiles, edits)
    return updated.select(
        "profile_id", "name", "description_text", "problem", F.size("criteria").alias("n_criteria"),
        C.needs_compile().alias("needs_compile"), C.compile_problem().alias("compile_problem"))


def profile_create(spark, sf_dir):
    """Orders as requests for profiles named after a priority and a status; some names are taken."""
    o = P.table(spark, sf_dir, "orders")
    name = F.when(F.col("o_totalprice") < 1500, F.lit("  ")).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" ")))
    requests = o.select(F.col("o_orderkey").alias("request_id"), name.alias("name"), F.lit(" d ").alias("description_text"))
    taken = o.filter(F.col("o_orderstatus") == "P").select(F.concat("o_orderpriority", F.lit(" P")).alias("name")).distinct()
    return C.new_profiles(requests, taken).select("name", "request_id", "description_text")


QUERIES = {
    f.__name__: f
    for f in (verdict_check, judge_prompt, note_prompt, offered_to_judge, offered_to_note, extract_prompt, note_gate, note_validation, response_parse, error_class,
              scan_status, scan_detail, fact_display_ids, criteria_clean, profile_update, profile_create)
}

_CHECKED_SQL = f"""{P.CRITERIA_SQL}, {P.SCANS_SQL}, {LINES_SQL},
cites AS (
  SELECT l_orderkey AS scan_id, l_linenumber AS n, unnest([l_linenumber + 1, l_linenumber, 3]) AS id, unnest([0, 1, 2]) AS cp FROM lines),
kept AS (
  SELECT c.scan_id, n, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY cp) AS ids, list(c.id ORDER BY cp) AS id_list, arg_min(o.evidence_quote, cp) AS quote,
         arg_min(o.source_url, cp) AS url, arg_min(o.grounding, cp) AS g
  FROM cites c JOIN offered o ON o.scan_id = c.scan_id AND o.id = c.id GROUP BY ALL),
judged AS (
  SELECT l_orderkey AS scan_id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'met' WHEN 'N' THEN 'not_met' ELSE 'unknown' END AS v, 'because ' || l_partkey AS why FROM lines),
base AS (
  SELECT s.scan_id, s.profile_id, c.key AS criterion_key, c.pos, c.polarity, s.no_evidence_reason AS r, j.v, j.why, k.ids, k.id_list, k.quote, k.url, k.g,
         s.no_evidence_reason IS NOT NULL OR s.scan_id NOT IN (SELECT scan_id FROM offered) AS skipped
  FROM scans s JOIN criteria c USING (profile_id) LEFT JOIN judged j ON j.scan_id = s.scan_id AND j.n = c.pos
  LEFT JOIN kept k ON k.scan_id = s.scan_id AND k.n = c.pos),
checked AS (
  SELECT scan_id, profile_id, criterion_key, pos, polarity, CASE WHEN NOT skipped AND v IS NOT NULL AND (v = 'unknown' OR ids IS NOT NULL) THEN v ELSE 'unknown' END AS verdict,
         CASE WHEN skipped OR v IS NULL THEN '' ELSE coalesce(ids, '') END AS fact_ids, CASE WHEN skipped OR v IS NULL THEN [] ELSE id_list END AS id_list,
         CASE WHEN r IS NOT NULL THEN 'Site returned almost no readable text.' WHEN skipped THEN 'No verified facts available.' WHEN v IS NULL THEN 'Not judged.'
              WHEN v <> 'unknown' AND ids IS NULL THEN 'Downgraded: no verified fact cited. (' || why || ')' ELSE why END AS reasoning,
         CASE WHEN NOT skipped AND v IS NOT NULL THEN quote END AS evidence_quote, CASE WHEN NOT skipped AND v IS NOT NULL THEN url END AS source_url,
         CASE WHEN NOT skipped AND v IS NOT NULL THEN coalesce(g, 'none') ELSE 'none' END AS grounding
  FROM base)"""
_CRIT_LINES = """crit AS (SELECT profile_id, string_agg('- ' || key || ' (weight ' || weight || ', ' || polarity || '): ' || test, chr(10) ORDER BY pos) AS cl FROM criteria GROUP BY 1)"""
_CLEAN = """
k AS (SELECT c_custkey AS profile_id, lower(c_mktsegment) AS s, c_mktsegment AS seg FROM customer)"""

ORACLE = {
    "verdict_check": f"WITH {_CHECKED_SQL} SELECT scan_id, criterion_key, verdict, fact_ids, reasoning, evidence_quote, source_url, grounding FROM checked",
    "judge_prompt": f"""WITH {P.CRITERIA_SQL}, {P.SCANS_SQL}, {LINES_SQL}, {_CRIT_LINES},
      fl AS (SELECT scan_id, string_agg(concat_ws(' | ', id, category, fact, '"' || evidence_quote || '"', source_url), chr(10) ORDER BY judge_pos) AS l FROM offered WHERE judge_pos <= 30 GROUP BY 1)
      SELECT scan_id, '# Business' || chr(10) || 'Firm ' || company_id || ', firm' || company_id || '.example.com' || chr(10) || '# Addresses read' || chr(10) || '-' || chr(10)
        || '# Public records' || chr(10) || 'domain registered 1999-01-01' || chr(10) || '# To decide' || chr(10) || cl || chr(10)
        || '# Known facts by id' || chr(10) || l AS request
      FROM scans JOIN fl USING (scan_id) JOIN crit USING (profile_id)""",
    "note_prompt": f"""WITH {_CHECKED_SQL},
      c AS (SELECT DISTINCT scan_id, unnest(id_list) AS id FROM checked),
      o AS (SELECT f.*, row_number() OVER (PARTITION BY f.scan_id ORDER BY c.id IS NULL, f.id) AS p FROM facts f LEFT JOIN c ON c.scan_id = f.scan_id AND c.id = f.id WHERE grounding <> 'none'),
      fl AS (SELECT scan_id, string_agg(concat_ws(' | ', id, fact, '"' || evidence_quote || '"', source_url), chr(10) ORDER BY p) AS l FROM o WHERE p <= 12 GROUP BY 1),
      m AS (SELECT scan_id, string_agg(criterion_key, ', ' ORDER BY pos) AS met FROM checked WHERE verdict = 'met' GROUP BY 1)
      SELECT scan_id, '# Addressee' || chr(10) || 'firm' || company_id || '.example.com, firm' || company_id || '.example.com' || chr(10) || '# Written for' || chr(10) || 'Profile ' || profile_id || chr(10)
        || '# Fulfilled' || chr(10) || coalesce(met, '-') || chr(10) || '# Citable facts by id' || chr(10) || l AS request
      FROM scans JOIN fl USING (scan_id) LEFT JOIN m USING (scan_id)""",
    "offered_to_judge": f"""WITH {LINES_SQL},
      m AS (SELECT o_custkey AS scan_id, scan_id * 8 + id AS id, category, grounding FROM facts JOIN orders ON o_orderkey = scan_id)
      SELECT scan_id, id, CAST(p AS INTEGER) AS judge_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY category <> 'domain_record', id) AS p FROM m WHERE grounding <> 'none') WHERE p <= 30""",
    "offered_to_note": f"""WITH {LINES_SQL},
      m AS (SELECT o_custkey AS scan_id, scan_id * 8 + id AS id, grounding FROM facts JOIN orders ON o_orderkey = scan_id)
      SELECT scan_id, id, CAST(p AS INTEGER) AS note_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY id % 8 <> 2, id) AS p FROM m WHERE grounding <> 'none') WHERE p <= 12""",
    "extract_prompt": """SELECT doc_id AS scan_id, 'Site ' || source || ', address d' || doc_id || chr(10) || '--- begin page ---' || chr(10) || text
        || chr(10) || '--- end page ---' AS request FROM documents""",
    "note_gate": f"""WITH {_CHECKED_SQL},
      fl AS (SELECT scan_id, bool_or(polarity = 'negative' AND verdict = 'met') AS f FROM checked GROUP BY 1),
      g AS (SELECT scan_id, count(*) FILTER (grounding <> 'none') AS n FROM facts GROUP BY 1)
      SELECT scan_id, CASE WHEN no_evidence_reason IS NOT NULL THEN 'skipped' WHEN f THEN 'red_flag' WHEN coalesce(n, 0) < 2 THEN 'skipped' ELSE 'write' END AS gate
      FROM scans LEFT JOIN fl USING (scan_id) LEFT JOIN g USING (scan_id)""",
    "note_validation": rf"""
      WITH a AS (SELECT *, text || CASE WHEN length(text) < 300 THEN ' Since 1985 it grew' ELSE '' END || CASE WHEN contains(text, 'é') THEN ' with 77 people' ELSE '' END
                   || '  and .' || CASE WHEN length(text) > 700 THEN ' [Name]' ELSE '' END AS body FROM conversations WHERE role = 'assistant'),
      b AS (SELECT *, len([s FOR s IN regexp_split_to_array(body, '[.!?]') IF trim(s, ' ' || chr(10)) <> '']) AS n FROM a),
      p AS (SELECT conv_id, turn, CASE WHEN starts_with(text, 'A') THEN 'fact_ids' WHEN starts_with(text, 'E') THEN 'not_offered'
                WHEN contains(text, 'é') THEN 'figures' WHEN NOT contains(text, 'nd') THEN 'markers' WHEN n < 3 OR n > 5 THEN 'sentences'
                WHEN contains(body, '[') OR contains(body, ']') THEN 'brackets' END AS problem FROM b)
      SELECT *, CASE problem {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FEEDBACK.items())} END AS feedback FROM p""",
    "response_parse": """
      WITH l AS (SELECT CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n, CAST(l_tax * 100 AS DOUBLE) AS tax, l_linestatus AS s FROM lineitem),
      p AS (
        SELECT 'judgments' AS kind, CASE WHEN q < 5 THEN 'malformed' WHEN q > 40 THEN 'verdict' END AS problem FROM l
        UNION ALL SELECT 'criteria', CASE WHEN n + 2 NOT BETWEEN 4 AND 8 THEN 'count' WHEN trunc(tax) NOT BETWEEN 1 AND 5 THEN 'weight' WHEN s <> 'O' THEN 'polarity' END FROM l
        UNION ALL SELECT 'facts', CASE WHEN n * 4 > 20 THEN 'count' WHEN q > 30 THEN 'confidence' END FROM l
        UNION ALL SELECT 'note', CASE WHEN q >= 25 THEN 'malformed' END FROM l)
      SELECT kind, problem, count(*) AS n, count(*) FILTER (problem IS NULL) AS accepted FROM p GROUP BY ALL""",
    "error_class": """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
        WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_totalprice > 300000 OR o_custkey % 3 < 2 THEN 'transient' ELSE 'genuine' END AS error_class FROM orders""",
    "scan_status": f"""WITH {LINES_SQL}, n AS (SELECT scan_id, count(*) AS n FROM facts GROUP BY 1)
      SELECT o_orderkey AS scan_id, CASE WHEN o_orderstatus = 'O' THEN 'error' ELSE 'done' END AS status,
             CASE WHEN o_orderstatus = 'O' THEN left('TimeoutError: ' || repeat(o_orderpriority, 100), 500) END AS error, coalesce(n, 0) AS n_facts
      FROM orders LEFT JOIN n ON scan_id = o_orderkey""",
    "scan_detail": f"""WITH {P.CRITERIA_SQL}, {P.SCANS_SQL}, {P.COMPANIES_SQL}, {P.RESULTS_SQL}, {LINES_SQL},
      m AS (SELECT r.scan_id, r.result_pos, r.verdict, coalesce(c.label, 'retired') AS label, coalesce(c.weight, 1) AS weight, coalesce(c.polarity, 'positive') AS polarity
            FROM results r JOIN scans s USING (scan_id) LEFT JOIN criteria c ON c.profile_id = s.profile_id AND c.key = r.criterion_key AND c.key <> 'c5'),
      a AS (SELECT scan_id, string_agg(label || '|' || weight || '|' || polarity || '|' || verdict, ';' ORDER BY result_pos) AS criteria,
              coalesce(string_agg(label, ';' ORDER BY result_pos) FILTER (polarity = 'negative' AND verdict = 'met'), '') AS flags FROM m GROUP BY 1),
      g AS (SELECT scan_id, count(*) AS n, count(*) FILTER (grounding <> 'none') AS ok FROM facts GROUP BY 1)
      SELECT s.scan_id, 'Profile ' || s.profile_id AS profile_name, c.name AS company, a.criteria, coalesce(flags, '') AS red_flags, coalesce(n, 0) AS n_facts, coalesce(ok, 0) AS n_grounded,
             CASE WHEN coalesce(outreach_note, '') <> '' THEN 'ok' WHEN coalesce(flags, '') <> '' THEN 'red_flag'
                  WHEN no_evidence_reason IS NOT NULL OR coalesce(ok, 0) < 2 THEN 'skipped' ELSE 'unverified' END AS note_status
      FROM scans s LEFT JOIN companies c ON c.id = s.company_id LEFT JOIN a USING (scan_id) LEFT JOIN g USING (scan_id)""",
    "fact_display_ids": f"""WITH {LINES_SQL} SELECT scan_id, id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY id) AS INTEGER) AS display_id
      FROM facts WHERE grounding <> 'record'""",
    "criteria_clean": f"""WITH {_CLEAN}
      SELECT profile_id, CAST(unnest(range(8)) AS INTEGER) AS pos,
             unnest([s, s || '_2', s || '_2_2', 'criterion', s || '_3', 'a', 'a_2', 'a_2_2']) AS key,
             unnest([s, 'Given', seg || ' 2', 'criterion', s || ' 3', 'a', 'a 2', 'a 2 2']) AS label,
             CAST(unnest([5, 1, 3, 1, 1, 1, 4, 2]) AS INTEGER) AS weight, 'Does it?' AS test,
             unnest(['negative', 'positive', 'positive', 'positive', 'negative', 'positive', 'positive', 'positive']) AS polarity FROM k""",
    "profile_update": """
      WITH t AS (SELECT c_custkey AS id, c_acctbal AS b, c_mktsegment AS seg, CASE WHEN c_acctbal > 9000 THEN 'B2B sales ICP' ELSE c_name END AS nm FROM customer),
      u AS (SELECT *, CASE WHEN b > 9000 THEN 'preset' WHEN b > 8000 THEN 'criteria cannot be empty' END AS problem FROM t),
      v AS (SELECT *, b > 1000 AND problem IS NULL AS ok FROM u)
      SELECT id AS profile_id, CASE WHEN ok THEN 'Renamed ' || id ELSE nm END AS name, CASE WHEN ok AND b > 3000 THEN 'New text' ELSE seg END AS description_text,
             problem, CAST(CASE WHEN ok AND b > 5000 THEN 8 WHEN b > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_criteria,
             b <= 0 OR (ok AND b > 3000 AND b <= 5000) AS needs_compile, CASE WHEN b > 9000 THEN 'preset' END AS compile_problem FROM v""",
    "profile_create": """
      WITH r AS (SELECT o_orderkey AS request_id, o_orderpriority || ' ' || o_orderstatus AS name FROM orders WHERE o_totalprice >= 1500)
      SELECT name, min(request_id) AS request_id, 'd' AS description_text FROM r WHERE NOT ends_with(name, ' P') GROUP BY name""",
}
