"""Signals, fact tables, record facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import facts as T
from attesta.operators.signals import signal_facts as find_signals
from attesta.sources import records as R
from workload import grounding as G
from workload import proxies as P
from workload.grounding import ALTERED_SQL, SETTLED_SQL
from workload.texts import SENTENCES_SQL, norm_sql


def _company_pages(spark, sf_dir):
    """Documents followed by statements about a company, made from the document's own columns."""
    n = F.col("doc_id")
    text = F.concat(
        F.col("text"), F.lit("\nFamily owned and operated since "), (1950 + n % 70).cast("string"),
        F.lit(", serving all. Over "), (10 + n % 80).cast("string"), F.lit(" years of experience! It is a leading brand of Holding"),
        n.cast("string"), F.lit(" Services LLC., which sells; Acme is a wholly-owned subsidiary of "), F.initcap("source"),
        F.lit(" Inc and more? Owned by John Smith. In 2021 it was acquired by Blue"), F.col("n_chars").cast("string"),
        F.lit(" Capital Partners.\nFrom company-owned locations across the "), F.upper("lang"),
        F.lit(" region. An independently owned and operated franchise, founded in 1988. They came since 1999. Est. 2001 by us. Since 2002 too. Since 2003 too."))
    return P.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("https://d"), n.cast("string"), F.lit("/")).alias("url"), text.alias("text"))


def signal_facts(spark, sf_dir):
    return find_signals(_company_pages(spark, sf_dir)).drop("url")


def fact_rows(spark, sf_dir):
    """Signals and answered facts of each document, in arrival order per scan."""
    pages = _company_pages(spark, sf_dir).withColumnsRenamed({"doc_id": "scan_id"}).withColumn("page_pos", F.lit(0))
    docs = P.table(spark, sf_dir, "documents")
    fact = lambda category, said, quote, conf: F.struct(
        category.alias("category"), said.alias("fact"), quote.alias("evidence_quote"), conf.alias("confidence"))
    sure = F.when(F.col("doc_id") % 13 == 5, F.lit(1.5)).otherwise(F.lit(0.5))  # out of range: the answer is refused
    first = fact(F.when(F.col("lang") == "en", "hiring").otherwise(F.lit("gossip")), F.col("text"), F.col("text"), sure)
    second = fact(F.lit("team_size"), F.lit("Ten people work here."), F.when(F.col("lang") == "de", "").otherwise(F.lit(" ten of us ")), F.lit(1.0))
    copies = F.when(F.col("doc_id") % 11 == 3, 20).when(F.col("doc_id") % 11 == 4, 19).otherwise(1)  # 21 facts are too many, 20 are not
    answer = F.to_json(F.struct(F.concat(F.array(first), F.array_repeat(second, copies)).alias("facts")))
    answered = T.answered_facts(docs.select(
        F.col("doc_id").alias("scan_id"), F.lit(0).alias("page_pos"), F.concat(F.lit("https://d"), "doc_id", F.lit("/")).alias("url"),
        F.when(F.col("n_chars") < 100, F.lit("{broken")).otherwise(answer).alias("answer")))
    rows = T.raw_facts(find_signals(pages), answered)
    return rows.groupBy("scan_id", "category", F.col("arrival.source").alias("source")).agg(
        F.count("*").alias("n"), F.max(F.length("fact")).alias("longest_fact"),
        F.max(F.length("evidence_quote")).alias("longest_quote"), F.min("arrival.pos").alias("first_pos"))


def _site_facts(spark, sf_dir):
    """Sentences as facts of their page; some statements carry a number that the quote lacks, and
    every third quote is altered."""
    said = F.when(F.col("sentence_pos") % 5 == 0, F.concat("evidence_quote", F.lit(" 42"))).otherwise(F.col("evidence_quote"))
    quote = F.when(F.col("sentence_pos") % 3 == 1, G.altered(F.col("evidence_quote"), F.col("sentence_pos"))).otherwise(F.col("evidence_quote"))
    page = F.col("doc_id") % G.PAGES_PER_SITE
    return G.quoted_facts(spark, sf_dir).withColumns({
        "evidence_quote": quote, "source_url": F.concat(F.lit("d"), "doc_id")}).select(
        "scan_id", F.lit("other").alias("category"), said.alias("fact"), "evidence_quote", "source_url",
        ((F.length("evidence_quote") % 10) / 10).alias("confidence"),
        F.struct(page.alias("page"), F.lit(1).alias("source"), F.col("sentence_pos").cast("bigint").alias("pos")).alias("arrival"))


def fact_rank(spark, sf_dir):
    """Deduplicated, grounded and ranked facts of every site; forty each are kept."""
    return T.page_facts(_site_facts(spark, sf_dir), G.site_pages(spark, sf_dir)).select(
        "scan_id", "id", "fact", "source_url", "confidence", "grounding")


def grounding_counts(spark, sf_dir):
    """Lines as facts of their order."""
    line = P.table(spark, sf_dir, "lineitem")
    state = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "exact").when(F.col("l_returnflag") == "A", "fuzzy")
        .when(F.col("l_returnflag") == "N", "record").otherwise("none"))
    return T.grounding_counts(line.select(F.col("l_orderkey").alias("scan_id"), state.alias("grounding")))


def record_facts(spark, sf_dir):
    """Every order as a scan: its date is the registration, its capture exact or approximate."""
    o = P.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    events = F.concat(F.lit('{"events":[{"eventAction":"registration","eventDate":"'), day, F.lit('"}]}'))
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    index = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit('[["timestamp"],["'), stamp, F.lit('"]]')))
    near = F.when(F.col("o_totalprice") > 100000, F.concat(
        F.lit('{"archived_snapshots":{"closest":{"available":true,"timestamp":"'), stamp, F.lit('"}}}')))
    domain = F.concat(F.lit("shop"), F.col("o_custkey").cast("string"), F.lit(".example.com"))
    scans = o.select(
        F.col("o_orderkey").alias("scan_id"), domain.alias("domain"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("n_facts"),
        F.when(F.col("o_orderstatus") != "P", R.registration_dates(events, F.to_date(F.lit("2003-01-01")))).alias("rdap"),
        R.first_capture(index, near).alias("wayback"),
        R.registration_source(domain).alias("rdap_source"), R.archive_source(domain).alias("wayback_source"))
    return T.record_facts(scans)


QUERIES = {f.__name__: f for f in (signal_facts, fact_rows, fact_rank, grounding_counts, record_facts)}

_SIGNALS = """
raw AS (
  SELECT doc_id, lang, 1950 + doc_id % 70 AS y, 10 + doc_id % 80 AS e, upper(source[1]) || source[2:] AS org, n_chars FROM documents),
wanted AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS signal_pos, category, fact, evidence_quote FROM (
    SELECT doc_id, unnest([
      {'pos': 0, 'category': 'affiliations', 'fact': 'The company describes itself as a brand of Holding' || doc_id || ' Services LLC.',
       'evidence_quote': 'It is a leading brand of Holding' || doc_id || ' Services LLC., which sells; Acme is a wholly-owned subsidiary of ' || org || ' Inc and more?'},
      {'pos': 1, 'category': 'affiliations', 'fact': 'The company states it is acquired by Blue' || n_chars || ' Capital Partners.',
       'evidence_quote': 'In 2021 it was acquired by Blue' || n_chars || ' Capital Partners.'},
      {'pos': 2, 'category': 'affiliations', 'fact': 'The company operates company-owned locations across the ' || upper(lang) || ' region.',
       'evidence_quote': 'From company-owned locations across the ' || upper(lang) || ' region.'},
      {'pos': 3, 'category': 'affiliations', 'fact': 'The company describes itself as a franchise or franchisee.',
       'evidence_quote': 'An independently owned and operated franchise, founded in 1988.'},
      {'pos': 4, 'category': 'ownership_leadership', 'fact': 'The company describes itself as family owned.',
       'evidence_quote': 'Family owned and operated since ' || y || ', serving all.'},
      {'pos': 5, 'category': 'founding_history', 'fact': 'The page states the business has operated since 2001.', 'evidence_quote': 'Est. 2001 by us.'},
      {'pos': 6, 'category': 'founding_history', 'fact': 'The page states the business has operated since 2002.', 'evidence_quote': 'Since 2002 too.'},
      {'pos': 7, 'category': 'founding_history', 'fact': 'The page mentions ' || e || '+ years of business or experience.',
       'evidence_quote': 'Over ' || e || ' years of experience!'}], recursive := true) FROM raw))"""

ORACLE = {
    "signal_facts": f"WITH {_SIGNALS} SELECT w.*, 'https://d' || doc_id || '/' AS source_url, 0.9::DOUBLE AS confidence FROM wanted w",
    "fact_rows": rf"""WITH {_SIGNALS}, answers AS (
        SELECT doc_id, CASE WHEN lang = 'en' THEN 'hiring' ELSE 'other' END AS category, 0 AS pos,
               length(left(trim(text, ' ' || chr(10)), 300)) AS f, length(left(trim(text, ' ' || chr(10)), 400)) AS q FROM documents
        WHERE n_chars >= 100 AND doc_id % 11 <> 3 AND doc_id % 13 <> 5
        UNION ALL SELECT doc_id, 'team_size', unnest(range(1, CASE WHEN doc_id % 11 = 4 THEN 20 ELSE 2 END)), 21, 9 FROM documents
        WHERE n_chars >= 100 AND lang <> 'de' AND doc_id % 11 <> 3 AND doc_id % 13 <> 5),
      a AS (SELECT doc_id, category, 0 AS source, signal_pos AS pos, length(fact) AS f, length(evidence_quote) AS q FROM wanted
            UNION ALL SELECT doc_id, category, 1, pos, f, q FROM answers)
      SELECT doc_id AS scan_id, category, CAST(source AS INTEGER) AS source, count(*) AS n, CAST(max(f) AS INTEGER) AS longest_fact,
             CAST(max(q) AS INTEGER) AS longest_quote, CAST(min(pos) AS BIGINT) AS first_pos FROM a GROUP BY ALL""",
    "grounding_counts": """
      WITH f AS (SELECT l_orderkey AS scan_id, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'exact' WHEN l_returnflag = 'A' THEN 'fuzzy'
                   WHEN l_returnflag = 'N' THEN 'record' ELSE 'none' END AS g FROM lineitem)
      SELECT scan_id, count(*) AS facts, count(*) FILTER (g = 'exact') AS exact, count(*) FILTER (g = 'fuzzy') AS fuzzy,
             count(*) FILTER (g = 'record') AS record, count(*) FILTER (g = 'none') AS "none" FROM f GROUP BY scan_id""",
    "fact_rank": rf"""WITH {SENTENCES_SQL},
      pages AS (SELECT doc_id, doc_id // 6 AS site, {norm_sql('text')} AS t FROM documents),
      f AS (SELECT doc_id // 6 AS site, doc_id, sentence_pos, CASE WHEN sentence_pos % 3 = 1 THEN {ALTERED_SQL} ELSE sentence END AS quote FROM sentences),
      g AS (SELECT *, CASE WHEN sentence_pos % 5 = 0 THEN quote || ' 42' ELSE quote END AS fact, {norm_sql('quote')} AS q FROM f),
      b AS (SELECT * FROM g WHERE {norm_sql('fact')} <> '' QUALIFY row_number() OVER (PARTITION BY site, {norm_sql('fact')} ORDER BY doc_id, sentence_pos) = 1),
      {SETTLED_SQL},
      ranked AS (SELECT site, doc_id, sentence_pos, fact, coalesce(found, doc_id) AS url, CAST(length(quote) % 10 AS DOUBLE) / 10 AS confidence,
                   CASE WHEN sentence_pos % 5 <> 0 OR list_contains(regexp_extract_all(q, '\d+'), '42') THEN grounding ELSE 'none' END AS grounding FROM grades)
      SELECT site AS scan_id, CAST(id AS INTEGER) AS id, fact, 'd' || url AS source_url, confidence, grounding FROM (
        SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE grounding WHEN 'exact' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, confidence DESC, doc_id, sentence_pos) AS id
        FROM ranked) WHERE id <= 40""",
    "record_facts": """
      WITH s AS (SELECT *, 'shop' || o_custkey || '.example.com' AS domain, strftime(o_orderdate, '%Y-%m-%d') AS d,
                   CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS n, o_orderstatus <> 'P' AS reg, o_totalprice > 300000 AS exact FROM orders)
      SELECT o_orderkey AS scan_id, n + 1 AS id, 'domain_record' AS category,
             'Domain ' || domain || ' was registered on ' || d || ' (' || (2003 - year(o_orderdate)) || ' years ago).' AS fact,
             'registration: ' || d AS evidence_quote, 'https://rdap.org/domain/example.com' AS source_url, 1.0::DOUBLE AS confidence, 'record' AS grounding
      FROM s WHERE reg
      UNION ALL
      SELECT o_orderkey, n + CASE WHEN reg THEN 2 ELSE 1 END, 'domain_record',
             CASE WHEN exact THEN 'The website was first archived by the Wayback Machine on ' || d || '.'
                  ELSE 'Earliest Wayback Machine snapshot found: ' || d || ' (approximate).' END,
             CASE WHEN exact THEN 'first capture: ' ELSE 'earliest snapshot found: ' END || d,
             'https://web.archive.org/web/*/' || domain, CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 'record'
      FROM s WHERE o_totalprice > 100000""",
}
