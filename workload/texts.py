"""Text forms, hashes, quote checks, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import sentences as S
from workload import proxies as P


def normalized_text(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm"))


def quote_eligible(spark, sf_dir):
    sentences = S.sentences(P.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentences.select("doc_id", "sentence_pos", X.quote_eligible(X.normalize_plain(F.col("sentence"))).alias("eligible"))


def numbers_present(spark, sf_dir):
    """Do the numbers of an order's text occur in its line's text, and the other way round?"""
    line = P.table(spark, sf_dir, "lineitem")
    claim = F.format_string("%d units of part %d", F.col("l_quantity").cast("int"), "l_partkey")
    quote = F.format_string("lot %d: %d pieces, part no. %d/%d", "l_suppkey", F.col("l_quantity").cast("int"),
                            "l_partkey", "l_linenumber")
    return line.groupBy(
        X.numbers_present(claim, quote).alias("claim_in_quote"),
        X.numbers_present(quote, claim).alias("quote_in_claim"),
    ).agg(F.count("*").alias("n"))


def description_hash(spark, sf_dir):
    messy = F.concat(F.lit(" \n "), F.regexp_replace("text", r"(\s)", "$1\t "), F.lit("  "))
    return P.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.description_hash(messy).alias("description_hash"))


def sentences(spark, sf_dir):
    return S.sentences(P.table(spark, sf_dir, "documents").select("doc_id", "text"))


def note_clean(spark, sf_dir):
    marked = F.regexp_replace("text", r"(\.|,)", " [F3]$1")
    return P.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.strip_nul(X.strip_markers(marked)).alias("note"))


QUERIES = {f.__name__: f for f in (normalized_text, quote_eligible, numbers_present, description_hash, sentences, note_clean)}


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


SENTENCES_SQL = r"""
pieces AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)) AS p FROM documents),
tidy AS (
  SELECT doc_id, [regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[,;:\-–—·|)\] ]+', ''), '[ ,;:\-–—·|(\[]+$', '') FOR x IN p] AS t FROM pieces),
filled AS (SELECT doc_id, [x FOR x IN t IF x <> ''] AS t FROM tidy),
sentences AS (SELECT doc_id, unnest(range(len(t))) AS sentence_pos, unnest(t) AS sentence FROM filled)"""

ORACLE = {
    "normalized_text": f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents",
    "quote_eligible": rf"""WITH {SENTENCES_SQL}, n AS (SELECT doc_id, sentence_pos, {norm_sql('sentence')} AS q FROM sentences)
      SELECT doc_id, CAST(sentence_pos AS INTEGER) AS sentence_pos, length(q) >= 12 AND len(string_split(q, ' ')) >= 3
             AND len([w FOR w IN string_split(q, ' ') IF regexp_full_match(w, '\pL+')]) > 0 AS eligible FROM n""",
    "numbers_present": """
      SELECT true AS claim_in_quote, list_contains([CAST(l_quantity AS INTEGER), l_partkey], l_suppkey)
             AND list_contains([CAST(l_quantity AS INTEGER), l_partkey], l_linenumber) AS quote_in_claim, count(*) AS n
      FROM lineitem GROUP BY ALL""",
    "description_hash": r"SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS description_hash FROM conversations",
    "sentences": f"WITH {SENTENCES_SQL} SELECT doc_id, CAST(sentence_pos AS INTEGER) AS sentence_pos, sentence FROM sentences",
    "note_clean": r"""SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS note FROM conversations""",
}
