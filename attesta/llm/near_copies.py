"""Near copies for the pipeline: SimHash links and min-hash buckets as candidates, confirmed exactly.

Fingerprints of five-word shingles within a few bits, searched with the BK-trees of ``simhash``, reach
only part of the pairs at a similarity of 0.8 (their fingerprints differ by about nine bits). Candidates
therefore also come from the buckets of ``minhash``, and every link is confirmed on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import minhash, simhash
from attesta.session import new_folder, stage

SHINGLE = 5
#: Least similarity of linked texts.
PERCENT = 80


def _near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of ``distinct`` (node, bits): equal fingerprints to their smallest node, and between
    the smallest nodes of fingerprints within the radius."""
    heads = stage(distinct.groupBy("bits").agg(F.min("node").alias("head")), new_folder(distinct.sparkSession, "fingerprints"))
    equal = distinct.join(heads, "bits").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    of_a, of_b = (heads.select(F.col("bits").alias(f"bits_{c}"), F.col("head").alias(c)) for c in "ab")
    near = simhash.links(heads.select(F.col("bits").alias("fp"))).withColumnsRenamed({"a": "bits_a", "b": "bits_b"})
    return near.join(of_a, "bits_a").join(of_b, "bits_b").select("a", "b").unionByName(equal)


def similar_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest id reachable), text_sha256 and kept of every row.

    Rows are linked whose sets of ``shingle`` successive words (A-Z lower-cased) have a Jaccard
    similarity of ``percent`` or more; ``kept`` marks one row of each component. Texts without a word are
    not linked. For nulls, repeated rows, other columns and empty tables see ``minhash.similar_groups``.
    """
    found = minhash.similar_groups(docs, percent, shingle, id_col, text_col, _near_fingerprints)
    return found.select("doc_id", "component_id", "text_sha256", F.col("stays").alias("kept"))
