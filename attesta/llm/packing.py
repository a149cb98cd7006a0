"""Packing into length buckets whose boundaries pad least.

Texts become pieces of at most ``most_tokens`` words. Dynamic programming over the histogram of all
piece lengths chooses the bucket boundaries with the least padding, and batches of a token budget
form inside each bucket, in order of document and piece. The histogram has at most ``most_tokens``
rows, which bounds what the driver gets; numbering within a bucket adds up counts per partition, so
a bucket that holds most rows is spread like any other. Pieces travel with their text, once, to the
range of documents that they are numbered in; rows of one id are dealt to ranges by their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.numbers import let
from attesta.llm.common import GAP, WORD
from attesta.session import new_folder, stage, with_computed

MOST_TOKENS, BUCKETS, BATCH_TOKENS = 4096, 8, 65536


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` ascending boundaries with the least total padding.

    ``lengths`` ascend and are distinct. Of equally good ways the one whose buckets begin at
    smaller lengths, looking at the longest bucket first; more buckets only if they pad less.
    """
    if not len(lengths):
        return []
    ends, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    befores, tokens_before = ends - counts, tokens - counts * lengths
    least = lengths * ends - tokens
    cuts: list[np.ndarray] = []
    costs = [least]
    for _ in range(min(buckets, len(lengths)) - 1):
        nxt, cut = np.empty_like(least), np.empty(len(lengths), dtype=np.int64)
        for j in range(len(lengths)):
            first = np.arange(1, j + 1)
            total = costs[-1][first - 1] + lengths[j] * (ends[j] - befores[first]) - (tokens[j] - tokens_before[first])
            k = int(total.argmin()) if j else -1
            nxt[j], cut[j] = (total[k], first[k]) if j else (np.iinfo(np.int64).max // 4, 0)
        costs.append(nxt)
        cuts.append(cut)
    best = int(np.argmin([c[-1] for c in costs]))
    found, j = [int(lengths[-1])], len(lengths) - 1
    for cut in reversed(cuts[:best]):
        j = int(cut[j]) - 1
        found.append(int(lengths[j]))
    return found[::-1]


def _pieces(text: Column, words: Column, most_tokens: int) -> Column:
    """Array of (piece, text): a text is cut where a word begins; blanks before its first word go with it."""
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("piece"), text.alias("text")))
    begin = F.regexp_extract(text, f"^{GAP}", 0)
    last = F.ceil(words / most_tokens) - 1

    def cut(runs: Column) -> Column:
        def piece(k: Column) -> Column:
            held = F.array_join(F.slice(runs, (k * most_tokens + 1).cast("int"), most_tokens), "")
            return F.struct(k.alias("piece"), F.when(k == 0, F.concat(begin, held)).otherwise(held).alias("text"))

        return F.transform(F.sequence(zero, last), piece)

    # each run is a word and the blanks after it
    runs = F.split(F.regexp_replace(text, f"^{GAP}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.when(words <= most_tokens, whole).otherwise(let(runs, cut))


def pack(
    docs: DataFrame,
    most_tokens: int = MOST_TOKENS,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, text, bucket, batch, slot, padding.

    ``bucket`` is the padded length; a batch holds batch_tokens / bucket pieces, one at least. The
    pieces of a text, put together in order, are the text. A null text or one without a word is one piece of
    no tokens, without bucket, batch and slot. Repeated rows and null ids are packed each; the order of
    rows of one id and length follows a hash of their texts. Other columns, whatever their names, are left
    behind; an empty table gives an empty result.
    """
    folder = new_folder(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    n_tokens = F.least(F.col("words") - F.col("piece") * most_tokens, F.lit(most_tokens))
    counted = stage(texts.select("doc_id", words.alias("words")), f"{folder}/counted")
    last = F.greatest(F.ceil(F.col("words") / most_tokens) - 1, F.lit(0).cast("long"))
    lengths = counted.select("words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(n_tokens.alias("n_tokens"))
    histogram = lengths.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    chosen = boundaries(histogram["n_tokens"].to_numpy().astype(np.int64), histogram["n"].to_numpy().astype(np.int64), buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(chosen):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    pieces = with_computed(texts, "words", words).select("doc_id", "words", F.inline(_pieces(F.col("text"), F.col("words"), most_tokens)))
    filled = pieces.where("words > 0").select("doc_id", "piece", n_tokens.alias("n_tokens"), "text")
    order = ["doc_id", "piece", "n_tokens", F.xxhash64("text")]
    ordered = filled.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order)

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), np.zeros(len(chosen), dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(chosen, batch.column("bucket").to_numpy())
            place = np.empty(len(at), dtype=np.int64)
            for k in np.unique(at):
                own = np.flatnonzero(at == k)
                place[own] = so_far[k] + np.arange(len(own))
                so_far[k] += len(own)
            columns = [*batch.columns, pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])

    schema = T.StructType([*ordered.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    placed = stage(ordered.mapInArrow(numbered, schema), f"{folder}/placed")
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("place")
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket")), F.lit(1))
    packed = placed.join(F.broadcast(starts), ["bucket", "part"]).select(  # partitions x buckets rows
        "doc_id",
        "piece",
        "n_tokens",
        "text",
        "bucket",
        F.floor(rank / room).alias("batch"),
        F.pmod(rank, room).alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    empty = texts.where(words == 0).select(
        "doc_id", zero.alias("piece"), zero.alias("n_tokens"), "text", none.alias("bucket"), none.alias("batch"), none.alias("slot"), zero.alias("padding")
    )
    return packed.unionByName(empty)


def pack_sql(table: str = "documents", most_tokens: int = MOST_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> str:
    """DuckDB SQL for ``pack`` over ``table``: the dynamic programme is one query step per bucket."""
    steps = ["p1 AS (SELECT i, len, ends, toks, len * ends - toks AS cost, 0 AS cut FROM l)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"p{k} AS (SELECT b.i, any_value(b.len) AS len, any_value(b.ends) AS ends, any_value(b.toks) AS toks, "
            "min(a.cost + b.len * (b.ends - a.ends) - (b.toks - a.toks)) AS cost, "
            f"arg_min(a.i, (a.cost + b.len * (b.ends - a.ends) - (b.toks - a.toks)) * 1000000 + a.i) AS cut "
            f"FROM p{k - 1} a JOIN l b ON a.i < b.i GROUP BY b.i)"
        )
    finals = " UNION ALL ".join(f"SELECT {k} AS k, i, cost FROM p{k} WHERE i = (SELECT max(i) FROM l)" for k in range(1, buckets + 1))
    steps.append(f"best AS (SELECT k, i FROM ({finals}) ORDER BY cost, k LIMIT 1)")
    steps.append(f"c{buckets} AS (SELECT i FROM best WHERE k = {buckets})")
    for k in range(buckets - 1, 0, -1):
        steps.append(f"c{k} AS (SELECT i FROM best WHERE k = {k} UNION ALL SELECT cut AS i FROM p{k + 1} SEMI JOIN c{k + 1} USING (i))")
    steps.append("bounds AS (" + " UNION ".join(f"SELECT len FROM l SEMI JOIN c{k} USING (i)" for k in range(1, buckets + 1)) + ")")
    return f"""
WITH w AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words FROM {table}
), pieces AS (
  SELECT doc_id, piece, least(words - piece * {most_tokens}, {most_tokens}) AS n_tokens
  FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(words / {most_tokens}) AS BIGINT), 1))) AS piece FROM w)
), h AS (
  SELECT n_tokens AS len, count(*) AS n FROM pieces WHERE n_tokens > 0 GROUP BY n_tokens
), l AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY len) AS i, len, CAST(sum(n) OVER (ORDER BY len) AS BIGINT) AS ends,
         CAST(sum(n * len) OVER (ORDER BY len) AS BIGINT) AS toks FROM h
), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS rank,
         greatest({batch_tokens} // bucket, 1) AS room
  FROM (SELECT *, CASE WHEN n_tokens > 0 THEN (SELECT min(len) FROM bounds WHERE len >= n_tokens) END AS bucket FROM pieces)
)
SELECT doc_id, piece, n_tokens, bucket, CASE WHEN bucket IS NOT NULL THEN rank // room END AS batch,
       CASE WHEN bucket IS NOT NULL THEN rank % room END AS slot, coalesce(bucket - n_tokens, 0) AS padding
FROM placed
"""
