"""Exact deduplication by distributed MSD radix partitioning.

A text is read as a string of bytes led by its own length, so texts of one group end together. Each
round takes the next digit, a run of successive bytes, and splits every open group by it. A group
of one row is done; a group whose bytes are used up holds equal texts. Bytes are compared as they
are, so equality needs no digest.

Group sizes are pre-aggregated per task before the shuffle, which leaves one row per digit and
task of a hot group. A bitmap of open groups lets most single rows pass by the join that gives rows
their new group, so their texts are not shuffled. That join has one row per group on its other
side, so a hot group's rows can be split over tasks (adaptive skew join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.common import ascii_lower, beside
from attesta.session import new_folder, stage


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = 64, digit: int = 4096, growth: int = 16
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id of a group
    stays. Null texts count as empty, so they equal empty ones. A null id is below every other and
    stays only in a group without ids. Of several rows with the id and text that stay, one is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(ascii_lower(F.col(text_col).cast("string")), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("group"), F.col("text").cast("binary").alias("rest"))
    )
    folder, done, width, turn = new_folder(docs.sparkSession, "exact"), [], first_digit, 0
    while True:
        single, split = _split(rows, width, f"{folder}/{turn}")
        done += [single, split.where(F.col("rest").isNull()).drop("group", "rest")]
        rows = split.where(F.col("rest").isNotNull()).select("doc_id", "text_sha256", "group", "rest")
        if rows.isEmpty():
            break
        width, turn = digit * growth**turn, turn + 1
    same = Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1))
    found = reduce(DataFrame.unionByName, done).withColumn("copy", F.row_number().over(same))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _split(rows: DataFrame, width: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows known to be single, and the others after one more digit.

    Of the others ``rest`` is null if their group turned out single or is used up.
    """
    digits = rows.withColumn("digit", F.substring("rest", 1, width))
    groups = (
        digits.groupBy("group", "digit")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )
    numbered = stage(groups.withColumn("next", F.monotonically_increasing_id()), f"{path}-groups")
    apart, others = beside(digits, numbered, ["group", "digit"])
    single = apart.select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    alone = F.col("next").isNull()
    opened = ~alone & (F.octet_length("rest") > width)
    joined = others.join(numbered.hint("merge"), ["group", "digit"], "left").select(
        "doc_id",
        "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        F.col("next").alias("group"),
        F.when(opened, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )
    return single, stage(joined, f"{path}-rows")
