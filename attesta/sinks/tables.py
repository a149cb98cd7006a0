"""Stored tables: scan outputs by profile, additive columns, and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import strip_nul


def without_nul(rows: DataFrame) -> DataFrame:
    """Text columns without NUL characters, which the stores downstream refuse."""
    return rows.select(*[
        strip_nul(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in rows.schema
    ])


def write_scan_outputs(folder: str, batch: str, tables: dict[str, DataFrame], files_per_profile: int = 8) -> None:
    """Store the output tables of a batch, each split by profile_id. Whatever a failed scan had
    completed is stored like the rest; its status says so.

    A batch has folders of its own, which a retry replaces. A profile's rows are dealt out to
    ``files_per_profile`` tasks, so that neither every task writes every profile nor one task all.
    """
    part = F.pmod(F.xxhash64("scan_id"), F.lit(files_per_profile))
    for name, rows in tables.items():
        dealt = without_nul(rows).repartition("profile_id", part)
        dealt.write.mode("overwrite").partitionBy("profile_id").parquet(f"{folder}/{name}/batch={batch}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with every column any of its parts has; absent ones read as null."""
    return spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")


def with_columns_of(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows widened to ``schema``: columns added later are null in older rows."""
    return rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
