"""Session-level helpers: shared folders, stage tables and small literal relations."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own; on a cluster a
    machine-local folder would vanish with the machine, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage table and read it back: cuts lineage and survives executor loss."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_parts(staged: Callable[[DataFrame, str], DataFrame], made: Callable[[int], DataFrame], parts: int, path: str) -> DataFrame:
    """All parts, each a stage table (as ``staged`` makes it) that is written before the next is begun."""
    return reduce(DataFrame.unionByName, [staged(made(part), f"{path}-{part}") for part in range(parts)])


def unstage(table: DataFrame, path: str) -> None:
    """Leave an empty table at the path of a stage table that nothing reads any more."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside drop their shuffle files as they end, not when the driver collects its garbage, and
    write tables in the format that takes less room and more time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def stage_once(df: DataFrame, path: str, resume: bool) -> DataFrame:
    """A stage table with a mark beside it once it is whole; with ``resume`` a marked table that an
    earlier run left at ``path`` is read instead of written."""
    spark, mark = df.sparkSession, f"{path}.done"
    if resume and _readable(spark, mark):
        return spark.read.schema(df.schema).parquet(path)
    written = stage(df, path)
    spark.range(1).write.mode("overwrite").parquet(mark)
    return written


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is worked out once per row.

    A projected expression below a broadcast join is generated into the join's inner loop and so
    evaluated once per match; a generated column is a plain value by then.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def literal_relation(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A constant relation planned inside the JVM; its size is fixed by the code that calls it."""
    text = json.dumps([_named(row, schema) for row in rows])
    return spark.sql("SELECT 1 AS one").select(F.inline(F.from_json(F.lit(text), T.ArrayType(schema))))


def _named(value, data_type: T.DataType):
    if value is None:
        return None
    if isinstance(data_type, T.ArrayType):
        return [_named(v, data_type.elementType) for v in value]
    if isinstance(data_type, T.StructType):
        return {f.name: _named(v, f.dataType) for v, f in zip(value, data_type)}
    return value
