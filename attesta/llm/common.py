"""Shared pieces of the operators: ASCII lower case, holdouts, tokens of Arrow batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import new_folder, stage

#: A word of every contract: code points other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Least and most bits of the bitmap of ``beside`` (2 MB, 32 MB), in rows of 2**15 bits as Spark's bitmaps have them.
BITMAP_BITS, MOST_BITMAP_BITS, BITMAP_ROW = 1 << 24, 1 << 28, 1 << 15

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.coalesce(ascii_lower(text.cast("string")), F.lit("")), 256)


def beside(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``columns`` are surely not in ``keys``, and the others.

    A bitmap of bounded size, one bit per hash of a key, is broadcast, so that a join with ``keys`` need
    only shuffle the second part: rows with a key and a few whose hash falls on one's bit. The bitmap
    has 16 bits or more a key up to ``MOST_BITMAP_BITS`` (32 MB).
    """
    bits = BITMAP_BITS
    known = keys.count()
    while bits < 16 * known and bits < MOST_BITMAP_BITS:
        bits *= 2
    at, bit_at, held = (f"_{n}_{uuid.uuid4().hex}" for n in ("row", "bit", "bits"))
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    row, bit = F.floor(slot / BITMAP_ROW), slot % BITMAP_ROW
    bitmap = keys.groupBy(row.alias(at)).agg(F.bitmap_construct_agg(bit).alias(held))  # at most 8192 rows of 4 KB
    byte = F.conv(F.hex(F.expr(f"substring({held}, int({bit_at} div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (F.col(bit_at) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = rows.withColumns({at: row, bit_at: bit}).join(F.broadcast(bitmap), at, "left")
    return tuple(marked.where(part).drop(at, bit_at, held) for part in (~hit, hit))


def keep_rows(rows: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``judged`` (doc_id, text_sha256, kept) keeps, one of each id and text, with all columns.

    Only texts that may be dropped are shuffled: the others pass by the join. Rows travel as one value
    beside the key, so that columns may have any name.
    """
    key = ["id", "digest"]
    judged = stage(judged.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "kept"), new_folder(rows.sparkSession, "judged"))
    keyed = rows.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    passed, doubtful = beside(keyed, judged.where(~F.col("kept")), key)
    ids = judged.where("kept").select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    found = doubtful.join(ids, same, "left_semi").dropDuplicates(key)
    return passed.unionByName(found).select("row.*")


def stage_small(df: DataFrame, path: str) -> DataFrame:
    """A stage table like ``session.stage``, in the format that takes less room and more time."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs started inside hand their rows to Python in batches of near ``size``: for wide rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int, most_rows: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that the texts of a piece stay near ``most_bytes``.

    A single longer text makes a piece of its own: texts are never cut.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            stop = min(stop, start + most_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Lower-cased (A-Z) words of a piece of texts: ``vocabulary[codes]``, of text ``rows``."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        words = lists.flatten()
        rows = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        if not filled.all():
            words, rows = words.filter(pa.array(filled)), rows[filled]
        coded = words.dictionary_encode()
        self.vocabulary: pa.Array = coded.dictionary
        self.codes: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows: np.ndarray = rows
        self.counts: np.ndarray = np.bincount(rows, minlength=len(texts))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word of the vocabulary."""
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, seed) for w in self.vocabulary.cast(pa.binary()).to_pylist()], dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 64-bit hashes; not symmetric."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ ((b << np.uint64(31)) | (b >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x
