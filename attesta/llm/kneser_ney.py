"""Interpolated modified Kneser-Ney bigram model, counted by Spark and read by memory mapping.

Learning: each task counts its distinct pairs of successive tokens and deals them to shards; a
shard adds up its pairs and writes them as sorted arrays of pair hashes and counts. What the pairs
tell about single words (followers by count, distinct predecessors, occurrences) goes to word
shards, written the same way. A context's pairs are spread over several shards, so a frequent word
does not fill one. Words are told apart by 64-bit hashes.

Scoring: workers map the files into memory and look up the sorted hashes of a piece of texts; the
kernel loads only pages that are read, and workers of a machine share them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import Words, mix, remainder, slices
from attesta.session import new_folder, stage

PIECE_BYTES, LEARN_BYTES = 4 << 20, 12 << 20
#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
_SPREAD = np.uint64(60)  # a context's pairs go to 2 ** (64 - 60) shards


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and what is known of the whole corpus."""

    folder: str
    shards: int
    tokens: int  # all learned tokens, ends included
    types: int  # distinct learned tokens
    pairs: int  # distinct learned pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float  # share of the lowest order left for the uniform distribution


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' hashes; which of them context and token of each place are; the place's text."""
    words = Words(texts)
    hashes = np.append(words.hashes(), [END, START])
    end, start = len(hashes) - 2, len(hashes) - 1
    lasts = np.cumsum(words.counts)
    tokens = np.insert(words.codes, lasts, end)
    contexts = np.insert(words.codes, lasts - words.counts, start)
    return hashes, contexts, tokens, np.repeat(np.arange(len(texts)), words.counts + 1)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash: equal ranges of the hash's upper half."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair_shards(contexts: np.ndarray, tokens: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(mix(contexts, tokens >> _SPREAD), shards)


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``keys`` (one or two columns) in order, and sums of ``values`` over each."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    firsts = np.flatnonzero(fresh)
    sums = [np.add.reduceat(v[order], firsts) if len(firsts) else v[:0] for v in values]
    return [k[firsts] for k in keys], sums


def _distinct_pairs(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (contexts, tokens), (counts,) = _summed([contexts, tokens], [counts])
    return contexts, tokens, counts


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    whole = pa.decompress(data, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd")
    return np.frombuffer(whole, dtype=kind)


def _pair_rows(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row per shard: its contexts with the number of their pairs, the pairs' tokens and counts."""
    shard = _pair_shards(contexts, tokens, shards)
    order = np.argsort(shard, kind="stable")
    shard, contexts, tokens, counts = shard[order], contexts[order], tokens[order], counts[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    columns: list[list] = [[], [], [], [], [], []]
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        firsts = np.flatnonzero(np.concatenate(([True], contexts[part][1:] != contexts[part][:-1])))
        runs = np.diff(np.append(firsts, edges[s + 1] - edges[s]))
        values = (int(s), len(firsts), contexts[part][firsts].tobytes(), _packed(runs.astype(np.uint32)), tokens[part].tobytes(), _packed(counts[part].astype(np.uint64)))
        for column, value in zip(columns, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, _PAIR_FIELDS)], [t.name for t in _PAIR_FIELDS])


_PAIR_FIELDS = [pa.field("shard", pa.int32()), pa.field("contexts", pa.int32()), *(pa.field(n, pa.binary()) for n in ("context", "runs", "token", "counts"))]
_PAIR_SCHEMA = "shard int, contexts int, context binary, runs binary, token binary, counts binary"
#: Of each word: followers met once, twice, more often; distinct predecessors; occurrences.
_WORD_VALUES = ("once", "twice", "often", "before", "count")
_WORD_SCHEMA = "shard int, words int, word binary, " + ", ".join(f"{v} binary" for v in _WORD_VALUES) + ", times array<long>"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    kind, colon, rest = folder.partition(":")
    if not colon:
        return pafs.LocalFileSystem(), folder
    if kind == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if kind == 's3a' else kind}:{rest}")


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Store arrays of one length as one file; a repeated task writes the same file again."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(part, f"{path}/{name}")


def _mapped(folder: str, name: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The arrays of a file as views of mapped memory.

    A file of a mounted folder is mapped in place; one of another store is first copied to a
    temporary file without a name, which the system removes with the worker.
    """
    store, path = _store(folder)
    info = store.get_file_info(f"{path}/{name}")
    if info.type == pafs.FileType.NotFound or not info.size:
        return [np.zeros(0, dtype=k) for k in kinds]
    if isinstance(store, pafs.LocalFileSystem):
        raw = np.memmap(info.path, dtype=np.uint8, mode="r")
    else:
        with store.open_input_stream(info.path) as source, tempfile.TemporaryFile() as local:
            while block := source.read(16 << 20):
                local.write(block)
            local.flush()
            raw = np.memmap(local, dtype=np.uint8, mode="r")
    rows, at, found = info.size // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = rows * np.dtype(k).itemsize
        found.append(raw[at : at + size].view(k))
        at += size
    return found


#: Of files with counts below 2**32, and of others.
_PAIR_KINDS = ((np.uint64, np.uint32), (np.uint64, np.int64))
_WORD_KINDS = (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64)


def learn(
    docs: DataFrame, modulus: int = 5, held_out: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Counts of all documents that are not held out; null texts count as empty.

    ``shards`` follows the session's shuffle partitions unless given. The driver gets one row of
    counts of counts per shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "kneser-ney")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", LEARN_BYTES):
            hashes, contexts, tokens, _ = _sequences(piece.column("text"))
            codes = np.sort(contexts << 32 | tokens)
            firsts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            counts, codes = np.diff(np.append(firsts, len(codes))), codes[firsts]
            yield _pair_rows(hashes[codes >> 32], hashes[codes & 0xFFFFFFFF], counts, shards)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                runs = _unpacked(row["runs"], row["contexts"], np.uint32)
                tokens = np.frombuffer(row["token"], dtype=np.uint64)
                counts = _unpacked(row["counts"], len(tokens), np.uint64).astype(np.int64)
                parts.setdefault(row["shard"], []).append((np.repeat(np.frombuffer(row["context"], dtype=np.uint64), runs), tokens, counts))
        for shard in sorted(parts):
            contexts, tokens, counts = _distinct_pairs(*map(np.concatenate, zip(*parts.pop(shard))))
            hashes = mix(contexts, tokens)
            order = np.argsort(hashes)
            wide = int(counts.max() >= 1 << 32)
            _write(folder, f"pairs-{shard}-{wide}", [hashes[order], counts[order].astype(_PAIR_KINDS[wide][1])])
            ones = np.ones(len(counts), dtype=np.int64)
            none = np.zeros(len(counts), dtype=np.int64)
            of_contexts = [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64), none, none]
            of_tokens = [none, none, none, ones, counts]
            values = [np.concatenate(v) for v in zip(of_contexts, of_tokens)]
            (words,), values = _summed([np.concatenate((contexts, tokens))], values)
            times = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            yield _word_rows(words, values, times, shards)

    def stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        pair_times = np.zeros(4, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                pair_times += np.array(row["times"] or [0] * 4)
                if row["words"]:
                    words = np.frombuffer(row["word"], dtype=np.uint64)
                    parts.setdefault(row["shard"], []).append([words, *(_unpacked(row[v], row["words"], np.int64) for v in _WORD_VALUES)])
        rows = []
        for shard, held in parts.items():
            columns = [np.concatenate(c) for c in zip(*held)]
            (words,), values = _summed([columns[0]], columns[1:])
            _write(folder, f"words-{shard}", [words, *values])
            before, count = values[3], values[4]
            rows.append([int(count.sum()), int((count > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum())])
        total = np.array(rows or [[0] * 8], dtype=np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([pair_times.tolist()], pa.list_(pa.int64()))], ["words", "pairs"])

    rows = docs.where(remainder(F.col(id_col), modulus) != held_out).select(F.col(text_col).cast("string").alias("text"))
    pairs = rows.mapInArrow(counted, _PAIR_SCHEMA).repartitionById(shards, F.col("shard"))
    words = pairs.mapInArrow(merged, _WORD_SCHEMA).repartitionById(shards, F.col("shard"))
    facts = stage(words.mapInArrow(stored, "words array<long>, pairs array<long>"), f"{folder}-facts")
    sums = facts.select(*[F.sum(F.col("words")[k]) for k in range(8)], *[F.sum(F.col("pairs")[k]) for k in range(4)]).first()
    sums = [int(v or 0) for v in sums]
    tokens, types, pair_types, times, often, pair_times = sums[0], sums[1], sums[2], sums[3:7], sums[7], sums[8:]
    word_discounts = _discounts(times)
    left = word_discounts[0] * times[0] + word_discounts[1] * times[1] + word_discounts[2] * often
    return Model(folder, shards, tokens, types, pair_types, _discounts(pair_times), word_discounts, left / pair_types if pair_types else 1.0)


def _word_rows(words: np.ndarray, values: list[np.ndarray], times: list[int], shards: int) -> pa.RecordBatch:
    """One row per word shard; the first also has the pairs' counts of counts."""
    edges = np.searchsorted(_shard_of(words, shards), np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        packed = {name: _packed(v[part]) for name, v in zip(_WORD_VALUES, values)}
        rows.append({"shard": int(s), "words": int(edges[s + 1] - edges[s]), "word": words[part].tobytes(), **packed, "times": None if rows else times})
    fields = [pa.field("shard", pa.int32()), pa.field("words", pa.int32()), *(pa.field(n, pa.binary()) for n in ("word", *_WORD_VALUES)), pa.field("times", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _discounts(times: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts 1 to 4.

    Where the counts of counts allow none (too small or odd a corpus), one half of the count.
    """
    n1, n2, n3, n4 = times
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(d if 0 < d < k else 0.5 for k, d in enumerate(found, 1))


class Lookup:
    """Reads a model's files, each when it is first asked; kept by a worker for all its tasks."""

    def __init__(self, model: Model):
        self.model = model
        self._opened: dict[tuple[str, int], list[np.ndarray]] = {}

    def _shard(self, kind: str, shard: int) -> list[np.ndarray]:
        found = self._opened.get((kind, shard))
        if found is None:
            folder = self.model.folder
            if kind == "words":
                found = _mapped(folder, f"words-{shard}", _WORD_KINDS)
            else:
                narrow, wide = (_mapped(folder, f"pairs-{shard}-{w}", _PAIR_KINDS[w]) for w in (0, 1))
                found = wide if len(wide[0]) else narrow
            self._opened[kind, shard] = found
        return found

    def _find(self, kind: str, shard: np.ndarray, hashes: np.ndarray, values: int) -> list[np.ndarray]:
        """Values of each hash, sorted within its shard; 0 where it is not stored."""
        edges = np.searchsorted(shard, np.arange(self.model.shards + 1))
        found = [np.zeros(len(hashes), dtype=np.int64) for _ in range(values)]
        for s in np.flatnonzero(np.diff(edges)):
            keys, *stored = self._shard(kind, int(s))
            if not len(keys):
                continue
            asked = hashes[edges[s] : edges[s + 1]]
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            known = keys[place] == asked
            for of_keys, out in zip(stored, found):
                out[edges[s] : edges[s + 1]] = np.where(known, of_keys[place], 0)
        return found

    def probabilities(self, words: np.ndarray, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability after its context, and the token's count.

        ``contexts`` and ``tokens`` are places in ``words``, whose last two are END and START.
        """
        m = self.model
        order = np.argsort(words)
        facts = self._find("words", _shard_of(words[order], m.shards), words[order], 5)
        once, twice, often, before, count = (_unsorted(f, order) for f in facts)
        codes, back = np.unique(contexts << 32 | tokens, return_inverse=True)
        left, right = words[codes >> 32], words[codes & 0xFFFFFFFF]
        shard, hashes = _pair_shards(left, right, m.shards), mix(left, right)
        order = np.lexsort((hashes, shard))
        pair_count = _unsorted(self._find("pairs", shard[order], hashes[order], 1)[0], order)
        uniform = 1 / (m.types + 1)
        low = m.word_rest * uniform + np.maximum(before - _by_count(m.word_discounts, before), 0) / max(m.pairs, 1)
        kept = _kept(once, twice, often, m.pair_discounts)
        follows = np.append(count[:-1], count[-2])  # a word is followed as often as it occurs, the start as often as texts end
        total, rest = follows[codes >> 32], kept[codes >> 32]
        high = np.maximum(pair_count - _by_count(m.pair_discounts, pair_count), 0)
        seen = total > 0
        safe = np.where(seen, total, 1)
        p = np.where(seen, high / safe + rest / safe * low[codes & 0xFFFFFFFF], low[codes & 0xFFFFFFFF])
        return np.log10(p)[back], count[tokens]


_LOOKUPS: dict[str, Lookup] = {}


def _lookup(model: Model) -> Lookup:
    """This worker's lookup of a model; that of an earlier model is given up."""
    if model.folder not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[model.folder] = Lookup(model)
    return _LOOKUPS[model.folder]


def _unsorted(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    found = np.empty_like(values)
    found[order] = values
    return found


def _by_count(discounts: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _kept(once: np.ndarray, twice: np.ndarray, often: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    """What the discounts take from all followers of a context."""
    return discounts[0] * once + discounts[1] * twice + discounts[2] * often


def score(
    docs: DataFrame, model: Model, modulus: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Scores of every whole text: its words and one end, lower-cased (A-Z).

    doc_id, held_out, n_tokens, n_known (learned tokens), train_tokens, base_score (sum of log10 of
    add-half unigram probabilities), score (log10 probability under the model) and perplexity. A
    null or empty text has one token, its end. With nothing learned every token is equally likely.
    """

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model)
        for piece in slices(batches, "text", PIECE_BYTES):
            words, contexts, tokens, rows = _sequences(piece.column("text"))
            logs, counts = lookup.probabilities(words, contexts, tokens)
            size = piece.num_rows
            n = np.bincount(rows, minlength=size)
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            total = np.bincount(rows, logs, size)
            columns = [
                piece.column("doc_id"), piece.column("held_out"), pa.array(n), pa.array(np.bincount(rows, counts > 0, size).astype(np.int64)),
                pa.array(np.full(size, model.tokens)), pa.array(np.bincount(rows, base, size)), pa.array(total), pa.array(10 ** (-total / n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    longs = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    doubles = [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]
    return rows.mapInArrow(scored, T.StructType([*rows.drop("text").schema, *longs, *doubles]))
