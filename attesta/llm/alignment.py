"""Alignment of the tokens that two tokenizers make of one text.

Both id lists stand for the same bytes, so the places where tokens end are cumulative byte counts.
Each list becomes a dictionary from end to index; the ends that both dictionaries hold, found by
intersecting their key sets and sorted, slice both lists into groups. Inside a group no inner ends
agree, and its links, the pairs of tokens whose bytes overlap, follow from its ends in order.

How often an id pair is linked is counted over all texts. The most frequent pairs, a bounded number
of them, go to the workers as a broadcast; what a text has of other pairs is joined with the table of
all pairs, where a key that is rarer than the broadcast ones cannot be hot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.bpe import SPLIT, Vocabulary
from attesta.llm.common import slices, small_batches, stage_small
from attesta.session import new_folder, stage

PIECE_BYTES = 1 << 20
#: Distinct pairs that a counting task holds before it emits them.
MOST_HELD = 1 << 20
#: Most id pairs in the broadcast: 13 bytes each.
MOST_FREQUENT = 1 << 19
_SPACE = "▁"


class ByteTokens:
    """A byte-level BPE vocabulary file: ids of a text, bytes of an id. Special tokens are plain text."""

    def __init__(self, described: str):
        vocabulary = Vocabulary(described)
        ends = np.cumsum(vocabulary.lengths)
        raw = vocabulary.bytes.tobytes()
        self.bytes = [raw[e - n : e] for e, n in zip(ends.tolist(), vocabulary.lengths.tolist())]
        special = set(vocabulary.specials.values())
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        order = [merged for _, merged in sorted(vocabulary.merges.values())]
        if order != sorted(order) or len(ranks) + len(special) != len(self.bytes):
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        self._encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(" " + text)


class PieceTokens:
    """A sentence-piece model: ids of a text, bytes of an id. The model puts a space before the text."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), dtype=np.int32)


def group_sizes(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a, and of b, each group of two lists of ascending ends holds."""
    ats = [dict(zip(ends, range(1, len(ends) + 1))) for ends in (a_ends, b_ends)]
    common = sorted(ats[0].keys() & ats[1].keys())
    stops = (np.fromiter(map(at.__getitem__, common), np.int32, len(common)) for at in ats)
    return tuple(np.diff(x, prepend=np.int32(0)) for x in stops)


_ALIGNED = ("a_ids", "b_ids", "a_counts", "b_counts")
_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _read(path: str) -> bytes:
    with open(path, "rb") as file:  # a vocabulary file of the driver
        return file.read()


class Aligner:
    """Ids of a text by both tokenizers and the sizes of their groups."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.tokens = ByteTokens(byte_file.decode()), PieceTokens(piece_file)
        self.sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in self.tokens]

    def rows(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        for text in texts:
            ids = [t.encode(text) for t in self.tokens] if text else []
            raw = b" " + (text or "").encode()
            # a's tokens are parts of the text as they stand, in order: only missing bytes could differ
            if ids and self.sizes[0][ids[0]].sum() == len(raw) and b"".join(map(self.tokens[1].bytes.__getitem__, ids[1].tolist())) == raw:
                yield [*ids, *group_sizes(*(np.cumsum(n[i]).tolist() for n, i in zip(self.sizes, ids)))]
            else:
                yield [np.zeros(0, np.int32)] * 4


def _aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str, kind: T.DataType, column) -> DataFrame:
    """doc_id and the columns of ``_ALIGNED``, which ``column`` makes of a piece's arrays."""
    shared = docs.sparkSession.sparkContext.broadcast((_read(byte_path), _read(piece_path)))

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for piece in slices(batches, "text", PIECE_BYTES):
            aligner = aligner or Aligner(*shared.value)
            found = list(aligner.rows(piece.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(column([r[k] for r in found]) for k in range(4))], ["doc_id", *_ALIGNED])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(aligned, T.StructType([rows.schema["doc_id"], *(T.StructField(c, kind) for c in _ALIGNED)]))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, a_counts and b_counts (arrays of int) of every whole text.

    A space and the text are read by a byte-level vocabulary (a) and a sentence-piece model (b), which
    adds that space itself. Group g holds the next a_counts[g] tokens of a and b_counts[g] of b. A null
    or empty text, and one that either tokenizer does not give back byte by byte, has empty lists.
    Repeated rows and null ids are aligned each; other columns are ignored; an empty table gives an
    empty result. The vocabularies are broadcast; their size is that of their files.
    """
    return _aligned(docs, byte_path, piece_path, id_col, text_col, T.ArrayType(T.IntegerType(), False), _list)


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))


_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _packed(parts: list[np.ndarray]) -> pa.Array:
    """Each array as bytes: the width of its numbers, then the numbers."""
    most = max((int(p.max()) for p in parts if len(p)), default=0)
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    lead, kind = bytes([width]), _WIDTHS[width]
    return pa.array([lead + p.astype(kind).tobytes() for p in parts], pa.binary())


def _unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=_WIDTHS[value[0]], offset=1)


class _Piece:
    """Some aligned rows, their lists one after the other."""

    def __init__(self, batch: pa.RecordBatch):
        parts = [[_unpacked(v) for v in batch.column(c).to_pylist()] for c in _ALIGNED]
        self.n_a, self.n_b, self.n_groups, _ = (np.array([len(p) for p in column], dtype=np.int64) for column in parts)
        self.a_ids, self.b_ids, self.a_counts, self.b_counts = (np.concatenate(column).astype(np.int64) for column in parts)
        self.n_links = self.n_a + self.n_b - self.n_groups

    def links(self, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the a token and of the b token of every link, group by group.

        A group's links are the stretches between its ends of either list: within it the next end
        of a or b closes one stretch and goes on to the next token of that list.
        """
        ends = np.cumsum(a_sizes[self.a_ids]), np.cumsum(b_sizes[self.b_ids])
        total = int(ends[0][-1]) + 1 if len(ends[0]) else 1
        a_here, b_here = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        a_here[ends[0]], b_here[ends[1]] = True, True
        at = np.flatnonzero(a_here | b_here)
        return (np.cumsum(here, dtype=np.int32)[at] - here[at] for here in (a_here, b_here))


def _sizes(byte_path: str, piece_path: str) -> list[np.ndarray]:
    return Aligner(_read(byte_path), _read(piece_path)).sizes


def _pair_counts(packed: DataFrame, a_sizes: np.ndarray, b_sizes: np.ndarray) -> DataFrame:
    """a_id, b_id and n, how many links of all texts hold the pair."""
    width = len(b_sizes)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, "a_ids", PIECE_BYTES):
            piece = _Piece(batch)
            a, b = piece.links(a_sizes, b_sizes)
            own, many = np.unique(piece.a_ids[a] * width + piece.b_ids[b], return_counts=True)
            codes, which = np.unique(np.concatenate((codes, own)), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate((counts, many)), minlength=len(codes)).astype(np.int64)
            if len(codes) > MOST_HELD:
                yield _pairs(codes, counts, width)
                codes, counts = codes[:0], counts[:0]
        if len(codes):
            yield _pairs(codes, counts, width)

    parts = packed.select(*_ALIGNED).mapInArrow(counted, "a_id int, b_id int, n long")
    return parts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def _pairs(codes: np.ndarray, counts: np.ndarray, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(counts)], ["a_id", "b_id", "n"]
    )


def _most_frequent(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, n and best of the pairs above a count that at most ``most`` pairs reach, by code."""
    size = F.floor(F.log2("n") * 16)
    steps = pairs.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("size")).collect()  # at most 1024
    least, total = None, 0
    for step in steps:
        total += step["many"]
        if total > most:
            break
        least = step["size"]
    found = pairs.where(size >= least if least is not None else F.lit(False)).select("code", "n", "best").toArrow()
    order = np.argsort(found["code"].to_numpy())
    return tuple(found[c].to_numpy()[order] for c in ("code", "n", "best"))


def _finder(codes: np.ndarray):
    """Function from values to their places in the sorted ``codes``, -1 where there is none."""
    if not len(codes):
        return lambda values: np.full(len(values), -1, dtype=np.int64)
    bits = max(4, int(len(codes)).bit_length() + 3)

    def slots(values: np.ndarray) -> np.ndarray:
        return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    table = np.zeros(1 << bits, dtype=np.int32)
    table[slots(codes)] = np.arange(len(codes))

    def find(values: np.ndarray) -> np.ndarray:
        at = table[slots(values)].astype(np.int64)
        other = np.flatnonzero(codes[at] != values)  # a slot of another code, or none
        second = np.minimum(np.searchsorted(codes, values[other]), len(codes) - 1)
        at[other] = np.where(codes[second] == values[other], second, -1)
        return at

    return find


def score_links(
    docs: DataFrame, byte_path: str, piece_path: str, most_frequent: int = MOST_FREQUENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text, aligned as by ``align``.

    ``count_sum`` adds up, over the row's links, how many links of all texts hold the same id pair, and
    ``n_best`` counts links whose pair is the most frequent one of its b id, ties included.
    ``groups_sha256`` is the digest of the groups written as ``a1,a2|b1;a3|b2,b3``, and empty for a row
    without tokens, whose figures are zero. Repeated rows count each, as ``align`` reads them.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "alignment")
    a_sizes, b_sizes = _sizes(byte_path, piece_path)
    width = len(b_sizes)
    with small_batches(spark):
        packed = stage_small(_aligned(docs, byte_path, piece_path, id_col, text_col, T.BinaryType(), _packed), f"{folder}/packed")
        counts = stage(_pair_counts(packed, a_sizes, b_sizes), f"{folder}/counts")
    best = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # at most one row per id of the vocabulary
    code = F.col("a_id").cast("long") * width + F.col("b_id")
    pairs = stage(counts.join(best, "b_id").select(code.alias("code"), "n", (F.col("n") == F.col("most")).alias("best")), f"{folder}/pairs")
    shared = spark.sparkContext.broadcast(_most_frequent(pairs, most_frequent))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counted, bests = shared.value
        find = _finder(codes)
        counted, bests = np.append(counted, 0), np.append(bests, False)  # place -1: not among the frequent ones
        for batch in slices(batches, "a_ids", PIECE_BYTES):
            piece = _Piece(batch)
            a, b = piece.links(a_sizes, b_sizes)
            own = piece.a_ids[a] * width + piece.b_ids[b]
            at = find(own)
            rest = np.flatnonzero(at < 0)
            row = np.repeat(np.arange(batch.num_rows), piece.n_links)[rest]
            rare_codes, which = np.unique(own[rest], return_inverse=True)
            each, times = np.unique(row * max(len(rare_codes), 1) + which, return_counts=True)
            many = np.bincount(each // max(len(rare_codes), 1), minlength=batch.num_rows)
            rare = pa.StructArray.from_arrays([pa.array(rare_codes[each % max(len(rare_codes), 1)]), pa.array(times)], ["code", "times"])
            columns = {
                "n_a": pa.array(piece.n_a),
                "n_b": pa.array(piece.n_b),
                "n_groups": pa.array(piece.n_groups),
                "n_links": pa.array(piece.n_links),
                "n_best": pa.array(_sums(bests[at], piece.n_links)),
                "count_sum": pa.array(_sums(counted[at], piece.n_links)),
                "groups_sha256": pa.array([sha256(g).hexdigest() if g else "" for g in _written(piece)]),
                "rare": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), rare),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    numbers = ", ".join(f"{c} long" for c in _FIGURES)
    fields = T.StructType.fromDDL(f"{numbers}, groups_sha256 string, rare array<struct<code: long, times: long>>").fields
    figures = packed.select("doc_id", *_ALIGNED).mapInArrow(scored, T.StructType([packed.schema["doc_id"], *fields]))
    with small_batches(spark):
        figures = stage(figures.withColumn("row", F.monotonically_increasing_id()), f"{folder}/figures")
    rest = figures.select("row", F.inline("rare")).join(pairs, "code")
    added = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    total = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return figures.join(added, "row", "left").select(
        "doc_id", *_FIGURES[:4], total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256"
    )


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    before = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
    ends = np.cumsum(counts)
    return before[ends] - before[ends - counts]


_COMMA, _BAR, _SEMICOLON = b",|;"


@lru_cache(maxsize=4)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to ``most``, with zero bytes before them, and how many there are."""
    width = len(str(most))
    digits = np.array([list(str(i).encode().rjust(width, b"\0")) for i in range(most + 1)], dtype=np.uint8)
    return digits, (digits > 0).sum(axis=1)


def _written(piece: _Piece) -> list[bytes]:
    """Each row's groups as text, written for all rows at once: a token's digits and what follows it."""
    n = len(piece.a_ids) + len(piece.b_ids)
    ids, after = np.empty(n, dtype=np.int64), np.full(n, _COMMA, dtype=np.uint8)
    a_stops, b_stops = np.cumsum(piece.a_counts), np.cumsum(piece.b_counts)
    a_at = np.arange(len(piece.a_ids)) + np.repeat(b_stops - piece.b_counts, piece.a_counts)
    b_at = np.arange(len(piece.b_ids)) + np.repeat(a_stops, piece.b_counts)
    ids[a_at], ids[b_at] = piece.a_ids, piece.b_ids
    after[a_at[a_stops - 1]], after[b_at[b_stops - 1]] = _BAR, _SEMICOLON
    digits, sizes = _digits((1 << int(ids.max(initial=0)).bit_length()) - 1)
    text = np.empty((n, digits.shape[1] + 1), dtype=np.uint8)
    text[:, :-1] = digits[ids]
    text[:, -1] = after
    ends = np.concatenate(([0], np.cumsum(sizes[ids] + 1)))
    flat = text.tobytes().translate(None, b"\0")
    stops = ends[np.cumsum(piece.n_a + piece.n_b)]
    starts = np.concatenate(([0], stops[:-1]))
    return [flat[a : max(b - 1, a)] for a, b in zip(starts.tolist(), stops.tolist())]
