"""Byte-level BPE encoding by a pair occurrence index, and decoding.

Each piece of a partition is split into pre-tokens, and the pre-tokens not met before become one
long list of symbols. An index maps every mergeable pair to all positions where it stands. Ranks
that are active, that is have positions, are applied in ascending order: all positions of a rank
merge at once, and the pairs that begin or end at a merged symbol enter the lists of their own
ranks. A pre-token's result does not depend on the others, so applying a rank everywhere at once
gives what merging each pre-token alone gives.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import slices

# Fixed value: the pattern that splits text before the merges of byte-level vocabularies, with the
# Unicode property White_Space for its classes of spaces.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

PIECE_BYTES = 8 << 20
#: Distinct pre-tokens whose ids a worker remembers at once; beyond it starts anew.
REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(moved.get(b, b)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizer file; its size is fixed by that file."""

    def __init__(self, text: str):
        described = json.loads(text)
        vocab = described["model"]["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(described["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        pieces: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            pieces[i] = token.encode()
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)


def merge_all(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each word has."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    total = len(raw)
    symbol = vocabulary.byte_ids[raw]
    after = np.arange(1, total + 1, dtype=np.int64)
    before = np.arange(-1, total - 1, dtype=np.int64)
    ends = np.cumsum(lengths)
    filled = lengths > 0
    after[ends[filled] - 1] = -1
    before[(ends - lengths)[filled]] = -1
    alive = np.ones(total, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    results: dict[int, tuple[int, int]] = {}
    active: list[int] = []

    def enter(positions: np.ndarray) -> None:
        """Add pairs that begin at ``positions`` to the lists of their ranks."""
        pairs = symbol[positions] << 32 | symbol[after[positions]]
        order = np.argsort(pairs, kind="stable")
        pairs, positions = pairs[order], positions[order]
        firsts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        for pair, own in zip(pairs[firsts].tolist(), np.split(positions, firsts[1:])):
            merge = vocabulary.merges.get(pair)
            if merge is not None:
                rank = merge[0]
                if rank not in index:
                    index[rank] = []
                    results[rank] = (pair, merge[1])
                    heapq.heappush(active, rank)
                index[rank].append(own)

    begins = np.flatnonzero(after >= 0)
    if len(begins):
        enter(begins)
    while active:
        rank = heapq.heappop(active)
        held = index.pop(rank)
        pair, merged = results.pop(rank)
        left, right = pair >> 32, pair & 0xFFFFFFFF
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        follow = after[at]
        still = alive[at] & (symbol[at] == left) & (follow >= 0)
        still &= symbol[follow] == right
        at, follow = at[still], follow[still]
        if left == right and len(at) > 1:  # in a run of one symbol, every second pair from its left
            fresh = np.concatenate(([True], follow[:-1] != at[1:]))
            runs = np.flatnonzero(fresh)
            place = np.arange(len(at)) - runs[np.cumsum(fresh) - 1]
            at, follow = at[place % 2 == 0], follow[place % 2 == 0]
        if not len(at):
            continue
        beyond = after[follow]
        symbol[at] = merged
        alive[follow] = False
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        lefts = before[at]
        touched = np.concatenate((at[inner], lefts[lefts >= 0]))
        if len(touched):
            enter(np.unique(touched) if len(touched) > 1 else touched)
    ids = symbol[alive].astype(np.int32)
    word_of = np.repeat(np.arange(len(words)), lengths)[alive]
    return ids, np.bincount(word_of, minlength=len(words))


class Encoder:
    """Encodes texts piece by piece; remembers the ids of pre-tokens already met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT).findall
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._forget()

    def _forget(self) -> None:
        self.known = {token: k for k, token in enumerate(self.vocabulary.specials)}
        self.ids = [np.array(list(self.vocabulary.specials.values()), dtype=np.int32)]
        self.sizes = [np.ones(len(self.known), dtype=np.int64)]

    def pretokens(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.vocabulary.specials):
            return self.split(text)
        found: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            found.extend([part] if k % 2 else self.split(part))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        parts = [self.pretokens(t) for t in texts]
        new = list({w for part in parts for w in part if w not in self.known})
        if new:
            ids, sizes = merge_all(self.vocabulary, [w.encode("utf-8", "replace") for w in new])
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            self.ids.append(ids)
            self.sizes.append(sizes)
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        self.ids, self.sizes = [ids], [sizes]
        codes = np.fromiter((self.known[w] for part in parts for w in part), dtype=np.int64)
        per = sizes[codes]
        flat = ids[_ranges(np.cumsum(sizes)[codes] - per, per)]
        edges = np.concatenate(([0], np.cumsum(per)))
        counts = np.cumsum([len(p) for p in parts])
        return flat, np.diff(edges[counts], prepend=0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, … for each start, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))


def _load(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, special tokens' strings read as such.

    A null or empty text has no ids. Repeated rows are encoded each; other columns are ignored.
    The vocabulary goes to the workers as a broadcast whose size is that of its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_load(vocabulary_path))

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for piece in slices(batches, "text", PIECE_BYTES):
            encoder = encoder or Encoder(Vocabulary(shared.value))
            ids, counts = encoder.encode([t or "" for t in piece.column("text").to_pylist()])
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(encoded, schema)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for; null ids give empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_load(vocabulary_path))

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(shared.value)
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                lists = rows.column("ids")
                texts = [_text(vocabulary, v.values.to_numpy()) if v.is_valid else "" for v in lists]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    schema = T.StructType([*encoded.select("doc_id", "ids").schema, T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(decoded, schema)


def _text(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    places = _ranges(vocabulary.starts[ids], vocabulary.lengths[ids])
    return vocabulary.bytes[places].tobytes().decode("utf-8", "replace")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
