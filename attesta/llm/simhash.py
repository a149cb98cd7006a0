"""Near-duplicate documents: SimHash fingerprints searched with BK-trees, then linked groups.

Fingerprints of at most ``RADIUS`` differing bits agree on at least two of six blocks of bits, so
a fingerprint goes to one shard for each pair of blocks, named by their values. A shard holds a
BK-tree: a node's children hang on edges with their integer Hamming distance to it, and a query at
distance d follows only edges from d - radius to d + radius. A shard's links become a spanning
forest before they leave the task, so no group is written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import slices, text_digest
from attesta.session import new_folder, stage

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Widths of the blocks of a fingerprint, lowest bits first: radius + 2 blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A shard of more fingerprints is cut into parts, and every two parts meet in a shard of their own.
MOST_IN_SHARD = 4096
PIECE_BYTES = 4 << 20
_ROWS_AT_ONCE, _QUERIES_AT_ONCE = 1 << 17, 1 << 13


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hash of each run of ``shingle`` words; a shorter text is one run."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words] or [1])
    starts = [0, *ends.tolist()]
    stops = (ends[min(shingle, len(ends)) - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half the shingles' hashes; 0 without a word."""
    if not (text or "").encode("utf-8", "replace").split():
        return 0
    return bits_of(shingle_hashes(text, shingle)) & 0xFFFFFFFFFFFFFFFF


def bits_of(hashes: np.ndarray) -> int:
    """64 bits as a signed number, each set if it is in over half the ``hashes``."""
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        sums += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 and fp (the 64 bits as a long) of every whole text; null counts as empty."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            found = np.array([fingerprint(t, shingle) for t in piece.column("text").to_pylist()], dtype=np.uint64)
            columns = [piece.column("doc_id"), piece.column("text_sha256"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(text).alias("text_sha256"), text.alias("text"))
    return rows.mapInArrow(hashed, T.StructType([*rows.drop("text").schema, T.StructField("fp", T.LongType())]))


def _shards(fp: Column) -> Column:
    """Array of (table, key): for each two blocks, which they are and their values."""
    offsets = np.concatenate(([0], np.cumsum(BLOCKS))).tolist()
    values = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1)) for o, w in zip(offsets, BLOCKS)]
    pairs = combinations(range(len(BLOCKS)), 2)
    return F.array(*[F.struct(F.lit(t).alias("table"), (values[a] * 4096 + values[b]).alias("key")) for t, (a, b) in enumerate(pairs)])


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST_IN_SHARD) -> DataFrame:
    """Pairs (a, b), a < b, that link all of ``distinct`` (fp) within ``radius`` bits as forests."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"at most {len(BLOCKS) - 2} differing bits")
    rows = distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("s")).select("fp", "s.table", "s.key")
    large = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(0)) / most)
    own = F.pmod(F.xxhash64("fp"), F.greatest(parts, F.lit(1)))
    met = F.when(parts > 1, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.lit(0).cast("long")))
    placed = (
        rows.join(large, ["table", "key"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(met))
        .select("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("member"), "fp")
    )
    shard = ["table", "key", "i", "j"]

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, member in _whole_shards(batches, shard):
            a, b = forest(group, fp, member, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = placed.repartition(*[F.col(c) for c in shard]).sortWithinPartitions(*shard)
    return dealt.mapInArrow(searched, "a long, b long").distinct()


def _whole_shards(batches: Iterable[pa.RecordBatch], shard: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of whole shards at a time: number of the shard, fingerprint, whether the tree holds it."""
    held: list[pa.RecordBatch] = []

    def take(cut: bool) -> tuple | None:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_numpy() for c in shard]
        fresh = np.zeros(len(table), dtype=bool)
        fresh[:1] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        stop = int(np.flatnonzero(fresh)[-1]) if cut else len(table)
        held[:] = table.slice(stop).to_batches() if cut else []
        if not stop:
            return None
        return np.cumsum(fresh[:stop]) - 1, table.column("fp").to_numpy()[:stop].view(np.uint64), table.column("member").to_numpy()[:stop]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS_AT_ONCE:
            if (found := take(True)) is not None:
                yield found
    if held and (found := take(False)) is not None:
        yield found


def forest(group: np.ndarray, fp: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each group's fingerprints to the smallest of their linked set within the group.

    Builds the BK-trees of all groups level by level, then walks the queries down them in blocks.
    """
    counts = np.bincount(group)
    several = counts[group] > 1
    group, fp, member = group[several], fp[several], member[several]
    at = np.flatnonzero(member)
    roots = np.full(int(group.max(initial=-1)) + 1, -1, dtype=np.int64)
    roots[group[at][::-1]] = at[::-1]
    children, waiting, node = [], at[roots[group[at]] != at], roots[group[at]]
    node = node[node != at]
    while len(waiting):
        apart = np.bitwise_count(fp[waiting] ^ fp[node]).astype(np.int64)
        edge = node << 7 | apart
        _, first, which = np.unique(edge, return_index=True, return_inverse=True)
        child = waiting[first][which]
        children.append((edge[first], waiting[first]))
        rest = child != waiting
        waiting, node = waiting[rest], child[rest]
    edges = np.concatenate([e for e, _ in children]) if children else np.zeros(0, np.int64)
    below = np.concatenate([c for _, c in children]) if children else np.zeros(0, np.int64)
    order = np.argsort(edges, kind="stable")
    edges, below = edges[order], below[order]
    ordered = np.argsort(fp.view(np.int64), kind="stable")
    rank = np.empty(len(fp), dtype=np.int64)
    rank[ordered] = np.arange(len(fp))
    parent = np.arange(len(fp))  # of ranks: links are joined as they are found, and not kept
    for first in range(0, len(fp), _QUERIES_AT_ONCE):
        query = np.arange(first, min(first + _QUERIES_AT_ONCE, len(fp)))
        node = roots[group[query]]
        query, node = query[node >= 0], node[node >= 0]
        while len(query):
            apart = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            near = apart <= radius
            _join(parent, rank[query[near]], rank[node[near]])
            low = np.searchsorted(edges, node << 7 | np.maximum(apart - radius, 0), "left")
            high = np.searchsorted(edges, node << 7 | np.minimum(apart + radius, 64), "right")
            many = high - low
            query = np.repeat(query, many)
            node = below[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        parent = _roots(parent, parent)
    least = _roots(parent, np.arange(len(fp)))
    linked = least != np.arange(len(fp))
    return fp[ordered[least[linked]]], fp[ordered[linked]]


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    while True:
        up = parent[of]
        if (up == of).all():
            return of
        of = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put each pair under one root, the smaller of theirs."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node that each node of ``edges`` (a, b) reaches: node, root.

    Alternates large and small stars: every node hands its larger, then its smaller, neighbours to
    its smallest one. Each round's links are a table in the shared folder, and so are the smallest
    neighbours, so that the rows of a node with very many links can be split (adaptive skew join).
    """
    folder = new_folder(edges.sparkSession, "components")
    now = stage(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), f"{folder}/0")
    seen = _state(now)
    for turn in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = stage(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), f"{folder}/{turn}-large")
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u < v").distinct()
        small_least = stage(large.groupBy("v").agg(F.min("u").alias("m")), f"{folder}/{turn}-small")
        small = large.join(small_least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        now = stage(small.select("e.v", "e.u").where("u < v").distinct(), f"{folder}/{turn}")
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), text_sha256 and
    kept of every row.

    Texts without a word have fingerprint zero and are linked like any other. Null ids take part;
    a component of null ids only has a null component_id. The row with the smallest id stays; of
    rows of that id the one with the smallest digest, and every repeated row with both.
    """
    folder = new_folder(docs.sparkSession, "simhash")
    prints = stage(fingerprints(docs, shingle, id_col, text_col), f"{folder}/prints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256")
    classes = stage(prints.groupBy("fp").agg(F.min(row).alias("first")), f"{folder}/classes")
    found = components(links(classes.select("fp"), radius))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    members = rooted.join(named, "root").select("fp", "stays")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_sha256") == F.col("stays.text_sha256"))
    return prints.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("stays.doc_id").alias("component_id"), "text_sha256", kept.alias("kept")
    )
