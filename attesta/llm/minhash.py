"""Near-duplicate documents by one-permutation min-hashing, confirmed on whole shingle sets.

One hash of each shingle serves all bins: its high bits name the bin, and a bin keeps its least hash. An
empty bin takes the value of a filled one that a hash of (bin, attempt) names, attempt by attempt, so
that every empty bin chooses on its own (optimal densification). ``BANDS`` bands of ``ROWS`` bins deal
the texts into buckets. Two texts of similarity s share no bucket with probability (1 - s**5)**32:
3e-8 at 0.85 and 3e-6 at 0.8.

Inside a bucket texts whose sketches agree in all but ``SLACK`` percent of the asked bins become stars:
a hub and its members, then, from what the hub does not reach, members of members. A bucket of n texts
so gives less than n candidate edges, and texts that such edges connect meet once, in a component. At five
standard deviations of 160 bins the slack loses a pair in some three million.

The whole shingle sets of a component's texts are then multiplied as a 0/1 matrix, which gives every
pair's intersection inside the task; what leaves it is a spanning forest of the true links. Buckets and
components beyond ``PART`` texts are cut into parts that meet pairwise, so no task holds a large one.
Texts of equal sets count once throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import beside, mix, slices, small_batches, text_digest
from attesta.llm.simhash import bits_of, components, shingle_hashes
from attesta.session import new_folder, stage

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
SLACK = 15
#: Texts of a part, the parts that this may lead to, and the texts and shingles of a part beyond those.
PART, MOST_PARTS, LARGE_PART, PART_SHINGLES = 128, 16, 2048, 1 << 20
PIECE_BYTES, GROUP_BYTES = 2 << 20, 16 << 20
#: Numbers of a block of comparisons.
_BLOCK = 1 << 22


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The densified bins of each set of ascending distinct hashes, none empty."""
    sizes = [len(s) for s in sets]
    hashes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    place = row * BINS + bin_of  # ascends, as hashes do within a set: the first of a bin is its least
    first = np.flatnonzero(np.diff(place, prepend=-1))
    bins, filled = np.zeros(len(sets) * BINS, dtype=np.uint64), np.zeros(len(sets) * BINS, dtype=bool)
    bins[place[first]], filled[place[first]] = hashes[first], True
    open_at, attempt = np.flatnonzero(~filled), 0
    while len(open_at):
        attempt += 1
        chosen = mix(np.arange(BINS, dtype=np.uint64), np.full(BINS, attempt, dtype=np.uint64)) % np.uint64(BINS)
        source = open_at - open_at % BINS + chosen.astype(np.int64)[open_at % BINS]
        found = filled[source]
        bins[open_at[found]] = bins[source[found]]
        open_at = open_at[~found]
    return bins.reshape(len(sets), BINS)


def bands(bins: np.ndarray) -> np.ndarray:
    """Hash of each band of each sketch."""
    parts = bins.reshape(len(bins), BANDS, ROWS)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bins), BANDS))
    for k in range(ROWS):
        found = mix(found, parts[:, :, k])
    return found


def fewest(percent: int) -> int:
    """Least size of a set that can be similar to a different one."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def _prints(docs: DataFrame, percent: int, shingle: int, with_bits: bool, id_col: str, text_col: str) -> DataFrame:
    """Of every row doc_id, text_sha256, n_shingles, key (digest of its set, null if empty), and, if its
    set can be similar to another, bands and codes (a byte of each bin); bits is its fingerprint."""
    least = fewest(percent)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES, 1 << 12):
            texts = piece.column("text").to_pylist()
            lists = [shingle_hashes(t, shingle) if t and t.encode("utf-8", "replace").split() else np.zeros(0, np.uint64) for t in texts]
            sets = [np.unique(x) for x in lists]
            large = [k for k, s in enumerate(sets) if len(s) >= least]
            found_bands: list = [None] * len(sets)
            codes: list = [None] * len(sets)
            if large:
                bins = sketches([sets[k] for k in large])
                for k, own, low in zip(large, bands(bins).view(np.int64), (bins & np.uint64(255)).astype(np.uint8)):
                    found_bands[k], codes[k] = own, low.tobytes()
            columns = {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "bands": pa.array(found_bands, pa.list_(pa.int64())),
                "codes": pa.array(codes, pa.binary()),
                "bits": pa.array([bits_of(x) if with_bits and len(x) else None for x in lists], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_sha256"), *columns.values()], ["doc_id", "text_sha256", *columns])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(text).alias("text_sha256"), text.alias("text"))
    more = T.StructType.fromDDL("n_shingles long, key binary, bands array<long>, codes binary, bits long").fields
    return rows.mapInArrow(hashed, T.StructType([*rows.drop("text").schema, *more]))


def _dealt(rows: DataFrame, group: str, parts: Column) -> DataFrame:
    """``rows`` by (group, i, j): a group of several parts has a shard for each two of them, and a row
    goes to those of its own part. Smaller nodes come first, so that shards tend to choose the same hubs."""
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    others = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("own"))).otherwise(F.array("own"))
    placed = rows.withColumn("parts", parts.cast("long")).withColumn("own", own).withColumn("other", F.explode(others))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "parts")
    return placed.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``keys``, and where the groups begin (and the end)."""
    held: list[pa.RecordBatch] = []

    def take(cut: bool) -> tuple[pa.Table, np.ndarray] | None:
        table = pa.Table.from_batches(held).combine_chunks()
        fresh = np.zeros(len(table), dtype=bool)
        fresh[:1] = True
        for c in keys:
            values = table.column(c).to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh)
        stop = int(starts[-1]) if cut else len(table)
        held[:] = table.slice(stop).to_batches() if cut else []
        return (table.slice(0, stop), np.append(starts[starts < stop], stop)) if stop else None

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= GROUP_BYTES and (found := take(True)) is not None:
            yield found
    if held and (found := take(False)) is not None:
        yield found


def _reached(agrees: Callable[[np.ndarray, np.ndarray], np.ndarray], many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) that reach everything reachable among ``many`` by ``agrees`` (two index arrays to
    a matrix): a first hub's star, then what its members reach of the rest, and so on."""
    left, frontier = np.arange(many), np.zeros(0, dtype=np.int64)
    while len(left):
        if not len(frontier):
            frontier, left = left[:1], left[1:]
            if not len(left):
                return
        some = max(1, min(len(frontier), _BLOCK // (BINS * len(left))))
        hubs, frontier = frontier[:some], frontier[some:]
        links = agrees(hubs, left)
        hit = links.any(axis=0)
        if hit.any():
            yield hubs[links.argmax(axis=0)[hit]], left[hit]
            frontier, left = np.concatenate((frontier, left[hit])), left[~hit]


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the stars of each bucket of ``members`` (band, n, node, codes)."""
    need = -(-(percent - SLACK) * BINS // 100)

    def starred(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, ["band", "i", "j"]):
            node = table.column("node").to_numpy()
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            close = two[(codes[two] == codes[two + 1]).sum(axis=1) >= need]
            a, b = [close], [close + 1]
            for start, stop in zip(starts[:-1][sizes > 2].tolist(), starts[1:][sizes > 2].tolist()):
                own = codes[start:stop]
                for hubs, reached in _reached(lambda x, y, own=own: (own[x][:, None] == own[y]).sum(axis=2) >= need, stop - start):
                    a.append(hubs + start)
                    b.append(reached + start)
            a, b = node[np.concatenate(a)], node[np.concatenate(b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    n = F.col("n")
    parts = F.greatest(F.least(F.ceil(n / PART), F.lit(MOST_PARTS)), F.ceil(n / LARGE_PART))
    return _dealt(members.select("band", "n", "node", "codes"), "band", parts).mapInArrow(starred, "a long, b long").distinct()


def similar_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of which sets of ascending distinct hashes are similar, from all their intersections."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    shared, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = counts[which] > 1
    column = (np.cumsum(counts > 1) - 1)[which[often]]
    row = row[often]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    width = max(1, _BLOCK // len(sets))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[low:high], column[low:high] - first] = 1
        common += (block @ block.T).astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes - common)


def _confirmed(found: DataFrame, distinct: DataFrame, rows: DataFrame, percent: int, shingle: int, folder: str) -> DataFrame:
    """Links (a, b) that connect what is similar within each component of ``found`` (node, root)."""
    named = stage(found.join(distinct.select("node", "text_sha256", "n_shingles"), "node"), f"{folder}/named")
    digests = named.select("text_sha256")
    _, perhaps = beside(rows, digests, ["text_sha256"])
    texts = perhaps.groupBy("text_sha256").agg(F.min("text").alias("text")).join(digests, "text_sha256", "left_semi")  # copies go before the shuffle

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES, 1 << 12):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("text_sha256"), pa.array(sets, pa.binary())], ["text_sha256", "shingles"])

    with small_batches(rows.sparkSession):
        sets = stage(texts.mapInArrow(hashed, "text_sha256 string, shingles binary"), f"{folder}/sets")

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, ["root", "i", "j"]):
            node = table.column("node").to_numpy()
            shingles = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if stop - start > 1:
                    similar = similar_pairs(shingles[start:stop], percent)
                    for hubs, reached in _reached(lambda x, y, similar=similar: similar[np.ix_(x, y)], stop - start):
                        a.append(node[hubs + start])
                        b.append(node[reached + start])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    totals = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    n = F.col("n")
    parts = F.greatest(F.least(F.ceil(n / PART), F.lit(MOST_PARTS)), F.ceil(n / LARGE_PART), F.ceil(F.col("total") / PART_SHINGLES))
    placed = named.join(totals, "root").join(sets, "text_sha256").select("root", "n", "total", "node", "shingles")
    with small_batches(rows.sparkSession):
        return stage(_dealt(placed, "root", F.least(parts, n)).mapInArrow(checked, "a long, b long"), f"{folder}/links")


def similar_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    more: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, stays and text_sha256 of every row.

    A text's set holds its distinct runs of ``shingle`` words (A-Z lower-cased); a text of fewer words is
    one run. Texts are linked if 100 * intersection >= ``percent`` * union (80 or more, see above), and
    ``component_id`` is the smallest id that links reach. ``kept`` says that it is the row's own id,
    ``stays`` marks one row of each component: that of the smallest id, null ids last, of several the
    first as read. A null or empty text, or one without a word, has no shingles and is linked with
    nothing, not even its like. Null ids take part; a component of null ids only has none itself.
    Repeated rows are linked like any equal texts. Other columns are ignored; an empty table gives an
    empty result. ``more`` may add candidate edges (a, b) between nodes of the distinct sets (node, bits).
    """
    folder = new_folder(docs.sparkSession, "minhash")
    text = F.col(text_col).cast("string")
    with small_batches(docs.sparkSession):
        prints = _prints(docs, percent, shingle, more is not None, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
        prints = stage(prints, f"{folder}/prints")
    worded = prints.where(F.col("key").isNotNull())
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = stage(worded.groupBy("key").agg(F.min(row).alias("first"), F.min("row").alias("node")), f"{folder}/classes")
    distinct = worded.where(F.col("bands").isNotNull()).join(classes.select("node"), worded["row"] == F.col("node"))
    distinct = stage(distinct.select("node", "text_sha256", "n_shingles", "bands", "codes", "bits"), f"{folder}/distinct")
    keyed = distinct.select("node", "codes", F.explode("bands").alias("band"))
    buckets = stage(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{folder}/buckets")
    _, perhaps = beside(keyed, buckets, ["band"])
    with small_batches(docs.sparkSession):
        edges = stage(_candidates(perhaps.join(buckets, "band"), percent), f"{folder}/edges")
    if more is not None:
        edges = edges.unionByName(more(distinct.select("node", "bits")))
    rows = docs.select(text_digest(text).alias("text_sha256"), text.alias("text"))
    links = _confirmed(components(edges), distinct, rows, percent, shingle, folder)
    roots = classes.join(components(links), "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    heads = roots.groupBy("root").agg(F.min("first").alias("head"))
    named = stage(roots.join(heads, "root").select("key", "head"), f"{folder}/heads")
    found = worded.join(named, "key").select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("stays"), "text_sha256")
    alone = prints.where(F.col("key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"), "text_sha256")
    both = found.unionByName(alone)
    return both.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays", "text_sha256")
