"""Hard negatives for embedding training: a secondary-sort shuffle and a streaming iterator.

Pair scores are packed into (anchor, descending score, id) keys, dealt out by anchor and sorted within
partitions. One pass over a partition then reads every anchor's pairs from the best down: each of the
first positives opens a window of scores, and the rows of other labels that fall into an open window
are its negatives. The pass holds an anchor's open windows and no pairs.

Scores are worked out in blocks: blocks of rows meet blocks of anchors, dealt over salts, so that no
key names a hot anchor or label. A block hands on only pairs that can be in the result: its own best
positives, then, with every anchor's windows known, its own first negatives of each window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import new_folder, stage

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares (percent) of the positive's score.
LOW, HIGH = 30, 90
SCALE = 256
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
ANCHOR_ROWS, ANCHOR_BYTES = 512, 1 << 18
#: Scores below this are exact in double arithmetic with room for a row's place beside them.
_EXACT = 1 << 50
#: Stands for a null id in blocks: after every other id.
_NO_ID = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min

_BLOCK = "size int, places binary, ids binary, labels binary, vectors binary, windows binary"
_PAIRS = "anchor long, anchor_id long, score long, id long, place long"


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """place (of the row), id, label and vector of every row that takes part."""
    raw = F.col(vector_col).cast("array<double>")
    finite = F.forall(raw, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = vectors.where(F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), raw.alias("vector")
    )


def _blocks(rows: DataFrame, scale: int, most_rows: int, most_bytes: int) -> DataFrame:
    """``rows`` in blocks of equally long vectors, scaled to whole numbers; a block's rows in order of id."""
    windows = "windows" in rows.columns

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                own = waiting.setdefault(size, [])
                own.append(batch.filter(pa.array(sizes == size)))
                room = max(1, min(most_rows, most_bytes // (8 * max(size, 1))))
                if sum(b.num_rows for b in own) >= room:
                    table = pa.Table.from_batches(own)
                    full = table.num_rows // room * room
                    yield from (_pack(table.slice(at, room), size, scale, windows) for at in range(0, full, room))
                    waiting[size] = table.slice(full).to_batches()
        for size, own in waiting.items():
            if sum(b.num_rows for b in own):
                yield _pack(pa.Table.from_batches(own), size, scale, windows)

    return rows.mapInArrow(packed, _BLOCK)


def _pack(table: pa.Table, size: int, scale: int, windows: bool) -> pa.RecordBatch:
    table = table.combine_chunks()
    ids = table.column("id").fill_null(_NO_ID).to_numpy()
    order = np.lexsort((table.column("place").to_numpy(), ids))
    vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), size)[order]
    vectors = np.floor(np.clip(vectors, -1e300, 1e300) * scale)
    if np.abs(vectors).max(initial=0) < 1 << 24:
        vectors = vectors.astype(np.float32)
    parts = [table.column("place").to_numpy()[order], ids[order], table.column("label").to_numpy()[order], vectors]
    if windows:
        parts.append(table.column("windows").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order])
    packed = [pa.array([p.tobytes()], pa.binary()) for p in parts]
    if not windows:
        packed.append(pa.array([b""], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *packed], ["size", "places", "ids", "labels", "vectors", "windows"])


class _Block:
    def __init__(self, size: int, places: bytes, ids: bytes, labels: bytes, vectors: bytes, windows: bytes):
        self.places, self.ids, self.labels = (np.frombuffer(x, dtype=np.int64) for x in (places, ids, labels))
        kind = np.float32 if len(vectors) == 4 * size * len(self.ids) else np.float64
        self.vectors = np.frombuffer(vectors, dtype=kind).reshape(len(self.ids), size).astype(np.float64) if size else np.zeros((len(self.ids), 0))
        self.windows = np.frombuffer(windows, dtype=np.int64).reshape(len(self.ids), -1) if windows else None


def _scores(anchors: _Block, rows: _Block) -> np.ndarray:
    """Exact inner products; beyond 64 bits the nearest number that 64 bits hold."""
    most = anchors.vectors.shape[1] * np.abs(anchors.vectors).max(initial=0) * np.abs(rows.vectors).max(initial=0)
    if most < _EXACT:
        return (anchors.vectors @ rows.vectors.T).astype(np.int64)
    whole = [np.array([int(x) for x in b.vectors.ravel().tolist()], dtype=object).reshape(b.vectors.shape) for b in (anchors, rows)]
    return np.clip(whole[0].dot(whole[1].T), _NONE + 1, _NO_ID).astype(np.int64)


def _first(scores: np.ndarray, allowed: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and row numbers of each anchor's ``many`` best allowed rows; of equal scores the earlier row."""
    width = scores.shape[1]
    if np.abs(scores).max(initial=0) < _EXACT:
        key = np.where(allowed, scores << 12 | (4095 - np.arange(width)), _NONE)
        if width > many:
            at = np.argpartition(key, width - many, axis=1)[:, width - many :]
        else:
            at = np.broadcast_to(np.arange(width), scores.shape)
        anchor = np.repeat(np.arange(len(scores)), at.shape[1])
        found = allowed[anchor, at.ravel()]
        return anchor[found], at.ravel()[found]
    pairs = [(a, r) for a in range(len(scores)) for r in sorted(np.flatnonzero(allowed[a]).tolist(), key=lambda r: (-scores[a, r], r))[:many]]
    return np.array([a for a, _ in pairs], dtype=np.int64), np.array([r for _, r in pairs], dtype=np.int64)


def _meet(rows: DataFrame, anchors: DataFrame, kept, salts: int) -> DataFrame:
    """Pairs that ``kept`` (anchor block, row block) chooses of each two blocks of one vector length."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("places"), F.lit(salts)))
    spread = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    names = [c for c in rows.columns if c != "size"]
    both = dealt.join(spread.withColumnsRenamed({c: f"a_{c}" for c in names}), ["salt", "size"])

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("size", *names, *(f"a_{c}" for c in names))]
            for i in range(batch.num_rows):
                size, *values = (c[i].as_py() for c in columns)
                row, anchor = _Block(size, *values[:5]), _Block(size, *values[5:])
                scores = _scores(anchor, row)
                a, r = kept(anchor, row, scores)
                found = [anchor.places[a], anchor.ids[a], scores[a, r], row.ids[r], row.places[r]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["anchor", "anchor_id", "score", "id", "place"])

    return both.mapInArrow(met, _PAIRS)


def mine(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = SCALE,
    every: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are rows whose id is divisible by ``every``. A score is the
    integer inner product of vectors with components floor(scale * x); higher ones come first, of equal
    ones the smaller id. An anchor's positives are its first other rows of its label. A negative has
    another label and a score of ``low`` to ``high`` percent of the positive's.

    Rows with a null label or vector, or with a null or non-finite component, take no part. A null id is
    after every other (and 2**63 - 1 counts as one); repeated rows are rows of their own, so another row with the anchor's id can
    be its positive. Vectors of different lengths do not meet; vectors without components score zero. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    folder, salts = new_folder(spark, "negatives"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(_taking_part(vectors, id_col, vector_col, label_col), f"{folder}/rows")
    chosen = rows.where(F.col("id") % every == 0)
    blocks = stage(_blocks(rows, scale, BLOCK_ROWS, BLOCK_BYTES), f"{folder}/blocks")

    def best(anchor: _Block, row: _Block, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = (anchor.labels[:, None] == row.labels) & (anchor.places[:, None] != row.places)
        return _first(scores, same, positives)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "place")
    found = _meet(blocks, _blocks(chosen, scale, ANCHOR_ROWS, ANCHOR_BYTES), best, salts)
    found = stage(found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).drop("nth"), f"{folder}/positives")
    windows = found.groupBy(F.col("anchor").alias("place")).agg(F.sort_array(F.collect_list("score"), False).alias("scores"))  # at most ``positives`` each
    padded = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at("scores", k), F.lit(int(_NONE))))
    opened = chosen.join(windows, "place").withColumn("windows", padded).drop("scores")

    def hard(anchor: _Block, row: _Block, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = anchor.labels[:, None] != row.labels
        pairs = []
        for k in range(positives):
            least, most = _bounds(anchor.windows[:, k], low, high)
            pairs.append(_first(scores, other & (scores >= least[:, None]) & (scores <= most[:, None]), negatives))
        codes = np.unique(np.concatenate([a * scores.shape[1] + r for a, r in pairs]))
        return codes // scores.shape[1], codes % scores.shape[1]

    others = _meet(blocks, _blocks(opened, scale, ANCHOR_ROWS, ANCHOR_BYTES), hard, salts)
    pairs = found.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    keyed = pairs.select("anchor", (-F.col("score")).alias("descending"), "id", "place", "positive", "anchor_id")
    sorted_pairs = keyed.repartition("anchor").sortWithinPartitions("anchor", "descending", "id", "place")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return sorted_pairs.mapInArrow(lambda batches: _stream(batches, low, high, negatives), schema)


def _bounds(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole score of each positive's window; an empty window where there is no positive."""
    whole = scores.astype(object)
    least, most = -((-low * whole) // 100), (high * whole) // 100
    return np.where(scores == _NONE, 1, least).astype(np.int64), np.where(scores == _NONE, 0, most).astype(np.int64)


def _stream(batches: Iterable[pa.RecordBatch], low: int, high: int, most: int) -> Iterator[pa.RecordBatch]:
    """Negatives of pairs in the order of their keys.

    Held at a time: an anchor's windows, and the first negatives of the score just read, which a
    positive of that same score (zero) may still claim.
    """
    anchor, windows, tied, tied_at = None, [], [], None
    out: list[tuple] = []
    for batch in batches:
        for place, descending, row, positive, name in zip(*(batch.column(c).to_pylist() for c in ("anchor", "descending", "id", "positive", "anchor_id"))):
            score = -descending
            if place != anchor:
                anchor, windows, tied_at = place, [], None
            if score != tied_at:
                tied, tied_at = [], score
            row = None if row == _NO_ID else row
            if positive:
                windows.append([row, score, 0])
            elif len(tied) < most:
                tied.append(row)
            for window in windows[-1:] if positive else windows:
                if low * window[1] <= 100 * score <= high * window[1]:
                    for negative in tied if positive else [row]:
                        if window[2] < most:
                            window[2] += 1
                            out.append((name, window[0], window[2], negative, window[1], score))
        if len(out) >= 10_000:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def mine_sql(table: str = "embeddings") -> str:
    """DuckDB SQL for the query over ``table``."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS vec
  FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, r.place, r.vec_id, a.label = r.label AS same,
         CAST(list_dot_product(a.vec, r.vec) AS BIGINT) AS score
  FROM v a JOIN v r ON a.place <> r.place AND len(a.vec) = len(r.vec)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, place) <= {POSITIVES}
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id, s.place) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
