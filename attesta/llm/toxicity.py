"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words (and their beginnings, which inflected forms share), pairs
of neighbours, and pairs with one word skipped. Each coordinate has its own learning rate, and the
L1 term keeps most weights at zero, so that the model is a short list of (place, weight) pairs.
Words are lower-cased and stripped of punctuation.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import Words, mix, remainder, slices
from attesta.session import new_folder, stage

#: Places of the hashed weights: 2 to this power, which also bounds the broadcast model.
BITS = 22
PIECE_BYTES = 1 << 20
BEGINNING = 4
#: Scores from here on are toxic.
THRESHOLD = 0.7
_WORD, _BEGIN, _SKIP = (np.array([k], dtype=np.uint64) for k in (1, 2, 3))


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed place of every feature occurrence, repeats included."""
    words = Words(texts)
    plain = [w.lower().strip(string.punctuation) or w for w in words.vocabulary.to_pylist()]
    digest = xxhash.xxh64_intdigest
    whole = np.array([digest(w) for w in plain], dtype=np.uint64)
    begun = np.array([digest(w[:BEGINNING]) for w in plain], dtype=np.uint64)
    word, rows = whole[words.codes], words.rows
    near, far = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    hashes = [
        mix(whole, _WORD)[words.codes],
        mix(begun, _BEGIN)[words.codes],
        mix(word[:-1], word[1:])[near],
        mix(mix(whole, _SKIP)[words.codes][:-2], word[2:])[far],
    ]
    places = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([rows, rows, rows[:-1][near], rows[:-2][far]]), places


def ftrl(
    examples: list[tuple[np.ndarray, int]], alpha: float, beta: float, l1: float, l2: float, epochs: int
) -> Model:
    """FTRL-proximal over ``examples`` (distinct places, label), in order, ``epochs`` times.

    Label 1 weighs as much in sum as label 0.
    """
    ones = sum(label for _, label in examples)
    weight = (1.0, (len(examples) - ones) / ones if 0 < ones < len(examples) else 1.0)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.where(at == bias, 0.0, l1)
        here = z[at]
        return np.where(np.abs(here) > shrunk, (np.sign(here) * shrunk - here) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for places, label in examples:
            at = np.append(places, bias)
            w = weights(at)
            slope = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight[label]
            squared = n[at]
            z[at] += slope - (np.sqrt(squared + slope * slope) - np.sqrt(squared)) / alpha * w
            n[at] = squared + slope * slope
    places = np.flatnonzero(np.abs(z[:bias]) > l1)
    return Model(places, weights(places), float(weights(np.array([bias]))[0]))


def _last_places(sizes: pa.Table, most_features: int) -> dict[int, int]:
    """Of either label the last place, in order, up to which documents are learned from."""
    place, label, size = (sizes.column(c).to_numpy().astype(np.int64) for c in ("place", "label", "size"))
    order = np.lexsort((place, label))
    place, label, size = place[order], label[order], size[order]
    counts = np.bincount(label, minlength=2)
    share = (np.arange(len(label)) - np.where(label == 1, counts[0], 0) + 1) / counts[label]
    order = np.lexsort((label, share))
    taken = order[np.cumsum(size[order]) <= most_features]
    return {y: int(place[taken][label[taken] == y].max()) for y in (0, 1) if (label[taken] == y).any()}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 3,
    held_out: int = 1,
    most_per_label: int = 10_000,
    most_features: int = 50_000_000,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 20.0,
    l2: float = 0.0,
    epochs: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Weights learned from at most ``most_per_label`` labelled documents of either label.

    The sample is the documents with the smallest hashes of their ids among those not held out, so
    it is the same on every run. Learning is one task; the sample and ``most_features`` (distinct
    features of all its documents) bound it: a sample with more is cut in the order of the same
    hashes, at the same share of either label's documents. Of several
    labels of an id the largest counts, of several texts the first in order. Null ids, labels and
    texts are passed over; without a labelled document the model is empty and every score 0.5.
    """
    one_label = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    known = one_label.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("label") == y).orderBy("place", "doc_id").limit(most_per_label) for y in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    rows = (
        texts.join(F.broadcast(sample), "doc_id")  # at most 2 * most_per_label ids
        .groupBy("doc_id", "label", "place")
        .agg(F.min("text").alias("text"))
    )

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            at, places = features(piece.column("text"))
            pairs = np.unique(at << BITS | places)
            ends = np.searchsorted(pairs >> BITS, np.arange(piece.num_rows), "right")
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column("place"), piece.column("label"), lists], ["place", "label", "places"])

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for place, label, places in zip(batch.column("place").to_pylist(), batch.column("label").to_pylist(), batch.column("places")):
                found.append((place, label, places.values.to_numpy()))
        found.sort(key=lambda x: (x[0], x[1]))
        model = ftrl([(places, label) for _, label, places in found], alpha, beta, l1, l2, epochs)
        columns = [pa.array([model.places.tolist()], pa.list_(pa.int32())), pa.array([model.weights.tolist()], pa.list_(pa.float64())), pa.array([model.bias])]
        yield pa.RecordBatch.from_arrays(columns, ["places", "weights", "bias"])

    schema = T.StructType([rows.schema["place"], rows.schema["label"], T.StructField("places", T.ArrayType(T.IntegerType()))])
    extracts = stage(rows.select("place", "label", "text").mapInArrow(extracted, schema), new_folder(docs.sparkSession, "features"))
    sizes = extracts.select("place", "label", F.size("places").alias("size"))
    if (sizes.agg(F.sum("size")).first()[0] or 0) > most_features:
        last = _last_places(sizes.toArrow(), most_features)  # at most 2 * most_per_label rows
        extracts = extracts.where(reduce(or_, [(F.col("label") == y) & (F.col("place") <= p) for y, p in last.items()], F.lit(False)))
    model = extracts.repartition(1).mapInArrow(trained, "places array<int>, weights array<double>, bias double").first()
    return Model(np.array(model["places"], dtype=np.int64), np.array(model["weights"], dtype=np.float64), model["bias"])


def _dense(model: Model) -> np.ndarray:
    weights = np.zeros(1 << BITS)
    weights[model.places] = model.weights
    return weights


def _probabilities(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    rows, places = features(texts)
    weighted = weights[places] != 0
    pairs = np.unique(rows[weighted] << BITS | places[weighted])
    sums = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def score(
    docs: DataFrame,
    model: Model,
    modulus: int = 3,
    held_out: int = 1,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score at ``threshold`` or more) of every row.

    Null and empty texts have the score of no feature at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        for piece in slices(batches, "text", PIECE_BYTES):
            weights = _dense(shared.value) if weights is None else weights
            found = _probabilities(piece.column("text"), weights, shared.value.bias)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    schema = T.StructType([*rows.drop("text").schema, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        for piece in slices(batches, text_col, PIECE_BYTES):
            weights = _dense(shared.value) if weights is None else weights
            yield piece.filter(pa.array(_probabilities(piece.column(text_col), weights, shared.value.bias) < threshold))

    return docs.mapInArrow(kept, docs.schema)
