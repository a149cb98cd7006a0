"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound into
one vector by multiplying its letters' vectors, each permuted (rolled) by its distance from the
n-gram's end. A text is the bundle (sum) of its n-gram vectors; a language's prototype is the
bundle of all its learning texts. A text belongs to the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import remainder, slices

DIMENSIONS = 1024
ORDER = 3
PIECE_BYTES, PIECE_ROWS = 1 << 20, 256
#: Kinds of n-grams whose vectors are held at once.
TYPES_AT_ONCE = 8192
#: Language of texts without a letter.
UNKNOWN = "und"
#: Least cosine of a text that ``keep_known`` keeps, and the fewest n-grams from which it is asked for.
LEAST_SCORE, FEWEST_GRAMS = 0.1, 200
#: Prototypes go to every worker; more languages than this are refused.
MOST_LANGUAGES = 4096


@dataclass(frozen=True)
class Profiles:
    """Language prototypes, one row of ``vectors`` for each of ``languages`` (in order)."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    order: int = ORDER


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@cache
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    """Random +1/-1 vector of a letter; code 0 stands for any run of other characters."""
    return (np.random.default_rng([dimensions, code]).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


def bundles(texts: list[str | None], order: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Hypervector of each text, and how many n-grams went into it (none: no letter)."""
    padded = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    letter = _is_letter()[codes]
    kept = letter.copy()  # and the first of each run of other characters
    kept[:1] = True
    kept[1:] |= letter[:-1] | (rows[1:] != rows[:-1])
    codes, rows = np.where(letter, codes, 0)[kept].astype(np.int64), rows[kept]
    whole = len(codes) - order + 1
    if whole < 1:
        return np.zeros((len(texts), dimensions)), np.zeros(len(texts), np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))
    small = np.zeros(alphabet[-1] + 1, dtype=np.int64)
    small[alphabet] = np.arange(len(alphabet))
    letters, size = small[codes], len(alphabet)
    inside = rows[:whole] == rows[order - 1 :]
    grams = np.zeros(whole, dtype=np.int64)
    for k in range(order):
        grams = grams * size + letters[k : k + whole]
    grams, rows = grams[inside], rows[:whole][inside]
    if size**order <= 1 << 22:
        types = np.flatnonzero(np.bincount(grams))
        place = np.zeros(size**order, dtype=np.int64)
        place[types] = np.arange(len(types))
        grams = place[grams]
    else:
        types, grams = np.unique(grams, return_inverse=True)
    vectors = np.stack([_letter_vector(c, dimensions) for c in alphabet.tolist()])
    bundled = np.zeros((len(texts), dimensions), dtype=np.float64)
    if len(types) > TYPES_AT_ONCE:
        by_type = np.argsort(grams, kind="stable")
        grams, gram_rows = grams[by_type], rows[by_type]
    else:
        gram_rows = rows
    for first in range(0, len(types), TYPES_AT_ONCE):
        rest = types[first : first + TYPES_AT_ONCE]
        many = len(rest)
        bound = np.ones((many, dimensions), dtype=np.int8)
        for k in range(order):
            bound *= np.roll(vectors[rest % size], k, axis=1)
            rest = rest // size
        low, high = (0, len(grams)) if many == len(types) else np.searchsorted(grams, [first, first + many])
        counts = np.bincount(gram_rows[low:high] * many + grams[low:high] - first, minlength=len(texts) * many)
        bundled += counts.reshape(len(texts), many).astype(np.float32) @ bound.astype(np.float32)
    return bundled, np.bincount(rows, minlength=len(texts))


def learn(
    docs: DataFrame,
    modulus: int = 4,
    held_out: int = 2,
    order: int = ORDER,
    dimensions: int = DIMENSIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Profiles:
    """Prototypes of all documents with a language whose id is not held out.

    Each task bundles its texts, so what is shuffled is one row per task, language and dimension;
    the driver gets languages x dimensions numbers. Null texts and languages are passed over; an
    empty table gives no prototypes.
    """

    def bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in slices(batches, "text", PIECE_BYTES, PIECE_ROWS):
            vectors, _ = bundles(piece.column("text").to_pylist(), order, dimensions)
            languages = np.array(piece.column("lang").to_pylist(), dtype=object)
            for name in set(languages):
                part = vectors[languages == name].astype(np.int64).sum(axis=0)
                sums[name] = sums.get(name, 0) + part
        if sums:
            values = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), values], ["lang", "vector"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (remainder(F.col(id_col), modulus) != held_out))
    parts = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(
        bundled, "lang string, vector array<bigint>"
    )
    summed = (
        parts.select("lang", F.posexplode("vector").alias("dimension", "value"))
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
    )
    found = summed.limit(MOST_LANGUAGES * dimensions + 1).toArrow().to_pandas()
    if len(found) > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(set(found["lang"])))
    vectors = np.zeros((len(languages), dimensions), dtype=np.float64)
    vectors[np.searchsorted(languages, found["lang"].to_numpy(dtype=str)) if languages else [], found["dimension"]] = found["value"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles(languages, (vectors / np.where(norms > 0, norms, 1)).astype(np.float32), order)


def _cosines(vectors: np.ndarray, profiles: Profiles) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1)
    return vectors @ profiles.vectors.T / np.where(norms > 0, norms, 1)[:, None]


def _judged(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    vectors, grams = bundles(texts, profiles.order, profiles.vectors.shape[1])
    seen = (grams > 0) & bool(profiles.languages)
    cosines = _cosines(vectors, profiles)
    best = cosines.argmax(axis=1) if profiles.languages else np.zeros(len(grams), dtype=int)
    names = [profiles.languages[b] if s else UNKNOWN for b, s in zip(best, seen)]
    return names, np.where(seen, np.clip(cosines.max(axis=1, initial=0), 0, 1), 0).astype(np.float64)


def predict(
    docs: DataFrame, profiles: Profiles, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) of every document.

    A null text, one without a letter, and any text when nothing was learned: ``und`` and 0. Of
    equal cosines the language first in the alphabet is taken. One row per input row, repeated rows
    too; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES, PIECE_ROWS):
            names, scores = _judged(piece.column("text").to_pylist(), shared.value)
            columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col(id_col).alias("doc_id"), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    fields = [*rows.drop("text").schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(scored, T.StructType(fields))


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is in a learned language.

    Null and empty texts and those without a letter go, and so do texts of ``FEWEST_GRAMS`` n-grams or
    more whose best cosine is below ``least``: chance gives unlike letters one of 0.03, and of 10,000
    texts in learned languages only texts of one to four words have less than 0.1. Where nothing was
    learned, every text with a letter stays. Repeated rows stay each, other columns of any name are carried along; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, PIECE_BYTES, PIECE_ROWS):
            vectors, grams = bundles(piece.column(text_col).to_pylist(), shared.value.order, shared.value.vectors.shape[1])
            stays = grams > 0
            if shared.value.languages:
                stays &= (grams < FEWEST_GRAMS) | (_cosines(vectors, shared.value).max(axis=1) >= least)
            yield piece.filter(pa.array(stays))

    return docs.mapInArrow(kept, docs.schema)
