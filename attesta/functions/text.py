"""Text column helpers: matching form, hashes, slugs and small repairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.numbers import let

_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"

# Eligibility of a quote for matching.
MIN_QUOTE_CHARS = 12
MIN_QUOTE_TOKENS = 3


# Text of other code points only is folded right by plain lower-casing: Latin up to U+017F and the
# general dashes, quotes and dots, whose compatibility forms are all punctuation, except for the Latin
# letters and figures that have a compatibility or folded form (ªº²³¹µ¼½¾İĲĳĿŀŉſ). Nearly every character
# is passed by at the first range; a class of all the ranges would be gone through for each.
_FOLDED = (
    r"[^\x00-\xA9](?<![\xAB-\xB1\xB4\xB6-\xB8\xBB\xBF-\x{12F}\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{2010}-\x{2027}])")


@F.pandas_udf(T.StringType())
def _fold_exactly(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")


def _fold(text: Column) -> Column:
    """NFKC plus case folding, up to punctuation.

    ASCII and ordinary Latin text stays in the JVM (the sharp s is folded explicitly). Rows with
    anything else go through one Arrow call; the other rows reach Python as nulls.
    """
    odd = (F.octet_length(text) != F.length(text)) & text.rlike(_FOLDED)
    jvm = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_fold_exactly(F.when(odd, text)), jvm)


def normalize(text: Column) -> Column:
    """Matching form: folded, punctuation to blanks, blanks collapsed, trimmed; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(_fold(text), r"[^\p{L}\p{N}_]+", " ")), F.lit(""))


def normalize_plain(text: Column) -> Column:
    """Matching form of text known to be plain (usable inside lambdas)."""
    words = F.regexp_replace(
        F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_\s\p{Z}]", " ")
    return F.coalesce(F.trim(F.regexp_replace(words, _SPACE, " ")), F.lit(""))


def quote_eligible(norm_quote: Column) -> Column:
    """Long enough to be evidence: 12 characters, 3 tokens, one of them purely alphabetic."""
    tokens = F.split(norm_quote, " ")
    return (
        (F.length(norm_quote) >= MIN_QUOTE_CHARS)
        & (F.size(tokens) >= MIN_QUOTE_TOKENS)
        & F.exists(tokens, lambda t: t.rlike(r"^\p{L}+$"))
    )


def numbers_present(needle: Column, haystack: Column) -> Column:
    """Every digit run of ``needle`` is a digit run of ``haystack``."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0))
    return F.size(F.array_except(runs(needle), runs(haystack))) == 0


def clean(value: Column) -> Column:
    """Trimmed value, null when blank."""
    return F.nullif(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, _SPACE, " "))


def strip_nul(value: Column) -> Column:
    return F.translate(value, "\x00", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def description_hash(text: Column) -> Column:
    return F.sha2(F.lower(collapse(text)), 256)


def slug(value: Column) -> Column:
    """Lower-case identifier of at most 48 characters, ``criterion`` when nothing is left."""
    body = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")
    body = F.substring(F.regexp_replace(body, "^_+|_+$", ""), 1, 48)
    return let(body, lambda b: F.when(b == "", F.lit("criterion")).otherwise(b))


def strip_markers(note: Column) -> Column:
    """Remove ``[F<n>]`` references and the blanks they leave before punctuation."""
    bare = F.regexp_replace(note, r"\s*\[F\d+\]", " ")
    bare = F.replace(F.replace(bare, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))
    return F.regexp_replace(bare, r"^\s+|\s+$", "")
