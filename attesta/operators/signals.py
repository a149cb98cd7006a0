"""Ownership, affiliation and founding statements found by fixed phrases.

Each page is one row. Matches are marked in the text by ``regexp_replace``, so that their offsets
are known, and the sentence around each is cut out as its verbatim quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numbers import let
from attesta.operators.sentences import tidy_quote

# The phrases, in order of evaluation. ORG is a capitalised name of up to six words,
# CORP_ORG one that ends in a corporate form.
_NAME = r"[A-Z][\w&'’.-]*(?:[ /-][A-Z0-9][\w&'’.-]*){0,5}"
_FORMS = (
    r"(?:LLC|L\.L\.C\.|Inc\.?|Corp\.?|Corporation|Co\.|Ltd\.?|Group|Holdings|Partners|Capital|Company"
    r"|Companies|Enterprises|Industries|Equity|Ventures)"
)
_CORPORATE = (
    r"(?:LLC|L\.L\.C\.|Inc\.?|Corp\.?|Corporation|Ltd\.?|Group|Holdings|Partners|Capital|Equity"
    r"|Ventures|Companies|Industries)"
)
ORG = rf"{_NAME}(?:,? {_FORMS})?"
CORP_ORG = rf"{_NAME},? {_CORPORATE}"
# A phrase begins with a look at its first two characters: word edges and letter classes are slow to test at every place.
# Where case does not count, the look names every letter that folds to the ones it stands for.
PHRASES = (
    ("affiliations", "brand", rf"(?U)(?=[ia]s)\b(?:is|as) (?:a |the )?(?:leading |flagship |premier )?brand of ({ORG})"),
    ("affiliations", "subsidiary",
     rf"(?U)(?=[iatwsd][s hui])\b(?:is )?(?:a |the )?(?:wholly[- ]owned )?(subsidiary|division) of ({ORG})"),
    ("affiliations", "owned", rf"(?U)(?=[oa][wc])\b(owned|acquired) by ({CORP_ORG})"),
    ("affiliations", "company_owned",
     r"(?iU)(?-iU:(?=[cC][oO]))\bcompany-owned (?:locations?|branches|service centers?) across ([^.\n]{2,60})"),
    ("affiliations", "franchise",
     rf"(?U)(?=[ofaie][wr na])\b(?:owned and operated franchise|franchisee|a franchise of {ORG}"
     r"|independently owned and operated franchise"
     r"|each (?:location|franchise) is independently owned and operated)"),
    ("ownership_leadership", "family",
     r"(?iU)(?-iU:(?=[fFoOlL][aAwWoO]))\b(?:family[- ](?:owned|run|operated)|owner[- ]operated|locally owned and operated)\b"),
    ("founding_history", "since",
     r"(?iU)(?-iU:(?=[sSſeEfF][iIıİsSſoOeE]))\b(?:since|established in|founded in|est\.?|serving [^.\n]{0,40} since) ((?:19|20)\d{2})\b"),
    ("founding_history", "years",
     r"(?iU)(?-iU:(?=[oOmMnNfF][vVoOeE]))\b(?:over|more than|nearly|for) (\d{2})\+? years (?:of |in )(?:business|experience|service)"),
)
# Signs of a customer's words rather than the company's.
TESTIMONIAL = (
    r"""(?iU)["“”]|★|\breview(?:s|ed)?\b|\btestimonial|\bstars?\b|\brated\b|\bthank you\b"""
    r"|\bhighly recommend\b|\bmy (?:home|house|unit|ac|system)\b"
    r"|\bI (?:called|had|was|am|have|would|highly)\b|\bthey (?:were|came|did|showed|are|fixed)\b"
)
MAX_PER_PHRASE = 2
QUOTE_LIMIT = 200
MIN_QUOTE = 12
SIGNAL_CONFIDENCE = 0.9

_OPEN, _CLOSE = "\x02", "\x03"


def _matches(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as (start, hit): characters before it, and the matched text."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def lengths(all_pieces: Column) -> Column:
        rest = F.slice(all_pieces, 2, F.greatest(F.size(all_pieces) - 1, F.lit(0)))
        start = F.struct(
            F.length(all_pieces[0]).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("found"))

        def step(state: Column, piece: Column) -> Column:
            hit = F.substring_index(piece, _CLOSE, 1)
            return F.struct(
                (state["at"] + F.length(piece) - 1).alias("at"),
                F.array_append(state["found"], F.struct(state["at"].alias("start"), hit.alias("hit"))).alias("found"))

        return F.aggregate(rest, start, step, lambda state: state["found"])

    return let(pieces, lengths)


def _quote(text: Column, start: Column, hit: Column) -> Column:
    """The sentence around a match; beyond 200 characters, a stretch around it cut between words."""
    before = F.substring(text, F.lit(1), start)
    for end in (". ", "\n", "! ", "? "):
        before = F.substring_index(before, end, -1)
    after = F.regexp_extract(
        F.substring(text, start + F.length(hit) + 1, F.length(text)),
        r"(?s)^(.*?(?:\.(?=[ \n])|[!?]|(?=\n)|$))", 1)

    def shorten(s: Column) -> Column:
        room = F.greatest(F.lit(QUOTE_LIMIT) - F.length(hit), F.lit(0))
        left = F.least(F.length(s["before"]), F.floor(room / 2).cast("int"))
        right = F.least(F.length(s["after"]), room - left)
        lead = F.right(s["before"], left)
        cut_left = left < F.length(s["before"])
        lead = F.when(cut_left & lead.contains(" "), F.regexp_extract(lead, r"(?s)^.*? (.*)$", 1)).otherwise(lead)
        tail = F.substring(s["after"], F.lit(1), right)
        cut_right = right < F.length(s["after"])
        tail = F.when(cut_right & tail.contains(" "), F.regexp_extract(tail, r"(?s)^(.*) ", 1)).otherwise(tail)
        whole = F.length(s["before"]) + F.length(hit) + F.length(s["after"]) <= QUOTE_LIMIT
        return F.when(whole, F.concat(s["before"], hit, s["after"])).otherwise(F.concat(lead, hit, tail))

    return tidy_quote(let(F.struct(before.alias("before"), after.alias("after")), shorten))


def _statement(kind: str, pattern: str, hit: Column) -> Column:
    group = lambda n: F.regexp_extract(hit, pattern, n)
    name = lambda n: F.regexp_replace(F.trim(group(n)), "[.,;: ]+$", "")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return {
        "brand": lambda: say("The company describes itself as a brand of ", name(1), "."),
        "subsidiary": lambda: say("The company describes itself as a ", F.lower(group(1)), " of ", name(2), "."),
        "owned": lambda: say("The company states it is ", F.lower(group(1)), " by ", name(2), "."),
        "company_owned": lambda: say("The company operates company-owned locations across ", F.trim(group(1)), "."),
        "franchise": lambda: say("The company describes itself as a franchise or franchisee."),
        "family": lambda: say("The company describes itself as ", F.lower(hit), "."),
        "since": lambda: say("The page states the business has operated since ", group(1), "."),
        "years": lambda: say("The page mentions ", group(1), "+ years of business or experience."),
    }[kind]()


def page_signals(text: Column) -> Column:
    """Array of (category, fact, evidence_quote) for one page: at most two per phrase, a quote once."""

    def of_phrase(category: str, kind: str, pattern: str, body: Column) -> Column:
        hits = F.transform(
            _matches(body, pattern),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), F.lit(category).alias("category"),
                _statement(kind, pattern, m["hit"]).alias("fact"),
                _quote(body, m["start"], m["hit"]).alias("evidence_quote")))
        return F.filter(
            hits, lambda h: (F.length(h["evidence_quote"]) >= MIN_QUOTE) & ~h["evidence_quote"].rlike(TESTIMONIAL))

    row = "struct<kind:string,category:string,fact:string,evidence_quote:string>"
    none = F.array().cast(f"array<{row}>")

    def keep(kept: Column, hit: Column) -> Column:
        quoted = F.exists(kept, lambda k: F.lower(k["evidence_quote"]) == F.lower(hit["evidence_quote"]))
        full = F.size(F.filter(kept, lambda k: k["kind"] == hit["kind"])) >= MAX_PER_PHRASE
        return F.when(quoted | full, kept).otherwise(F.array_append(kept, hit))

    body = F.translate(text, _OPEN + _CLOSE, "  ")
    found = let(
        body, lambda b: F.concat(*[F.coalesce(of_phrase(c, k, p, b), none) for c, k, p in PHRASES]))
    return F.aggregate(found, none, keep)


def signal_facts(pages: DataFrame) -> DataFrame:
    """Signals of every page (…, url, text), one row each, in order of discovery."""
    kept = [c for c in pages.columns if c != "text"]
    return pages.select(*kept, F.posexplode(page_signals(F.col("text"))).alias("signal_pos", "s")).select(
        *kept, "signal_pos", "s.category", "s.fact", "s.evidence_quote",
        F.col("url").alias("source_url"), F.lit(SIGNAL_CONFIDENCE).alias("confidence"))
