"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

All of it is one projection of built-in functions over the text: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import GAP
from attesta.session import with_computed

HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: A line of at least this many characters other than blanks fails above this share of marks.
DENSE_CHARS, DENSE_PERCENT = 20, 20
MARKS = r"!-/:-@\[-`{-~"
#: Lines of entries between separators: so many separators, and so few words an entry.
SEPARATORS, ENTRY_WORDS = 2, 4
SEPARATOR = r"[|»›•·]"
MENU = (
    r"^(home|menu|log ?in|sign (in|up)|search|skip to (main )?content|next|previous|back to top|share|contact( us)?"
    r"|about( us)?|sitemap|help|faq)\.?$"
)
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "newsletter", "subscribe",
    "click here", "read more", "enable javascript", "copyright", "©",
)
#: No menu entry is longer.
MENU_CHARS = 30
#: Documents that lose more than this share of their characters are rejected.
MOST_LOST_PERCENT = 50
FEWEST_WORDS = 50


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _without(text: Column, characters: str) -> Column:
    """The text without any of a few single characters; cheaper than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, though used several times."""
    return F.transform(F.array(value), use)[0]


def _judged(line: Column) -> Column:
    """The line, its characters other than blanks, and whether a rule fails it.

    The rules: nothing but marks, too many marks, entries of a menu, boilerplate.
    """
    chars = F.length(_without(line, BLANKS))
    marks = chars - F.length(F.regexp_replace(line, rf"[\x20\x09-\x0D{MARKS}]+", ""))
    separators = F.when(line.rlike(SEPARATOR), _count(line, SEPARATOR)).otherwise(F.lit(0))
    facts = F.struct(chars.alias("chars"), marks.alias("marks"), separators.alias("separators"), F.lower(line).alias("low"))

    def verdict(f: Column) -> Column:
        bare = f["marks"] == f["chars"]
        dense = (f["chars"] >= DENSE_CHARS) & (f["marks"] * 100 > f["chars"] * DENSE_PERCENT)
        entries = (f["separators"] >= SEPARATORS) & (F.size(_words(line)) <= (f["separators"] + 1) * ENTRY_WORDS)
        menu = (f["chars"] <= MENU_CHARS) & F.regexp_replace(f["low"], f"^{GAP}|{GAP}$", "").rlike(MENU)
        fails = bare | dense | entries | menu
        for phrase in BOILERPLATE:
            fails = fails | f["low"].contains(phrase)
        return F.struct(line.alias("line"), f["chars"].alias("chars"), fails.alias("fails"))

    return _bound(facts, verdict)


def _repeated(words: Column) -> Column:
    """Words in windows of three that are in the text twice or more.

    Equal windows have equal hashes, so a text whose hashes all differ needs no sorting.
    """
    last = F.size(words) - 3
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    windows = F.transform(places, lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i")))

    def starts(ordered: Column) -> Column:
        alike = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]))
        found = _bound(alike, lambda e: F.filter(ordered, lambda x, k: F.coalesce(F.get(e, k), F.lit(False)) | F.coalesce(F.get(e, k - 1), F.lit(False))))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    exact = _bound(_bound(F.sort_array(windows), starts), covered)
    return _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_failed_lines, lost_percent, kept and cleaned_text of every row.

    Lines without a word count neither as lines nor as lost. ``cleaned_text`` holds the lines that
    pass all rules. A null or empty text, or one of blanks, has zeros, fails and cleans to empty.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_computed(rows, "words", _words(F.col("text")))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD)), _judged)
    rows = with_computed(rows, "lines", lines)
    counted = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["chars"]).otherwise(0)).alias("lost"),
        F.array_join(F.filter("lines", lambda x: ~x["fails"])["line"], "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost") * 100 <= F.col("word_chars") * MOST_LOST_PERCENT))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines",
        F.coalesce(F.floor(F.col("lost") * 100 / F.when(F.col("word_chars") > 0, F.col("word_chars"))), F.lit(0)).cast("long").alias("lost_percent"),
        "kept", "cleaned_text",
    )


def clean_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``clean`` over ``table``, with a digest in place of the cleaned text."""
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {table}
), w AS (
  SELECT r, doc_id, text, list_filter(string_split_regex(text, '{GAP}'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HAS_WORD}')) AS lines FROM t
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1) GROUP BY r
), l AS (
  SELECT r, k, line, regexp_replace(line, '{GAP}', '', 'g') AS plain,
         lower(regexp_replace(regexp_replace(line, '^{GAP}', ''), '{GAP}$', '')) AS low,
         length(line) - length(regexp_replace(line, '{SEPARATOR}', '', 'g')) AS seps
  FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM w)
), f AS (
  SELECT *, length(plain) AS chars, length(plain) - length(regexp_replace(plain, '[{MARKS}]', '', 'g')) AS marks,
         len(list_filter(string_split_regex(line, '{GAP}'), lambda x: x <> '')) AS n FROM l
), v AS (
  SELECT *, marks = chars OR (chars >= {DENSE_CHARS} AND marks * 100 > chars * {DENSE_PERCENT})
         OR (seps >= {SEPARATORS} AND n <= (seps + 1) * {ENTRY_WORDS})
         OR (chars <= {MENU_CHARS} AND regexp_matches(low, '{MENU}')) OR {phrases} AS fails FROM f
), d AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
         coalesce(sum(chars) FILTER (fails), 0) AS lost, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT fails), '') AS cleaned
  FROM v GROUP BY r
), o AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost,
         coalesce(cleaned, '') AS cleaned
  FROM w LEFT JOIN hit USING (r) LEFT JOIN d USING (r)
)
SELECT * EXCLUDE (lost, cleaned, base_failed), base_failed,
       CASE WHEN word_chars > 0 THEN lost * 100 // word_chars ELSE 0 END AS lost_percent,
       NOT base_failed AND lost * 100 <= word_chars * {MOST_LOST_PERCENT} AS kept, sha256(cleaned) AS cleaned_sha256
FROM (SELECT *, n_words < {FEWEST_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM o)
"""
