"""URL verdicts: host and path rules, and for all other URLs a tree of path templates per host.

The tree grows level by level over distinct paths with their counts, not over URLs. At each level a
host's segments that look variable (digits) or are rare among their siblings become a wildcard, and
siblings whose labelled quality does not differ from their parent's by more than chance are merged.
A leaf of the tree is a template; it is rejected when its smoothed share of good labels is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import ascii_lower
from attesta.session import literal_relation, new_folder, stage

#: (host and path, verdict): a rule fits its host and all subdomains, the longest fitting one wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: A segment stays itself if so many URLs have it and this share of its parent's.
FEWEST_URLS, FEWEST_SHARE = 5, 0.01
#: Standard deviations by which merged siblings' shares of good labels may differ from their parent's.
DEVIATIONS = 2.58
#: Labels that the overall share of good ones counts as, in a template's purity, and the least purity.
PRIOR, LEAST_PURITY = 10, 0.5

_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(text, _PARTS, 1)), F.regexp_extract(text, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """Segments with their digits as one mark each run."""
    shapes = F.regexp_replace(path, "[0-9]+", "0")
    return F.split(F.regexp_replace(shapes, "^/", ""), "/")


def templates(paths: DataFrame) -> DataFrame:
    """The template of each distinct (host, shape) of ``paths`` with urls, labels and good counts.

    The tree has as many levels as the longest path. Each step's rows are a table in the shared folder, so
    that plans do not grow with the levels.
    """
    folder = new_folder(paths.sparkSession, "templates")
    rows = paths.withColumns({"segments": _segments(F.col("shape")), "template": F.lit("")})
    sums = [F.sum(c).alias(c) for c in ("urls", "labels", "good")]
    parent = ["host", "template"]
    deepest = paths.select(F.max(F.size(_segments(F.col("shape"))))).first()[0] or 0
    for level in range(deepest):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        for similar in (False, True):
            nodes = rows.where(F.col("segment").isNotNull()).groupBy(*parent, "segment").agg(*sums)
            above = nodes.groupBy(*parent).agg(*[F.sum(c).alias(f"all_{c}") for c in ("urls", "labels", "good")])
            share = F.try_divide("all_good", "all_labels")
            if similar:
                off = F.abs(F.col("good") - F.col("labels") * share)
                wide = (F.col("labels") == 0) | (off <= DEVIATIONS * F.sqrt(F.col("labels") * share * (1 - share)) + 1e-9)
                wild = (F.col("urls") < F.col("all_urls")) & F.coalesce(wide, F.lit(True))
            else:
                wild = (F.col("urls") < FEWEST_URLS) | (F.col("urls") < F.col("all_urls") * FEWEST_SHARE)
            named = nodes.join(above, parent).select(*parent, "segment", F.when(wild, "*").otherwise(F.col("segment")).alias("name"))
            rows = rows.join(named, [*parent, "segment"], "left").withColumn("segment", F.col("name")).drop("name")
            rows = stage(rows, f"{folder}/{level}-{int(similar)}")
        grown = F.when(F.col("segment").isNotNull(), F.concat("template", F.lit("/"), "segment")).otherwise(F.col("template"))
        rows = rows.withColumn("template", grown)
    return rows.drop("segment", "segments")


def judge(
    pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", prior: int = PRIOR
) -> DataFrame:
    """page_id, host, path, rule, template, purity and verdict of every URL.

    ``labels`` has page_id and good (0 or 1); of several labels of a page the smallest counts, null
    ones none. Templates and purities come from the URLs without a rule. Without any label every
    template is allowed. Null URLs and ones without ``://`` have empty host and path and share a
    template. Paths may be of any depth. Repeated rows each have theirs; other columns are ignored; an
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "shape": F.regexp_replace("path", "[0-9]+", "0")})
    good = labels.where(F.col("good").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    free = rows.where(F.col("rule").isNull()).join(good, "page_id", "left")
    paths = free.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("urls"), F.count("good").alias("labels"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")
    )
    paths = stage(paths, new_folder(pages.sparkSession, "paths"))
    whole = paths.agg(F.sum("labels").alias("labels"), F.sum("good").alias("good")).first()
    overall = whole["good"] / whole["labels"] if whole["labels"] else 1.0
    named = templates(paths)
    pure = named.groupBy("host", "template").agg(
        ((F.sum("good") + F.lit(prior * overall)) / (F.sum("labels") + F.lit(float(prior)))).alias("purity")
    )
    leaves = named.join(pure, ["host", "template"]).select("host", "shape", "template", "purity")
    verdicts = literal_relation(pages.sparkSession, rules, T.StructType([T.StructField("rule", T.StringType()), T.StructField("ruled", T.StringType())]))
    ruled = rows.where(F.col("rule").isNotNull()).join(F.broadcast(verdicts), "rule")  # one row per rule
    none = F.lit(None)
    by_rule = ruled.select("page_id", "host", "path", "rule", none.cast("string").alias("template"), none.cast("double").alias("purity"), F.col("ruled").alias("verdict"))
    by_tree = rows.where(F.col("rule").isNull()).join(leaves, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", "template", "purity", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow").alias("verdict")
    )
    return by_rule.unionByName(by_tree)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and good: the quality label of the document that a page's path ends in by number."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]{1,18})[^0-9/]*/?$", 1)
    known = labels.select("doc_id", F.col("quality").alias("good"))
    return pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).join(known, "doc_id").select("page_id", "good")


def judge_sql(prior: int = PRIOR, levels: int = 4) -> str:
    """DuckDB SQL for ``judge`` over pages and ``page_labels``, with a step for each of ``levels`` levels:
    as many as the longest path has."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cases = ""
    for rule, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        own_host, _, own_path = rule.partition("/")
        cases += f" WHEN (host = '{own_host}' OR ends_with(host, '.{own_host}')) AND starts_with(path, '/{own_path}') THEN '{rule}'"
    verdicts = "".join(f" WHEN '{r}' THEN '{v}'" for r, v in RULES)
    steps, last = [], "t0"
    for level in range(levels):
        for k, similar in enumerate((False, True)):
            seg = f"CASE WHEN len(segments) >= {level + 1} THEN {'seg' if similar else f'segments[{level + 1}]'} END"
            now = f"s{level}{k}"
            share = "all_good / nullif(all_labels, 0)"
            wild = (
                f"urls < all_urls AND coalesce(labels = 0 OR abs(good - labels * {share}) <= {DEVIATIONS} * sqrt(labels * {share} * (1 - {share})) + 1e-9, true)"
                if similar
                else f"urls < {FEWEST_URLS} OR urls < all_urls * {FEWEST_SHARE}"
            )
            steps.append(
                f"{now}r AS (SELECT host, shape, urls, labels, good, segments, template, {seg} AS seg FROM {last}), "
                f"{now}n AS (SELECT host, template, seg, CAST(sum(urls) AS DOUBLE) AS urls, CAST(sum(labels) AS DOUBLE) AS labels, CAST(sum(good) AS DOUBLE) AS good FROM {now}r WHERE seg IS NOT NULL GROUP BY ALL), "
                f"{now}a AS (SELECT host, template, sum(urls) AS all_urls, sum(labels) AS all_labels, sum(good) AS all_good FROM {now}n GROUP BY ALL), "
                f"{now}m AS (SELECT host, template, seg, CASE WHEN {wild} THEN '*' ELSE seg END AS name FROM {now}n JOIN {now}a USING (host, template)), "
                f"{now} AS (SELECT x.* EXCLUDE (seg), name AS seg FROM {now}r x LEFT JOIN {now}m USING (host, template, seg))"
            )
            last = now
        steps.append(f"t{level + 1} AS (SELECT * EXCLUDE (seg, template), CASE WHEN seg IS NOT NULL THEN template || '/' || seg ELSE template END AS template FROM {last})")
        last = f"t{level + 1}"
    parts = "string_split(regexp_replace(shape, '^/', ''), '/')"
    return rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages
), x AS (
  SELECT *, CASE{cases} END AS rule, regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM u
), g AS (
  SELECT page_id, min(quality) AS good
  FROM (SELECT page_id, try_cast(regexp_extract(path, '([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT) AS doc_id FROM u) JOIN labels USING (doc_id)
  WHERE quality IN (0, 1) GROUP BY page_id
), t0 AS (
  SELECT host, shape, count(*) AS urls, count(good) AS labels, coalesce(sum(good), 0) AS good, {parts} AS segments, '' AS template
  FROM x LEFT JOIN g USING (page_id) WHERE rule IS NULL GROUP BY host, shape
), {", ".join(steps)}, o AS (
  SELECT coalesce(CAST(sum(good) AS DOUBLE) / nullif(sum(labels), 0), 1.0) AS overall FROM t0
), pure AS (
  SELECT host, template, (CAST(sum(good) AS DOUBLE) + {prior} * (SELECT overall FROM o)) / (CAST(sum(labels) AS DOUBLE) + {prior}) AS purity FROM {last} GROUP BY ALL
), leaves AS (
  SELECT host, shape, template, purity FROM {last} JOIN pure USING (host, template)
)
SELECT page_id, x.host, path, rule, template, purity,
       CASE rule{verdicts} ELSE CASE WHEN purity < {LEAST_PURITY} THEN 'block' ELSE 'allow' END END AS verdict
FROM x LEFT JOIN leaves ON rule IS NULL AND x.host = leaves.host AND x.shape = leaves.shape
"""
