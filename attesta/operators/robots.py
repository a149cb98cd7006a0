"""Robots gate: landed robots files applied to a table of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numbers import let

_RULES = "array<struct<agent: string, allow: boolean, pattern: string>>"


def parse_rules(body: Column) -> Column:
    """Rules of a robots file as (agent, allow, pattern). Agent lines that follow each other share
    the rules below them."""
    lines = F.filter(
        F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"^\x{FEFF}|#.*$", ""))),
        lambda x: x.rlike(r"(?i)^(user-agent|allow|disallow)\s*:"),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(False).alias("in_rules"),
        F.array().cast(_RULES).alias("rules"))

    def step(state: Column, line: Column) -> Column:
        value = F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        agents = F.when(state["in_rules"], F.array(F.lower(value))).otherwise(
            F.array_append(state["agents"], F.lower(value)))
        rule = lambda a: F.struct(
            a.alias("agent"), line.rlike("(?i)^allow").alias("allow"), value.alias("pattern"))
        return F.when(
            line.rlike("(?i)^user-agent"),
            F.struct(agents.alias("agents"), F.lit(False).alias("in_rules"), state["rules"].alias("rules")),
        ).otherwise(
            F.struct(state["agents"].alias("agents"), F.lit(True).alias("in_rules"),
                     F.concat(state["rules"], F.transform(state["agents"], rule)).alias("rules")))

    return F.aggregate(lines, start, step, lambda state: state["rules"])


def rules_for_agent(rules: Column, agent: str) -> Column:
    """Rules of the most specific group that names the agent, else of the group for everyone."""
    name = agent.lower()
    specificity = lambda r: F.when(r["agent"] == "*", F.lit(0)).when(
        F.lit(name).contains(r["agent"]), F.length(r["agent"]))
    named = F.filter(rules, lambda r: specificity(r).isNotNull())
    return let(
        named, lambda own: let(
            F.array_max(F.transform(own, specificity)),
            lambda best: F.filter(own, lambda r: specificity(r) == best)))


def _matches(target: Column, pattern: Column) -> Column:
    literal = F.regexp_replace(pattern, r"([\\.+?^{}()|\[\]])", r"\\$1")
    open_ended = F.regexp_replace(F.replace(literal, F.lit("*"), F.lit(".*")), r"\$(?!$)", r"\\\$")
    return F.when(pattern.rlike(r"\*|\$$"), F.rlike(target, F.concat(F.lit("^"), open_ended))).otherwise(
        F.startswith(target, pattern))


def allowed(target: Column, rules: Column) -> Column:
    """The longest matching pattern decides; allow wins a tie; no match means allowed."""
    hits = F.filter(rules, lambda r: (r["pattern"] != "") & _matches(target, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def robots_gate(addresses: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Addresses (url, …) with ``allowed``.

    robots: origin, status, body. 401 and 403 close the whole site; anything else that is not a
    readable file leaves it open. Rules travel as one array per origin, so an address stays one row.
    """
    everything = F.array(F.struct(F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/").alias("pattern")))
    parsed = rules_for_agent(parse_rules(F.col("body")), agent)
    rules = robots.select(
        "origin",
        F.when(F.col("status") == 200, parsed).when(F.col("status").isin(401, 403), everything).alias("rules"),
    )
    target = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][^:]*://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    keyed = addresses.withColumn("origin", F.regexp_extract("url", r"^([a-zA-Z][^:]*://[^/?#]*)", 1))
    return (
        keyed.join(rules, "origin", "left")
        .withColumn("allowed", F.coalesce(allowed(target, F.col("rules")), F.lit(True)))
        .drop("rules", "origin")
    )
