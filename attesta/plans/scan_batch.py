"""The whole batch: companies and profiles in, scored and ranked leads out.

Everything up to the facts depends on the site alone, so it is done once per site and shared by
all profiles. Stage tables are written between the costly steps: they cut lineage, survive the loss
of an executor, and hold what was finished when a later step fails.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip_markers
from attesta.operators import facts as T
from attesta.operators import models as M
from attesta.operators import notes as N
from attesta.operators import pages as G
from attesta.operators import prompts as R
from attesta.operators import verdicts as V
from attesta.operators.answers import error_class, scan_status
from attesta.operators.cache import PAGE_DAYS, fresh, fresh_records, fresh_scan, split_requests
from attesta.operators.robots import robots_gate
from attesta.operators.scoring import criteria_hash, criterion_rows, score_scans
from attesta.operators.signals import signal_facts
from attesta.session import stage_once
from attesta.sinks.tables import write_scan_outputs
from attesta.sources import records
from attesta.sources.crawl import page_texts


@dataclass(frozen=True)
class ScanTables:
    """Output tables; each is a written table under the job's folder. ``reused`` holds the requests
    that a stored scan answers (scan_id, fresh_scan_id)."""

    scans: DataFrame
    facts: DataFrame
    results: DataFrame
    notes: DataFrame
    reused: DataFrame
    answers: DataFrame | None = None


def landed_pages(
    raw_pages: DataFrame, as_of: Column, robots: DataFrame | None = None, agent: str = "*", sites: DataFrame | None = None
) -> DataFrame:
    """The newest landing of every address that may be read: fetched in the 60 days up to
    ``as_of``, its host not on the deny list and open to ``agent`` by its robots file. With ``sites``
    (domain) only theirs, picked before any markup is compared or shuffled."""
    if sites is not None:
        named = raw_pages.withColumn("site", G.urls.normalize_domain(F.col("url")))
        raw_pages = named.join(sites.select(F.col("domain").alias("site")), "site", "left_semi").drop("site")
    payload = [c for c in raw_pages.columns if c != "url"]
    recent = raw_pages.filter((F.col("fetched_at") <= as_of) & fresh(F.col("fetched_at"), as_of, PAGE_DAYS))
    newest = recent.groupBy("url").agg(F.max_by(F.struct(*payload), F.struct("fetched_at", "html")).alias("row")).select("url", "row.*")
    open_pages = newest.filter(~G.urls.is_denied(G.urls.host_of(F.col("url"))))
    return open_pages if robots is None else robots_gate(open_pages, robots, agent).filter("allowed").drop("allowed")


def plan_landed_pages(pages: DataFrame) -> DataFrame:
    """At most six landed pages per site (domain, plan_pos, url, text, …), home page first, then
    as fetched. The cap is the page plan's."""
    candidates = pages.filter(F.coalesce("text", F.lit("")) != "")
    planned = G.plan_from_cache(candidates)
    order = F.struct((~F.col("url").rlike(r"^[^:]+://[^/]*/?$")).alias("deep"), "fetched_at", "url")
    first = candidates.groupBy("domain").agg(F.min(order).alias("o"))
    alone = first.join(planned.filter("plan_pos = 1").select("domain"), "domain", "left_anti").select(
        "domain", F.lit(1).alias("plan_pos"), F.col("o.url").alias("url"))
    return planned.unionByName(alone).join(candidates, ["domain", "url"])


def transient_errors(answers: DataFrame, key: str = "scan_id") -> DataFrame:
    """One passing trouble per key (key, error): it fails the scan, which is then tried again
    instead of stored as finished."""
    return answers.filter(error_class(F.col("error")) == "transient").groupBy(key).agg(F.min("error").alias("error"))


def run_scans(
    worklist: DataFrame,
    profiles: DataFrame,
    raw_pages: DataFrame,
    enrichments: DataFrame,
    as_of: Column,
    folder: str,
    extract: M.Model | None = None,
    judge: M.Model | None = None,
    write_note: M.Model | None = None,
    stored_scans: DataFrame | None = None,
    robots: DataFrame | None = None,
    outputs: str | None = None,
    batch: str = "0",
    resume: bool = False,
    fuzzy: bool = True,
    calls: int | None = None,
    known_answers: DataFrame | None = None,
) -> ScanTables:
    """Scan every (company, profile) of the work list that no stored scan answers.

    worklist: scan_id, company_id, name, domain, profile_id; profiles: profile_id, profile_name,
    criteria; raw_pages: url, html, fetched_at, via; enrichments: domain, kind, payload, fallback,
    fetched_at; stored_scans as in ``fresh_scan``; robots as in ``robots_gate``. Pages and records
    count by their age at ``as_of``. Facts, results, notes and scans are also stored under
    ``outputs`` as ``batch``, if given. ``resume`` goes on from the stages that an earlier run in
    ``folder`` finished. ``calls`` is the number of tasks that ask a model at a time (see ``call_model``).
    ``known_answers`` (request_hash, answer), the ``answers`` of earlier batches, are used again where a
    page or a judgment would be asked about in the same words, so that unchanged pages cost no call.

    A passing trouble (see ``error_class``) in any of the three model calls ends the scan as
    ``error``; what was completed before it is kept.
    """
    keep = lambda df, name: stage_once(df, f"{folder}/{name}", resume)
    prints = profiles.select("profile_id", criteria_hash(F.col("criteria")).alias("criteria_hash"))
    wanted, reused = worklist.select("*"), worklist.limit(0).select("scan_id", F.lit(None).cast("bigint").alias("fresh_scan_id"))
    if stored_scans is not None:
        asked = worklist.join(prints, "profile_id").select(
            F.col("scan_id").alias("request_id"), "company_id", "profile_id", "criteria_hash", as_of.alias("requested_at"))
        hits, misses = split_requests(keep(fresh_scan(asked, stored_scans), "requests"))
        reused = hits.select(F.col("request_id").alias("scan_id"), "fresh_scan_id")
        wanted = worklist.join(misses.select(F.col("request_id").alias("scan_id")), "scan_id", "left_semi")
    sites = wanted.select("domain").distinct()
    # several steps of the plan read the texts: parse the markup once
    texts = keep(page_texts(landed_pages(raw_pages, as_of, robots, sites=sites)), "texts")
    planned = keep(plan_landed_pages(texts).withColumn("outcome", F.lit("ok")), "pages")

    attempted = sites.join(planned, "domain", "left").withColumn("outcome", F.coalesce("outcome", F.lit("error")))
    content = G.site_content(attempted, "domain")
    readable = content.filter(F.col("no_evidence_reason").isNull()).select("domain")
    pages = G.scan_pages(planned.join(readable, "domain", "left_semi"), "domain").select(
        F.col("domain").alias("scan_id"), F.col("plan_pos").alias("page_pos"), "domain", "url", "text",
        G.urls.display_url(F.col("url"), F.col("via")).alias("display_url"))

    known_records = fresh_records(enrichments.filter(F.col("fetched_at") <= as_of).withColumn("ok", records.lookup_ok(as_of)), as_of)
    recorded = keep(records.with_records(sites, known_records, as_of), "records")
    of_site = recorded.select(
        F.col("domain").alias("scan_id"), "domain", "rdap", "wayback",
        records.registration_source(F.col("domain")).alias("rdap_source"),
        records.archive_source(F.col("domain")).alias("wayback_source"))

    # facts of a site, once for all its scans; a model is asked once per page
    given: list[DataFrame] = []
    no_errors = sites.limit(0).select("domain", F.lit("").alias("error"))
    if extract is None:
        answers = pages.select("scan_id", "page_pos", "url", F.lit(None).cast("string").alias("answer"))
        site_errors = no_errors
    else:
        asked = R.extract_requests(pages.select("scan_id", "page_pos", "domain", "url", "text"))
        called = keep(M.call_new(asked, extract, known_answers, calls).select(
            "scan_id", "page_pos", "url", "request_hash", "answer", "error"), "extract_answers")
        given.append(called)
        answers, site_errors = called.drop("error", "request_hash"), transient_errors(called).withColumnRenamed("scan_id", "domain")
    raw = T.raw_facts(signal_facts(pages.select("scan_id", "page_pos", "url", "text")), T.answered_facts(answers))
    known = keep(T.with_record_facts(T.page_facts(raw, pages, fuzzy=fuzzy), of_site), "site_facts")

    # from here on per scan
    every = wanted.join(content, "domain")
    failed = every.join(site_errors, "domain").select("scan_id", "error")
    scans = every.join(failed.select("scan_id"), "scan_id", "left_anti")
    facts = keep(known.withColumnRenamed("scan_id", "domain").join(scans.select("scan_id", "domain", "profile_id"), "domain").drop("domain"), "facts")
    criteria = profiles.select("profile_id", F.posexplode("criteria").alias("pos", "c")).select(
        "profile_id", "pos", F.col("c.key").alias("criterion_key"), "c.label", "c.weight", "c.polarity", "c.test")
    offered = V.facts_to_judge(facts.drop("profile_id"))
    to_judge = scans.filter(F.col("no_evidence_reason").isNull())
    if judge is None:
        judgments = M.ruled_judgments(to_judge, criteria, offered)
    else:
        read = F.array_sort(F.collect_list(F.struct("page_pos", "url")))  # at most six pages of a site
        addresses = pages.groupBy("domain").agg(F.array_join(F.transform(read, lambda p: p["url"]), ", ").alias("pages"))
        said = recorded.select("domain", records.records_text(F.col("rdap"), F.col("wayback")).alias("records"))
        about = to_judge.join(addresses, "domain", "left").join(said, "domain", "left")
        answered = keep(M.call_new(R.judge_requests(about, criteria, offered), judge, known_answers, calls), "judge_answers")
        given.append(answered)
        judgments = M.answered_judgments(answered)
        unjudged = transient_errors(answered)
        failed = failed.unionByName(unjudged)
        scans = scans.join(unjudged.select("scan_id"), "scan_id", "left_anti")
    results = keep(V.check_verdicts(scans, criteria, judgments, offered), "results")

    verdicts = results.join(criterion_rows(profiles).select("profile_id", "criterion_key", "polarity"),
                            ["profile_id", "criterion_key"])
    gate = N.note_gate(scans, verdicts, facts)
    to_cite = N.facts_to_cite(facts.drop("profile_id"), results.select("scan_id", F.explode("fact_ids").alias("id")))
    asking = gate.filter("gate = 'write'").select("scan_id").join(scans, "scan_id").join(
        profiles.select("profile_id", "profile_name"), "profile_id").withColumn("feedback", F.lit(""))
    met = results.filter("verdict = 'met'").select("scan_id", "criterion_key", "pos")
    requests = R.note_requests(asking, met, to_cite).join(N.offered_per_scan(to_cite), "scan_id")
    written = keep(M.write_notes(requests, f"{folder}/note_rounds", write_note, calls=calls), "written")
    unwritten = transient_errors(written)
    failed = keep(failed.unionByName(unwritten), "errors")
    notes = gate.join(written, "scan_id", "left").join(unwritten.select("scan_id", F.lit(True).alias("lost")), "scan_id", "left").select(
        "scan_id", strip_markers(F.col("note")).alias("outreach_note"),
        F.when(F.col("lost").isNull(), F.coalesce("note_status", F.col("gate"))).alias("note_status"), "fact_ids")
    notes = keep(notes.join(scans.select("scan_id", "profile_id"), "scan_id"), "notes")

    status, error = scan_status(F.col("error"))
    shown = ["scan_id", "company_id", "name", "domain", "profile_id", "pages_fetched", "content_chars", "fallback_used", "no_evidence_reason"]
    scored = score_scans(scans.select(*shown), profiles, results.select("scan_id", "criterion_key", "verdict"))
    aborted = every.select(*shown).join(scans.select("scan_id"), "scan_id", "left_anti")
    ended = (
        scored.unionByName(aborted, allowMissingColumns=True)
        .join(notes.select("scan_id", "outreach_note", "note_status"), "scan_id", "left")
        .join(failed, "scan_id", "left").join(prints, "profile_id")
        .withColumns({"status": status, "error": error, "finished_at": as_of})
    )
    told = [df.filter(F.col("error").isNull() & F.col("answer").isNotNull()).select("request_hash", "answer") for df in given]
    out = ScanTables(keep(ended, "scans"), facts, results, notes, reused, reduce(DataFrame.unionByName, told) if told else None)
    if outputs is not None:
        write_scan_outputs(outputs, batch, {"scans": out.scans, "facts": facts, "results": results, "notes": notes})
    return out
