"""Import, element leads, records, profile lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.urls import is_denied, host_of, normalize_domain, registrable_domain
from attesta.operators import imports as I
from attesta.session import new_folder
from attesta.sources import crawl
from attesta.sources import records as R
from attesta.sources.elements import element_leads as elements_to_leads
from attesta.sources.leads import read_lead_csv
from attesta.sources.presets import lookup_profiles
from workload import proxies as P

AS_OF = "2003-01-01"


def _raw_leads(spark, sf_dir):
    return raw_leads(P.table(spark, sf_dir, "pages"))


def raw_leads(pages):
    """A lead file: every page is a row, its address the website; some websites are unusable."""
    site = F.when(F.col("url").contains("/de/"), F.lit("n/a")).otherwise(
        F.concat(F.lit(' "'), F.upper("url"), F.lit('" ')))
    return pages.select(
        F.concat(F.lit(" Firm "), F.col("page_id").cast("string"), F.lit(" ")).alias("name"),
        site.alias("domain"),
        F.when(F.col("url").contains("utm"), F.lit(" ")).otherwise(F.lit("HVAC")).alias("industry"),
        F.when(F.col("url").startswith("https"), F.lit("list")).otherwise(F.lit("  ")).alias("source"),
        F.col("page_id").alias("row_pos"),
    )


def existing(spark, sf_dir):
    pages = P.table(spark, sf_dir, "pages")
    return pages.filter(F.col("url").contains(".example.org/")).select(
        normalize_domain(F.col("url")).alias("domain")).distinct()


def lead_domain(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select(
        "page_id", normalize_domain(F.concat(F.lit("  '"), F.upper("url"), F.lit("' "))).alias("domain"),
        normalize_domain(F.regexp_replace("url", "^https?://([^/]*)", "bob:pw@$1.:8080")).alias("typed_domain"))


def registrable(spark, sf_dir):
    host = normalize_domain(F.col("url"))
    foreign = F.regexp_replace(host, r"\.(com|net|org)$", ".co.uk")
    return P.table(spark, sf_dir, "pages").select(
        "page_id", registrable_domain(host).alias("registrable"), registrable_domain(foreign).alias("foreign_registrable"))


def lead_csv(spark, sf_dir):
    """The lead file written as CSV in both encodings, with two header orders and with line breaks
    inside a field, and read back."""
    folder = new_folder(spark, "lead-files")
    rows = _raw_leads(spark, sf_dir).withColumn("name", F.concat(F.lit("Café \"Ü\", "), F.trim("name")))
    lists = (
        ("UTF-8", "row_pos % 3 = 0", {"name": "Company", "domain": "Website", "industry": "Industry", "source": "Source"}),
        ("ISO-8859-1", "row_pos % 3 = 1", {"source": "source", "domain": "URL", "name": "Business name", "industry": "Sector"}),
        ("UTF-8", "row_pos % 3 = 2", {"domain": "Company domain", "name": "name", "source": "Source", "industry": "category"}),
    )
    for k, (encoding, part, names) in enumerate(lists):
        name = F.when(F.lit(k == 2), F.concat("name", F.lit("\nbranch"))).otherwise(F.col("name"))
        listed = rows.filter(part).withColumn("name", name).select(*[F.col(c).alias(h) for c, h in names.items()])
        listed.write.csv(f"{folder}/list-{k}", header=True, escape='"', quoteAll=True, encoding=encoding, emptyValue="",
                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = read_lead_csv(spark, f"{folder}/*/*.csv")
    return read.select("name", "domain", "industry", "source", "city")


def lead_import(spark, sf_dir):
    return I.new_leads(_raw_leads(spark, sf_dir), existing(spark, sf_dir))


def lead_import_stats(spark, sf_dir):
    return I.import_counters(_raw_leads(spark, sf_dir), existing(spark, sf_dir))


def element_leads(spark, sf_dir):
    url = F.col("url")
    tags = F.map_from_arrays(
        F.array(F.lit("name"), F.when(url.contains("#"), F.lit("contact:website")).otherwise(F.lit("website")),
                F.lit("addr:state")),
        F.array(
            F.concat(F.when(url.contains("page="), F.lit("Lone Star Supply ")).otherwise(F.lit("Shop ")),
                     F.col("page_id").cast("string")),
            F.concat(F.regexp_replace(url, "spam-farm.example.org", "m.yelp.com"), F.lit(";http://second.example.com")),
            F.lit("TX")))
    element = F.struct(F.lit("node").alias("type"), F.col("page_id").alias("id"), tags.alias("tags"))
    answers = P.table(spark, sf_dir, "pages").select(
        F.when(url.contains("/en/"), F.lit("HVAC")).otherwise(F.lit("Plumbing")).alias("industry"),
        F.col("page_id").alias("answer_pos"),
        F.to_json(F.struct(F.array(element).alias("elements"))).alias("answer"))
    return elements_to_leads(answers, ("HVAC", "Plumbing"), per_industry=20)


def record_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = lambda action, when: F.struct(F.lit(action).alias("eventAction"), when.alias("eventDate"))
    changed = F.when(F.col("o_totalprice") > 100000, later)
    events = F.when(F.col("o_orderstatus") == "P", F.array(event("transfer", day))).otherwise(F.array(
        event("registration", later), event("last changed", changed), event("Registration", day),
        event("expiration", later)))
    dates = R.registration_dates(F.to_json(F.struct(events.alias("events"))), F.to_date(F.lit(AS_OF)))
    return P.table(spark, sf_dir, "orders").select("o_orderkey", dates.alias("d")).select("o_orderkey", "d.*")


def first_capture(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    index = F.when(
        F.col("o_orderstatus") == "F",
        F.to_json(F.array(F.array(F.lit("timestamp"), F.lit("statuscode")), F.array(stamp, F.lit("200")))),
    ).otherwise(F.lit('[["timestamp","statuscode"]]'))
    closest = F.struct((F.col("o_totalprice") > 100000).alias("available"), F.lit("u").alias("url"), stamp.alias("timestamp"))
    availability = F.to_json(F.struct(F.struct(closest.alias("closest")).alias("archived_snapshots")))
    return P.table(spark, sf_dir, "orders").select(
        "o_orderkey", R.first_capture(index, availability).alias("c")).select("o_orderkey", "c.*")


def company_records(spark, sf_dir):
    """Records side by side per company: enrichments are its orders, the newest of a kind counts."""
    o = P.table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("rdap")).otherwise(F.lit("wayback"))
    registered = F.concat(F.lit('{"events":[{"eventAction":"registration","eventDate":"'),
                          F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}]}'))
    captured = F.concat(F.lit('[["timestamp","statuscode"],["'), stamp, F.lit('","200"]]'))
    enrichments = o.select(
        F.col("o_custkey").cast("string").alias("domain"), kind.alias("kind"),
        F.when(kind == "rdap", registered).otherwise(captured).alias("payload"),
        F.lit(None).cast("string").alias("fallback"),
        F.struct("o_orderdate", "o_orderkey").alias("fetched_at"))
    companies = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("domain"))
    joined = R.with_records(companies, enrichments, F.to_date(F.lit(AS_OF)))
    return joined.select("domain", F.col("rdap.registered").alias("registered"),
                         F.col("rdap.domain_age_years").alias("age"), F.col("wayback.first_capture").alias("captured"))


def sitemap_links(spark, sf_dir):
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *parts, F.lit(" </loc></url>"))
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    numbered = F.array_join(F.transform(  # every fifth map has more links than are read
        F.sequence(F.lit(1), F.when(F.col("page_id") % 5 == 0, 310).otherwise(2)),
        lambda n: loc(F.lit("https://"), host, F.lit("/p"), n.cast("string"))), "")
    body = F.concat(
        F.lit('<?xml version="1.0"?><urlset>'), loc(F.col("url")),
        loc(F.lit("https://www."), F.regexp_replace(host, r"^www\.", ""), F.lit("/about")),
        loc(F.lit("https://elsewhere.example.com/x")), numbered, F.lit("</urlset>"))
    found = crawl.sitemap_links(body, F.col("url"))
    return P.table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "link"))


def _lookup(spark, sf_dir):
    pages = P.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 4, "no site").otherwise(F.upper("url")).alias("wanted"))
    known = existing(spark, sf_dir).select(F.length("domain").cast("bigint").alias("id"), "domain")
    return I.lookup_companies(pages, known)


def company_lookup(spark, sf_dir):
    """The company each page's address means, where there is one."""
    return _lookup(spark, sf_dir)[0].select("page_id", "domain", "company_id")


def company_create(spark, sf_dir):
    """Companies that the addresses call for and nobody has."""
    return _lookup(spark, sf_dir)[1]


def profile_lookup(spark, sf_dir):
    """Which profile each scan request means, by number, alias or name."""
    wanted = (
        F.when(F.col("o_orderstatus") == "F", F.substring("o_orderpriority", 1, 1))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Profile "), F.substring("o_orderpriority", 1, 1)))
        .when(F.col("o_totalprice") > 200000, F.lit("buybox"))
        .otherwise(F.lit("99")))
    profiles = P.profiles(spark).select(
        "profile_id", F.when(F.col("profile_id") == 3, F.lit("Search-fund buy-box")).otherwise(F.col("profile_name")).alias("profile_name"))
    return lookup_profiles(P.table(spark, sf_dir, "orders").select("o_orderkey", wanted.alias("wanted")), profiles)


def deny_hosts(spark, sf_dir):
    moved = F.replace(F.replace("url", F.lit("example.com"), F.lit("facebook.com")), F.lit("www.ththen.facebook.com"), F.lit("x.com"))
    return P.table(spark, sf_dir, "pages").select("page_id", host_of(moved).alias("host")).filter(~is_denied(F.col("host")))


QUERIES = {
    f.__name__: f
    for f in (lead_domain, lead_csv, lead_import, lead_import_stats, element_leads, record_dates, first_capture,
              company_records, sitemap_links, company_lookup, company_create, profile_lookup, deny_hosts)
}
QUERIES["registrable_domain"] = registrable

_HOST = r"regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '')"
_RAW = f"""
raw AS (
  SELECT 'Firm ' || page_id AS name, CASE WHEN contains(url, '/de/') THEN NULL ELSE {_HOST} END AS domain,
         CASE WHEN contains(url, 'utm') THEN NULL ELSE 'HVAC' END AS industry,
         CASE WHEN starts_with(url, 'https') THEN 'list' ELSE 'csv' END AS source, page_id FROM pages),
existing AS (SELECT DISTINCT {_HOST} AS domain FROM pages WHERE contains(url, '.example.org/'))"""
_ELEMENTS = f"""
found AS (
  SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'HVAC' ELSE 'Plumbing' END AS industry,
         replace({_HOST}, 'spam-farm.example.org', 'm.yelp.com') AS domain FROM pages
  WHERE NOT contains(url, 'page=') AND NOT contains(url, 'spam-farm.example.org')),
first AS (SELECT domain, min(page_id) AS page_id FROM found WHERE industry = 'HVAC' GROUP BY domain ORDER BY 2 LIMIT 20),
second AS (SELECT domain, min(page_id) AS page_id FROM found WHERE industry = 'Plumbing'
           AND domain NOT IN (SELECT domain FROM first) GROUP BY domain ORDER BY 2 LIMIT 20)"""

ORACLE = {
    "lead_csv": """
      SELECT 'Café "Ü", Firm ' || page_id || CASE WHEN page_id % 3 = 2 THEN chr(10) || 'branch' ELSE '' END AS name,
             CASE WHEN contains(url, '/de/') THEN 'n/a' ELSE ' "' || upper(url) || '" ' END AS domain,
             CASE WHEN contains(url, 'utm') THEN ' ' ELSE 'HVAC' END AS industry,
             CASE WHEN starts_with(url, 'https') THEN 'list' ELSE '  ' END AS source, CAST(NULL AS VARCHAR) AS city FROM pages""",
    "lead_domain": f"SELECT page_id, {_HOST} AS domain, {_HOST} AS typed_domain FROM pages",
    "registrable_domain": f"""
      SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS registrable,
             regexp_extract({_HOST}, '([^.]+)\\.[^.]+$', 1) || '.co.uk' AS foreign_registrable FROM pages""",
    "lead_import": f"""WITH {_RAW}
      SELECT domain, name, industry, source FROM raw
      WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM existing)
      QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id) = 1""",
    "lead_import_stats": f"""WITH {_RAW}, ins AS (
        SELECT count(DISTINCT domain) AS n FROM raw WHERE domain NOT IN (SELECT domain FROM existing))
      SELECT count(*) AS total_rows, count(*) FILTER (domain IS NULL) AS no_domain_skipped,
             count(domain) - any_value(ins.n) AS duplicates_skipped, any_value(ins.n) AS inserted FROM raw, ins""",
    "element_leads": f"""WITH {_ELEMENTS}, both_ AS (
        SELECT *, 'HVAC' AS industry FROM first UNION ALL SELECT *, 'Plumbing' AS industry FROM second)
      SELECT domain, industry, 'Shop ' || page_id AS name, '' AS city, 'TX' AS state, '' AS phone,
             'osm:node/' || page_id AS source FROM both_""",
    "record_dates": f"""
      SELECT o_orderkey, o_orderstatus <> 'P' AS ok,
             CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS registered,
             CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') END AS expires,
             CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 100000 THEN strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') END AS last_changed,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(2003 - year(o_orderdate) AS INTEGER) END AS domain_age_years
      FROM orders""",
    "first_capture": """
      SELECT o_orderkey, CASE WHEN hit THEN strftime(o_orderdate, '%Y-%m-%d') END AS first_capture,
             CASE WHEN hit THEN CAST(year(o_orderdate) AS INTEGER) END AS first_capture_year,
             CASE WHEN hit THEN o_orderstatus <> 'F' END AS approx
      FROM (SELECT *, o_orderstatus = 'F' OR o_totalprice > 100000 AS hit FROM orders)""",
    "company_records": """
      WITH r AS (
        SELECT o_custkey, o_orderstatus = 'F' AS rdap, max_by(o_orderdate, struct_pack(d := o_orderdate, k := o_orderkey)) AS d
        FROM orders GROUP BY ALL)
      SELECT CAST(c_custkey AS VARCHAR) AS domain, strftime(a.d, '%Y-%m-%d') AS registered,
             CAST(2003 - year(a.d) AS INTEGER) AS age, strftime(b.d, '%Y-%m-%d') AS captured
      FROM customer LEFT JOIN r a ON a.o_custkey = c_custkey AND a.rdap
      LEFT JOIN r b ON b.o_custkey = c_custkey AND NOT b.rdap""",
    "sitemap_links": f"""
      SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (
        SELECT page_id, 0 AS pos, url AS link FROM pages
        UNION ALL SELECT page_id, 1, 'https://www.' || {_HOST} || '/about' FROM pages
        UNION ALL SELECT page_id, n + 1, 'https://' || regexp_extract(url, '^https?://([^/]*)', 1) || '/p' || n
        FROM (SELECT page_id, url, unnest(range(1, CASE WHEN page_id % 5 = 0 THEN 311 ELSE 3 END)) AS n FROM pages)) WHERE pos < 300""",
    "company_lookup": f"""WITH {_RAW}, w AS (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN 'no site' ELSE {_HOST} END AS domain FROM pages)
      SELECT page_id, w.domain, CASE WHEN e.domain IS NOT NULL THEN length(e.domain) END AS company_id FROM w LEFT JOIN existing e USING (domain)""",
    "company_create": f"""WITH {_RAW}, w AS (SELECT DISTINCT CASE WHEN page_id % 9 = 4 THEN 'no site' ELSE {_HOST} END AS domain FROM pages)
      SELECT domain, domain AS name, 'lookup' AS source FROM w ANTI JOIN existing USING (domain)""",
    "profile_lookup": """
      SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN substr(o_orderpriority, 1, 1) WHEN 'O' THEN 'Profile ' || substr(o_orderpriority, 1, 1)
          ELSE CASE WHEN o_totalprice > 200000 THEN 'buybox' ELSE '99' END END AS wanted,
        CAST(CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1)
             WHEN o_orderstatus = 'O' THEN nullif(substr(o_orderpriority, 1, 1), '3')
             WHEN o_totalprice > 200000 THEN '3' END AS BIGINT) AS profile_id FROM orders""",
    "deny_hosts": """
      WITH h AS (SELECT page_id, regexp_extract(replace(replace(url, 'example.com', 'facebook.com'),
                   'www.ththen.facebook.com', 'x.com'), '^https?://([^/?#]*)', 1) AS host FROM pages)
      SELECT * FROM h WHERE host <> 'x.com' AND NOT ends_with(host, '.facebook.com')""",
}
