"""Column functions against plain Python and hand-made rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attesta.functions import display, html, text, urls
from attesta.functions.numbers import round1


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).head().x


def test_round1_is_half_even_on_the_stored_value(spark):
    rng = random.Random(3)
    values = [rng.random() * 100 for _ in range(2000)] + [i / 100 for i in range(10001)] + [22.95, 6.25, 0.05, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", round1(F.col("x")).alias("r")).collect()
    assert [r.x for r in rows if round(r.x, 1) != r.r] == []


@pytest.mark.parametrize("raw, domain", [
    ("HTTPS://www.Acme.com:443/about/", "acme.com"),
    ("  'bob:pw@Foo.CO.uk.' ", "foo.co.uk"),
    ("acme.com?x=1", "acme.com"),
    ("localhost", None), ("a b.com", None), ("", None), ("   ", None), (None, None),
    ("mailto:x@y.org", "y.org"), ("www.www.a.com", "www.a.com"),
])
def test_domain(spark, raw, domain):
    rows = spark.createDataFrame([(raw,)], "u string").select(urls.normalize_domain(F.col("u")).alias("d"))
    assert rows.head().d == domain


def test_registrable_domain(spark):
    for host, want in {"a.b.co.uk": "b.co.uk", "x.acme.com": "acme.com", "co.uk": "co.uk", "acme": "acme", "a.com.au": "a.com.au"}.items():
        assert one(spark, urls.registrable_domain(F.col("h")), h=host) == want


def test_normalize_equals_unicode_rules(spark):
    rng = random.Random(1)
    texts = ["Straße  “Über” ﬁne ½ x² été İI ΣΑΣ ẞ ｆｕｌｌ w—d_a Ⅳ 한국어 漢字ｶﾅ", "plain text, ok!", "", "…«a»\tb"]
    for _ in range(300):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x370, 0x500), rng.randrange(0x2010, 0x2040)])) for _ in range(15)))

    def rule(s):
        s = unicodedata.normalize("NFKC", s).casefold()
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()

    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.normalize(F.col("s")).alias("n")).collect()
    assert [r.s for r in rows if rule(r.s) != r.n and unicodedata.unidata_version >= "13"] == []


def test_quote_rules(spark):
    eligible = lambda q: one(spark, text.quote_eligible(F.col("q")), q=q)
    assert eligible("since 1985 in town") and not eligible("too short") and not eligible("12 345 6789 0123")
    assert not eligible("twowords only")
    present = lambda a, b: one(spark, text.numbers_present(F.col("a"), F.col("b")), a=a, b=b)
    assert present("12 of 3", "3 and 12") and not present("12", "112") and present("none", "")


def test_small_texts(spark):
    assert one(spark, text.slug(F.col("s")), s="--Owner Operated!! ") == "owner_operated"
    assert one(spark, text.slug(F.col("s")), s="***") == "criterion"
    assert one(spark, text.strip_markers(F.col("s")), s="It began in 1985 [F3]. We, yes [F1], ok. ") == "It began in 1985. We, yes, ok."
    assert one(spark, text.strip_nul(F.col("s")), s="a\x00b") == "ab"
    h = lambda s: one(spark, text.description_hash(F.col("s")), s=s)
    assert h("  Some  Text\n") == h("some text")


def test_page_text_and_entities(spark):
    page = (
        "<html><head><title> A &amp; B &#8212; &eacute;t&eacute; &copy 2 </title><meta name='description' content='Say &quot;hi&quot;'></head>"
        "<body><nav><a href='/x'>skip</a></nav><!-- no --><p>First <b>block</b>.</p><p>First <b>block</b>.</p>"
        "<ul><li><a href='/l'>only link</a></li></ul><div>Second &#x41;&unknown; R&D</div><script>var a='<p>no</p>';</script>"
        "<footer>&copy; 2020 Acme Ltd. <b>x</b></footer><p>Copyright Google maps</p></body></html>")
    got = one(spark, html.page_text(F.col("h")), h=page)
    assert got == (
        'Page title: A & B — été © 2\n\nMeta description: Say "hi"\n\nFirst block.\nSecond A&unknown; R&D\nCopyright Google maps'
        "\n\nFooter: © 2020 Acme Ltd.")
    assert one(spark, html.page_text(F.col("h"), cap=5), h=page).split("\n\n")[2] == "First"


def test_links(spark):
    page = """<a href="/a/">1</a><a href='b?q=1'>2</a><a href="https://acme.com/c#x">3</a><a href="//acme.com/d/../e">4</a>
              <a href="mailto:x@y.z">5</a><a href="https://other.com/f">6</a><a href="/a">7</a><a href="?p=2">8</a><a href="/">9</a>"""
    got = one(spark, html.internal_links(F.col("h"), F.col("u")), h=page, u="https://acme.com/dir/page")
    assert got == ["https://acme.com/a", "https://acme.com/dir/b", "https://acme.com/e",
                   "https://acme.com/dir/page", "https://acme.com/"]


def test_display(spark):
    assert one(spark, display.location(F.col("a"), F.col("b")), a=" ", b="TX") == "TX"
    assert one(spark, display.percent(F.col("v")), v=12.5) == "13%"
    assert one(spark, display.rank_value(F.col("s"), F.col("c")), s=50.0, c=40.0) == 20.0
    ago = lambda s: one(spark, display.relative_time(F.timestamp_seconds(F.lit(10_000_000 - s)), F.timestamp_seconds(F.lit(10_000_000))))
    assert [ago(s) for s in (10, 50, 120, 7200, 90000, 3_000_000)] == ["just now", "1m ago", "2m ago", "2h ago", "1d ago", "1mo ago"]


def test_sorted_leads_put_missing_numbers_last(spark):
    from attesta.operators.latest import sort_leads

    leads = spark.createDataFrame(
        [("b", 50.0, 100.0), ("a", 80.0, 50.0), ("d", None, None), ("c", 0.0, 10.0)], "name string, score double, coverage double")
    order = lambda by, **how: "".join(r.name for r in sort_leads(leads, by, **how).collect())
    assert order("score") == "abcd" and order("coverage") == "bacd" and order("rank") == "bacd"
    assert order("name", descending=False) == "abcd" and order("score", descending=False) == "dcba"
    with pytest.raises(ValueError):
        sort_leads(leads, "size")


def test_note_texts_and_file_names(spark):
    from attesta.sinks.export import export_name
    from attesta.sources.crawl import is_sitemap

    rows = spark.createDataFrame(
        [("hello", "ok", []), (None, "red_flag", ["Franchise", "Group"]), ("", "red_flag", []), (None, "unverified", []), (None, "skipped", [])],
        "note string, status string, flags array<string>")
    got = [r[0] for r in rows.select(display.note_text(F.col("note"), F.col("status"), F.col("flags"))).collect()]
    assert got[0] == "hello" and "Franchise, Group" in got[1] and got[2] != got[1] and got[3] == display.NOTE_UNVERIFIED_TEXT and got[4] == display.NOTE_SKIPPED_TEXT
    assert export_name("Sales Fit") == "icp-scan-sales-fit.csv"
    answers = spark.createDataFrame([(200, "text/xml", ""), (200, "text/html", "<x><urlset>"), (404, "text/xml", ""), (200, "text/html", "no")], "s int, t string, b string")
    assert [r[0] for r in answers.select(is_sitemap(F.col("s"), F.col("t"), F.col("b"))).collect()] == [True, True, False, False]


def page_body(spark, markup):
    return spark.createDataFrame([(markup,)], "html string").select(html.page_text(F.col("html"))).head()[0].split("\n")


def test_menus_without_tags_of_their_own(spark):
    entries = ["Home", "Our products", "Team", "Contact us"]
    div = lambda texts: "".join(f"<div>{t}</div>" for t in texts)
    prose = ["We repair roofs of slate and tin in all of Oklahoma.", "Founded in 1987", "Our work covers:"]
    services = ["Slate roofs", "Tin roofs", "Gutters", "Chimneys", "Skylights"]
    close = ["Call us before the next storm comes over the hills."]
    page = div(entries) + div(prose + services + close) + div(["Imprint", "Privacy", "Terms", "Jobs"])
    assert page_body(spark, page) == prose + services + close
    linked = div(prose + ['<a href="/a">More</a>', "Older posts", "Newer posts", "Archive"] + close)  # a menu by its link
    assert page_body(spark, linked) == prose + close
    assert page_body(spark, div(entries[:3] + prose)) == entries[:3] + prose  # too short for a menu
    assert page_body(spark, div(entries + services)) == entries + services  # no prose: nothing to tell them from
    much = '<p>See <a href="/r">the long report on roofs of this county</a></p><p>As our <a href="/r">long report on roofs of the county</a> says, slate holds longest of all.</p>'
    assert page_body(spark, much) == ["As our long report on roofs of the county says, slate holds longest of all."]
    assert page_body(spark, "") == [""] and page_body(spark, "<div></div><p> </p>") == [""]


def test_menu_runs_equal_brute_force(spark):
    rng = random.Random(4)
    pages = ["", "E", "EEEE", "P", *("".join(rng.choice("EEEMLPS" if k % 2 else "EEEEEP") for _ in range(rng.randrange(30))) for k in range(300))]

    def brute(kinds):
        out = list(kinds)
        if "P" not in kinds:
            return kinds
        at = 0
        while at < len(kinds):
            end = at + 1
            while end < len(kinds) and (kinds[end] in "EML") == (kinds[at] in "EML"):
                end += 1
            edge = "P" not in kinds[:at] or "P" not in kinds[end:]
            if kinds[at] in "EML" and end - at >= 4 and (edge or set(kinds[at:end]) & set("ML")):
                out[at:end] = "x" * (end - at)
            at = end
        return "".join(out)

    rows = spark.createDataFrame([(p,) for p in pages], "k string").select("k", html._without_menus(F.col("k")).alias("got")).collect()
    assert all(r.got == brute(r.k) for r in rows)


def test_page_of_many_blocks(spark):
    lines = "".join(f"<p>Line {i} of a page that has very many of them.</p><div>entry</div>" for i in range(40000))
    assert len(page_body(spark, lines)) == 40001
