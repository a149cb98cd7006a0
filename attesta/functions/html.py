"""HTML to text and links, one page per row, as JVM column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.functions.numbers import let
from attesta.functions.text import strip_nul

# Page features that are read from the raw markup.
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION_PATTERN = (
    r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']{0,300})"""
)
COPYRIGHT_PATTERN = r"(?i)(?:©|&copy;|&#169;|copyright)\s*[^<\n]{0,140}"
HREF_PATTERN = r"""(?i)href\s*=\s*["']([^"'#]+)["']"""
# Names whose notices belong to embedded widgets, not to the site.
THIRD_PARTY_NOTICES = (
    "google|mapbox|openstreetmap|leaflet|wordpress|wix|squarespace|godaddy|elementor|shopify"
    "|weebly|duda|yelp|facebook|jquery|bootstrap|font ?awesome|adobe|microsoft|apple"
)
TITLE_LENGTH = 200
FOOTER_LINES = 2
FOOTER_MIN_LENGTH = 6

# Our own choice of markup that never holds main content, and of tags that end a line.
_DROPPED = "script|style|noscript|template|svg|head|nav|header|footer|aside|form|iframe"
_BLOCKS = (
    "p|div|li|ul|ol|dl|dt|dd|br|hr|tr|td|th|table|thead|tbody|h[1-6]|section|article|main"
    "|blockquote|pre|figure|figcaption|address|option|select|button|label|input|textarea|summary"
    "|details|caption|legend|fieldset|body|html"
)
# Our own choice of what tells blocks apart: words outside links that make prose, that keep a block
# of much link text, and that a closed sentence has; the longest menu entry and the shortest menu.
PROSE_WORDS, FEW_OWN_WORDS, SENTENCE_WORDS, ENTRY_WORDS, MENU_RUN = 8, 5, 4, 3, 4
SENTENCE_END = r"""[.!?:…]["')\]”’]*$"""
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _references() -> Column:
    """Named character references of the standard table: names that need their semicolon with it,
    the others also without."""
    entries = "\x1e".join(f"{name}\x1f{text}" for name, text in html5.items())
    return F.str_to_map(F.lit(entries), F.lit("\x1e"), F.lit("\x1f"))


def _bare_references() -> str:
    """Alternation, longest first, of the names that are valid without a semicolon."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(" + "|".join(bare) + ")"


_WINDOWS_1252 = "".join(
    bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)
)


def _character(point: Column) -> Column:
    surrogate = point.between(0xD800, 0xDFFF)
    dropped = (
        point.between(0x1, 0x8) | (point == 0xB) | point.between(0xE, 0x1F) | (point == 0x7F)
        | point.between(0xFDD0, 0xFDEF) | (point % 0x10000 >= 0xFFFE)
    )
    return (
        F.when(point.isNull() | (point == 0) | surrogate | (point > 0x10FFFF), F.lit("�"))
        .when(point.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS_1252), (point - 0x7F).cast("int"), F.lit(1)))
        .when(dropped, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    )


def _reference(piece: Column) -> Column:
    """Text of one piece that followed an ampersand."""
    number = F.regexp_extract(piece, r"^#([xX][0-9a-fA-F]+|[0-9]+);?", 0)
    digits = F.regexp_extract(piece, r"^#[xX]?([0-9a-fA-F]+)", 1)
    point = F.when(
        number.rlike("^#[xX]"), F.conv(digits, 16, 10).try_cast("bigint")
    ).otherwise(F.regexp_extract(piece, r"^#([0-9]+)", 1).try_cast("bigint"))
    name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0)
    bare = F.regexp_extract(piece, _bare_references(), 1)
    after = lambda skipped: F.substring(piece, F.length(skipped) + 1, F.length(piece))

    def by_name(known: Column) -> Column:
        return (
            F.when(known["name"].isNotNull(), F.concat(known["name"], after(name)))
            .when(known["bare"].isNotNull(), F.concat(known["bare"], after(bare)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    look_up = let(_references(), lambda table: let(
        F.struct(F.try_element_at(table, name).alias("name"), F.try_element_at(table, bare).alias("bare")), by_name))
    return (
        F.when(number != "", F.concat(_character(point), after(number)))
        .when(piece.startswith("amp;"), F.concat(F.lit("&"), F.substring(piece, F.lit(5), F.length(piece))))
        .when((name == "") & (bare == ""), F.concat(F.lit("&"), piece))
        .otherwise(look_up)
    )


def decode_entities(text: Column) -> Column:
    """Character references replaced by the characters they stand for."""
    decoded = let(
        F.split(text, "&"),
        lambda pieces: F.concat(
            pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), _reference), "")
        ),
    )
    return F.when(text.contains("&"), decoded).otherwise(text)


_LINE, _PART, _OPEN, _CLOSE = "\x05", "\x04", "\x02", "\x03"


def _tidy(text: Column) -> Column:
    """Blanks collapsed (line ends stay), trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), _EDGES, "")


def _main_markup(html: Column) -> Column:
    """Lines of text outside navigation, headers, footers and scripts, links marked, references
    not yet decoded."""
    body = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, rf"(?is)<({_DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"\s+", " ")
    body = F.regexp_replace(body, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"(?i)<a\b[^>]*>", _OPEN)
    body = F.regexp_replace(body, r"(?i)</a\s*>", _CLOSE)
    return F.regexp_replace(body, "<[^>]+>", "")  # what is left stands inside words


def _clean(block: Column) -> Column:
    return F.trim(F.regexp_replace(block, r"[\s\p{Z}]+", " "))


def _words(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def _kind(block: Column) -> Column:
    """One letter for a block (its ``whole`` text, and its ``own`` outside links): links (L), prose (P),
    an entry as menus have them (M with a link, E without), or other short text (S)."""
    whole, own = block["whole"], block["own"]
    linked = F.length(own) < F.length(whole)
    mostly_links = (own == "") | ((2 * F.length(own) < F.length(whole)) & (_words(own) < FEW_OWN_WORDS))
    ends = whole.rlike(SENTENCE_END)
    prose = (_words(own) >= PROSE_WORDS) | (ends & (_words(whole) >= SENTENCE_WORDS))
    entry = (_words(whole) <= ENTRY_WORDS) & ~ends & ~whole.rlike("[0-9]")
    return F.when(mostly_links, "L").when(prose, "P").when(entry & linked, "M").when(entry, "E").otherwise("S")


def _without_menus(kinds: Column) -> Column:
    """The letters of a page's blocks, those of menus replaced by x.

    A menu is a run of MENU_RUN entries or more that holds a link, or that no prose comes before or
    after. A list without links between prose is content. A page without prose keeps its entries.
    """
    def marked(runs: Column) -> Column:
        prose = F.transform(runs, lambda r: r.contains("P"))
        bounds = F.struct(
            F.array_position(prose, True).alias("first"), (F.size(runs) + 1 - F.array_position(F.reverse(prose), True)).alias("last"))
        return let(bounds, lambda p: F.array_join(F.transform(runs, lambda r, i: F.when(
            (p["first"] > 0) & r.rlike(f"^[EML]{{{MENU_RUN},}}$") & (r.rlike("[ML]") | (i + 1 < p["first"]) | (i + 1 > p["last"])),
            F.repeat(F.lit("x"), F.length(r))).otherwise(r)), ""))

    return let(F.regexp_extract_all(kinds, F.lit("([EML]+|[PS]+)"), F.lit(1)), marked)


def _main_text(lines: Column) -> Column:
    """The blocks that hold content, joined; repeated ones are kept once.

    Blocks are told apart by how much of their text stands in links, by their length and by what is
    around them, so menus also go where no tag names them.
    """
    blocks = F.transform(F.split(lines, "\n"), lambda b: F.struct(
        _clean(F.translate(b, _OPEN + _CLOSE, "")).alias("whole"),
        _clean(F.regexp_replace(b, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}?", " ")).alias("own")))

    def chosen(filled: Column) -> Column:
        kinds = F.array_join(F.transform(filled, _kind), "")
        return let(F.split(_without_menus(kinds), ""), lambda kept: F.filter(
            filled, lambda b, i: ~F.get(kept, i).isin("x", "L")))

    content = let(F.filter(blocks, lambda b: b["whole"] != ""), chosen)
    return F.array_join(F.array_distinct(F.transform(content, lambda b: b["whole"])), "\n")


def _footer_lines(lines: Column) -> Column:
    """Up to two different copyright lines of the site itself, in page order."""
    own = F.filter(
        F.transform(F.split(lines, _LINE), _tidy),
        lambda line: ~F.lower(line).rlike(THIRD_PARTY_NOTICES) & (F.length(line) > FOOTER_MIN_LENGTH),
    )

    def first_of_each(kept: Column) -> Column:
        return let(
            F.transform(kept, lambda x: F.lower(x)),
            lambda keys: F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1),
        )

    return F.slice(let(own, first_of_each), 1, FOOTER_LINES)


def page_parts(html: Column) -> Column:
    """Struct of title, description (null when absent), body and footer (array) of a page.

    The parts are cut from the markup first and decoded together, in one pass.
    """
    markup = F.translate(html, _OPEN + _CLOSE + _PART + _LINE, "    ")
    untagged = lambda m: F.regexp_replace(m, "<[^>]+>", " ")
    notices = F.transform(F.regexp_extract_all(markup, F.lit(COPYRIGHT_PATTERN), F.lit(0)), untagged)
    raw = F.concat_ws(
        _PART,
        untagged(F.regexp_extract(markup, TITLE_PATTERN, 1)),
        untagged(F.regexp_extract(markup, DESCRIPTION_PATTERN, 1)),
        _main_markup(markup),
        F.array_join(notices, _LINE),
    )
    return let(F.split(decode_entities(raw), _PART), lambda part: F.struct(
        F.nullif(F.substring(_tidy(part[0]), 1, TITLE_LENGTH), F.lit("")).alias("title"),
        F.nullif(_tidy(part[1]), F.lit("")).alias("description"),
        _main_text(part[2]).alias("body"),
        _footer_lines(part[3]).alias("footer"),
    ))


def page_text(html: Column, cap: int | None = None) -> Column:
    """Title, description, main text and footer joined by blank lines.

    ``cap`` bounds the main text for model prompts; by default the whole text is kept.
    """
    def join(page: Column) -> Column:
        body = page["body"] if cap is None else F.substring(page["body"], 1, cap)
        parts = F.array_compact(F.array(
            F.concat(F.lit("Page title: "), page["title"]),
            F.concat(F.lit("Meta description: "), page["description"]),
            F.nullif(body, F.lit("")),
            F.when(F.size(page["footer"]) > 0, F.concat(F.lit("Footer: "), F.array_join(page["footer"], " | "))),
        ))
        return F.regexp_replace(strip_nul(F.array_join(parts, "\n\n")), _EDGES, "")

    return let(page_parts(html), join)


def internal_links(html: Column, base: Column) -> Column:
    """Links to the same host in document order, without query and fragment, each once."""
    hrefs = F.transform(
        F.regexp_extract_all(html, F.lit(HREF_PATTERN), F.lit(1)),
        lambda h: F.regexp_replace(h, _EDGES, ""),
    )
    hrefs = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("^(mailto|tel|javascript):"))

    def resolve(home: Column) -> Column:
        absolute = F.transform(hrefs, lambda h: urls.resolve_link(h, home["parts"]))
        same_site = F.filter(
            absolute,
            lambda u: u.rlike("(?i)^https?://")
            & (urls.strip_www(F.lower(urls.authority(u))) == home["host"]),
        )
        return F.array_distinct(F.transform(same_site, _page_address))

    home = F.struct(
        urls.base_parts(base).alias("parts"),
        urls.strip_www(F.lower(urls.authority(base))).alias("host"),
    )
    return let(home, resolve)


def _page_address(url: Column) -> Column:
    path = urls.collapse_dots(F.when(urls.path_of(url) == "", F.lit("/")).otherwise(urls.path_of(url)))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+):", 1))
    return F.concat(scheme, F.lit("://"), urls.authority(url), path)
