"""Domain and URL column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.numbers import let

_SCHEME = r"^[a-z][a-z0-9+.\-]*://"

# Second-level labels that belong to the public suffix under two-letter TLDs.
TWO_LEVEL_SUFFIXES = ("co", "com", "org", "net", "gov", "ac")

# Hosts that are never fetched.
DENY_HOSTS = (
    "linkedin.com", "google.com", "maps.google.com", "goo.gl",
    "facebook.com", "instagram.com", "x.com", "twitter.com",
)

# URLs that are not content pages.
ASSET_PATTERN = (
    r"(?i)\.(xml|json|webmanifest|pdf|jpe?g|png|gif|svg|webp|css|js|php|ico|mp4|zip)$"
    r"|/(wp-|xmlrpc|feed|tag/|category/|page/\d|cdn-cgi)"
)

ARCHIVE_PREFIX = "https://web.archive.org/web/2/"


def authority(url: Column) -> Column:
    """Network location of an absolute URL, as written."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host of an absolute URL, lower case, without user information or port."""
    bare = F.regexp_extract(authority(url), r"([^@]*)$", 1)
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalize_domain(raw: Column) -> Column:
    """Bare host of whatever was typed into a website column; null when there is none."""
    text = F.regexp_replace(raw, r"^[\s ]+|[\s ]+$", "")
    text = F.lower(F.regexp_replace(text, "^[\"']+|[\"']+$", ""))
    text = F.regexp_replace(text, r"[\t\r\n]", "")
    absolute = F.when(text.rlike(_SCHEME), text).otherwise(F.concat(F.lit("http://"), text))
    location = F.regexp_extract(F.regexp_extract(absolute, _SCHEME + r"([^/?#]*)", 1), r"([^@]*)$", 1)
    host = F.when(location.startswith("["), F.regexp_extract(location, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(location, r"^([^:]*)", 1)
    )
    host = strip_www(F.regexp_replace(host, r"^\.+|\.+$", ""))
    return F.when(host.contains(".") & ~host.contains(" "), host)


def registrable_domain(domain: Column) -> Column:
    """Last two labels, or three below a known two-level suffix."""
    def cut(labels: Column) -> Column:
        n = F.size(labels)
        two_level = (
            (n >= 3)
            & F.try_element_at(labels, F.lit(-2)).isin(*TWO_LEVEL_SUFFIXES)
            & (F.length(F.try_element_at(labels, F.lit(-1))) == 2)
        )
        keep = F.when(two_level, F.lit(3)).otherwise(F.lit(2))
        return F.when(n >= 2, F.array_join(F.slice(labels, -keep, keep), "."))

    return F.coalesce(let(F.split(F.lower(domain), r"\."), cut), domain)


def is_denied(host: Column, deny: tuple[str, ...] = DENY_HOSTS) -> Column:
    """True when the host is one of the listed hosts or lies below one."""
    listed = F.array(*[F.lit(d) for d in deny])
    return F.exists(listed, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def is_asset(url: Column) -> Column:
    return url.rlike(ASSET_PATTERN)


def archive_link(url: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_PREFIX), url)


def display_url(url: Column, via: Column) -> Column:
    """Link to what was quoted: the archived copy when the live page failed."""
    return F.when(via == "wayback", archive_link(url)).otherwise(url)


def archived_original(url: Column) -> Column:
    """Ask the archive for the captured HTML without its toolbar (first timestamp only)."""
    return F.regexp_replace(url, r"^(.*?/web/\d{14})/", "$1id_/")


def base_parts(base: Column) -> Column:
    """The pieces of a page address that relative links are resolved against."""
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    origin = F.concat(scheme, F.lit("://"), authority(base))
    path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    return F.struct(
        scheme.alias("scheme"),
        origin.alias("origin"),
        F.concat(origin, F.regexp_replace(path, r"[^/]*$", "")).alias("folder"),
        F.regexp_replace(base, r"[?#].*$", "").alias("page"),
    )


def resolve_link(href: Column, parts: Column) -> Column:
    """Absolute form of a link, given the ``base_parts`` of the page it stands on."""
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(parts["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(parts["origin"], href))
        .when(href.startswith("?"), F.concat(parts["page"], href))
        .otherwise(F.concat(parts["folder"], href))
    )


def collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    pieces = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    walked = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda acc, piece: F.when(piece == ".", acc)
        .when(piece == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, piece)),
    )
    closed = F.when(path.rlike(r"/\.\.?$"), F.array_append(walked, F.lit(""))).otherwise(walked)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)
