"""Addresses: their parts, their ids, and tests on them, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
#: A chapter's number in an address (a fixed value).
CHAPTER = r"/chapter-([0-9]+)(?:[/?#]|$)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def number(url: Column, pattern: str) -> Column:
    """The number that a pattern finds, null without one."""
    return F.expr("try_cast(null as bigint)") if url is None else F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).try_cast("bigint")


def chapter_number(url: Column) -> Column:
    return number(url, CHAPTER)


def is_chapter(url: Column) -> Column:
    return F.coalesce(url.rlike(CHAPTER), F.lit(False))


def is_chapter_link(href: Column) -> Column:
    """A link to a chapter by its words: it names one, and is not the list of them."""
    return F.coalesce(F.contains(href, F.lit("/chapter")) & ~F.endswith(href, F.lit("/chapters")), F.lit(False))


def acceptable_page(candidate: Column, current: Column, site_host: Column) -> Column:
    """Whether a link may lead to another page of the same list: the site's host or none, a path, no chapter, and the list's path or one below it."""
    own = F.regexp_replace(path(current), r"/+$", "")
    # a link without a host has the path up to its query
    there = F.when(candidate.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), path(candidate)).otherwise(F.regexp_extract(candidate, r"^([^?#]*)", 1))
    there_short = F.regexp_replace(there, r"/+$", "")
    same_host = (host(candidate) == "") | (host(candidate) == site_host)
    return F.coalesce(same_host & (there != "") & ~is_chapter(candidate) & ((own == "") | (there_short == own) | F.startswith(there_short, F.concat(own, F.lit("/")))), F.lit(False))


def is_url(x: Column) -> Column:
    return F.coalesce(x.rlike("^http"), F.lit(False))


def book_number(url: Column) -> Column:
    """The id at the end of the book's part of an address."""
    return number(url, r"-([0-9]+)(?:/|$|[?])")


def absolute(href: Column, base: Column) -> Column:
    """An address resolved against the page's: root-relative, protocol-relative, or as it is."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/"), href))
    )


def valid_chapter(url: Column, book_url: Column) -> Column:
    """Same host, a chapter's path, and below the book's path."""
    return (host(url) == host(book_url)) & path(url).rlike(r"/chapter-[0-9]+") & F.startswith(path(url), F.regexp_replace(path(book_url), r"/+$", ""))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """As a form encodes it: letters, digits and "_.-~" stay, a blank becomes a plus sign."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_parameter(url: Column, key: str, value: str) -> Column:
    """With a query parameter set. A key stands once, at its first place and with its last value; parameters without a value are dropped; the fragment stays."""
    base, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*[?]([^#]*)", 1), F.regexp_extract(url, r"(#.+)$", 1)
    given = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+")), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.concat(given, F.array(F.struct(F.lit(key).alias("k"), F.lit(value).alias("v"))))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    shown = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.concat(_encoded(k), F.lit("="), _encoded(last(k))))
    return F.concat(base, F.lit("?"), F.array_join(shown, "&"), fragment)


def raw_file(url: Column) -> Column:
    """A code host's page of a file as the address of the file itself."""
    return F.regexp_replace(url, r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")
