"""Links, paths and titles as Column expressions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: pages live at https://<language>.<SITE><path>.
SITE = "wikipedia.org"
ANCHOR = r'<a href="([^"]*)"'
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
#: Characters that no URI may hold, besides a percent sign without two hex digits.
ILLEGAL = r'[\x00-\x20\x7f-\x{a0}"<>\\^`{|}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'
ILLEGAL_IN_PATH = r"[\[\]]"


def hrefs(html: Column) -> Column:
    """The non-empty targets of anchors in plain markup, as an array."""
    return F.filter(F.regexp_extract_all(html, F.lit(ANCHOR), 1), lambda h: h != "")


def is_valid_uri(href: Column) -> Column:
    """Whether the text is a URI reference: legal characters, whole escapes, a proper scheme before a colon, one fragment."""
    rest = F.regexp_replace(href, f"^{SCHEME}", "")
    colon_first = href.rlike(r"^[^/?#:]*:")
    return (
        ~href.rlike(ILLEGAL)
        & ~F.contains(F.regexp_replace(href, r"%[0-9A-Fa-f]{2}", ""), F.lit("%"))
        & ~(colon_first & ~href.rlike(f"^{SCHEME}"))
        & ~(colon_first & (rest == ""))
        & ~href.rlike(r"#.*#")
        & ~F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1).rlike(ILLEGAL_IN_PATH)
    )


def internal_path(href: Column) -> Column:
    """The raw path of a link that stays on the site, else null.

    Dropped: invalid references, those with an authority, opaque ones (a scheme
    without a slash behind it), empty paths, and paths with ``File:`` in them.
    Query and fragment are cut; relative paths are not resolved.
    """
    authority = href.rlike(f"^(?:{SCHEME})?//[^/?#]")
    opaque = href.rlike(f"^{SCHEME}[^/]")
    path = F.regexp_extract(href, f"^(?:{SCHEME})?(?://)?([^?#]*)", 1)
    kept = is_valid_uri(href) & ~authority & ~opaque & (path != "") & ~F.contains(path, F.lit("File:"))
    return F.when(kept, path)


def internal_paths(links: Column) -> Column:
    """Distinct internal paths of an array of link targets."""
    return F.array_distinct(F.filter(F.transform(links, internal_path), lambda p: p.isNotNull()))


def page_url(path: Column, lang: Column | str = "en", site: str = SITE) -> Column:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit("https://"), lang, F.lit(f".{site}"), path)


def locale_urls(locales: Column, site: str = SITE) -> Column:
    """One URL per language of a locale map."""
    return F.transform(F.map_entries(locales), lambda e: page_url(e["value"], e["key"], site))


def url_path(url: Column) -> Column:
    """The path of a URL; empty where it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def article_type(path: Column, is_disambiguation: Column) -> Column:
    """``Disambiguation``, the part before the only colon of a path (as it stands there), or ``Article``.

    Colons at the end separate nothing.
    """
    parts = F.split(F.regexp_replace(path, ":+$", ""), ":")
    only_colons = path.rlike("^:+$")
    return F.when(is_disambiguation, "Disambiguation").when((F.size(parts) == 2) & ~only_colons, parts[0]).otherwise("Article")


def normalised_title(argument: Column) -> Column:
    """A title as it is typed: underscores are spaces, those at the end are nothing."""
    return F.translate(F.regexp_replace(argument, "_+$", ""), "_", " ")


def encode_locales(locales: Column) -> Column:
    """A locale map as sorted ``language:path`` strings."""
    return F.array_sort(F.transform(F.map_entries(locales), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))


def decode_locales(entries: Column) -> Column:
    """The map back; a path keeps its own colons."""
    pair = lambda e: F.struct(F.substring_index(e, ":", 1).alias("key"), F.regexp_extract(e, r"(?s)^[^:]*:(.*)$", 1).alias("value"))
    return F.map_from_entries(F.transform(entries, pair))


def with_locale(locales: Column, lang: str, path: Column) -> Column:
    """The map with one language set to a path, whether or not it was there."""
    return F.map_concat(F.create_map(F.lit(lang), path), F.map_filter(locales, lambda k, v: k != lang))


def locale_names(locales: Column) -> Column:
    """The languages of a map, sorted."""
    return F.array_sort(F.map_keys(locales))


def locale_path(locales: Column, lang: str = "en") -> Column:
    """The path in one language; null where there is none."""
    return F.try_element_at(locales, F.lit(lang))
