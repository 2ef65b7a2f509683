"""Report links: tiers, scores, domains and file names. Addresses are judged by their text alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import once
from ledgerline.functions.text import contains_any


def _fold(c: Column) -> Column:
    return F.translate(c, fixed.LINK_FOLD_FROM, fixed.LINK_FOLD_TO)


def path_of(href: Column) -> Column:
    """Path of an address, which may be relative: no scheme, host, query or fragment."""
    rest = F.regexp_replace(href, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    return F.regexp_extract(rest, r"^([^?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host (with port) of an absolute address in lower case without a leading ``www.``."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def file_of(href: Column) -> Column:
    return F.substring_index(path_of(href), "/", -1)


def ends_as(href: Column, extension: str = ".pdf", fragment: bool = True) -> Column:
    """The link leads to a file with this extension (a query, or a fragment, may follow)."""
    low = F.lower(href)
    out = low.endswith(extension) | low.contains(extension + "?")
    return out | low.contains(extension + "#") if fragment else out


def is_partial_year(text: Column) -> Column:
    return text.rlike(fixed.PARTIAL_YEAR_PATTERN)


def tier(url: Column) -> Column:
    """1 for statements, 2 for annual and management reports, 3 for the rest."""
    return once(_fold(F.lower(url)), lambda low: F.when(contains_any(low, fixed.LINK_TIER1), 1).when(
        contains_any(low, fixed.LINK_TIER2), 2).otherwise(3))


def score(href: Column, text: Column, year: Column) -> Column:
    """Points for report words (file name before link text before path, tier by tier) and for the year."""
    def points_of(x: Column) -> Column:
        name, said, path = x["name"], x["said"], x["path"]
        return (
            F.when(contains_any(name, fixed.LINK_TIER1), 10)
            .when(contains_any(said, fixed.LINK_TIER1), 8)
            .when(contains_any(path, fixed.LINK_TIER1), 5)
            .when(contains_any(name, fixed.LINK_TIER2), 5)
            .when(contains_any(said, fixed.LINK_TIER2), 4)
            .when(contains_any(path, fixed.LINK_TIER2), 2)
            .when(contains_any(name, fixed.LINK_TIER3), 2)
            .when(contains_any(said, fixed.LINK_TIER3), 1)
            .otherwise(0)
        )

    low = F.lower(text)
    texts = once(_fold(F.lower(path_of(href))), lambda path: F.struct(
        F.substring_index(path, "/", -1).alias("name"), _fold(low).alias("said"), path.alias("path")))
    this, last = year.cast("string"), (year - 1).cast("string")
    dated = F.coalesce(href.contains(this) | href.contains(last) | low.contains(this), F.lit(False))
    return once(once(texts, points_of), lambda p: p + F.when((p > 0) & dated, 3).otherwise(0))


def on_domain(url: Column, domain: Column) -> Column:
    host = host_of(url)
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def relevance(url: Column, domain: Column, year: Column, size: Column) -> Column:
    """0 to 1: how likely the address is this company's annual report. ``size`` in bytes may be null."""
    target = F.when(F.instr(domain, "://") > 0, host_of(domain)).otherwise(
        F.regexp_replace(F.lower(domain), r"^www\.", ""))
    host = host_of(url)
    words = contains_any(F.lower(path_of(url)), fixed.LINK_PATH_WORDS)
    dated = F.coalesce(
        url.contains(year.cast("string")) | url.contains((year - 1).cast("string")), F.lit(False))
    related = (host != "") & (target != "") & (
        (host == target) | host.endswith(F.concat(F.lit("."), target))
        | target.endswith(F.concat(F.lit("."), host))
    )
    total = (
        F.when(ends_as(url, fragment=False), 1).otherwise(0)
        + F.when(words, 2).otherwise(0)
        + F.when(dated, 1).otherwise(0)
        + F.when(related & (words | dated), 5).when(related, 2).otherwise(0)
        + F.when(size > 100_000, 1).otherwise(0)
    )
    return F.when(F.length(url) > 0, F.least(total / F.lit(10.0), F.lit(1.0))).otherwise(0.0)


def _resolved(path: Column) -> Column:
    """A relative path without empty steps and with ``.`` and ``..`` walked: a stack folded over its segments."""
    def walk(segments: Column) -> Column:
        def step(stack: Column, segment: Column) -> Column:
            above = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
            return F.when(segment == "..", above).when(segment == ".", stack).otherwise(F.concat(stack, F.array(segment)))

        last = F.element_at(segments, -1)
        inner = F.filter(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda x: x != "")
        # What ends in a step names a folder.
        ending = F.when(last.isin(".", ".."), F.array(last, F.lit(""))).otherwise(F.array(last))
        return F.aggregate(F.concat(inner, ending), F.array().cast("array<string>"), step)

    return F.array_join(once(F.split(path, "/"), walk), "/")


def absolute(href: Column, origin: Column) -> Column:
    """Full address of a link found on a site. Relative paths start at the site's root; ``.`` and ``..`` are resolved anywhere."""
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    # A mark that nothing follows is left out.
    rest = F.regexp_replace(F.substr(href, F.length(path) + 1), r"^\?(?=#|$)|#$", "")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "")
        .when(href.startswith("http"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, F.lit("/"), _resolved(path), rest))
    )


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def safe_file_name(url: Column) -> Column:
    """File name to store a download under: safe characters, ``.pdf``, and a hash when the name says nothing."""
    last = F.substring_index(F.substring_index(F.rtrim(url, F.lit("/")), "/", -1), "?", 1)
    clean = F.regexp_replace(last, r"(?U)[^\w.\-]", "_")
    name = F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    vague = (F.length(name) < 8) | F.lower(name).startswith("download")
    return F.when(vague, F.concat(F.substring(F.sha2(url, 256), 1, 8), F.lit("_"), name)).otherwise(name)


def url_for_year(pattern: Column, year: Column) -> Column:
    """Put a year in place of the ``*`` or the year words of a stored address."""
    return F.regexp_replace(pattern, F.lit(r"\*|\b20\d{2}\b"), year.cast("string"))


def url_pattern(url: Column, year: Column) -> Column:
    return F.replace(url, year.cast("string"), F.lit("*"))
