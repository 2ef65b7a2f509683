"""Report links on web pages: harvesting, ranking, and what is remembered per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.computed import computed
from ledgerline.functions import links as L
from ledgerline.functions.numbers import strip
from ledgerline.functions.years import as_date, year_of_link

# What is no markup of the page: comments, and elements whose content is not read as tags.
SILENT = r"(?is)<!--.*?-->|<(script|style|template|textarea)\b.*?</\1\s*>"
# Attributes up to the end of the tag; quoted values may hold any sign.
ATTRIBUTES = r"""^([^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+)>"""
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s"'>]+)))?"""
CLOSING = r"(?i)</a\s*>"
# Where the text of a link that is never closed ends, if no other link begins before.
BLOCK_END = r"(?i)</?(?:li|p|td|th|tr|div|ul|ol|dl|dd|dt|nav|h[1-6]|table|section|article|header|footer|main|body)\b"
# Named character references of links and their texts; the ampersand comes last, so nothing is read twice.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": chr(0xA0), "&amp;": "&"}


def plain_text(text: Column) -> Column:
    """Character references, by number and by name, as the characters they stand for."""
    def sign(number: Column) -> Column:
        digits = F.substr(number, F.lit(2))
        code = F.when(F.lower(number).startswith("x"), F.conv(digits, 16, 10).try_cast("long")).otherwise(number.try_cast("long"))
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(chr(0xFFFD))

    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
    text = F.aggregate(numbers, text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), sign(n)))
    for name, plain in REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def anchors(pages: DataFrame) -> DataFrame:
    """Every link of each page: ``page_id, url, ord, href, text`` (text without tags).

    A page is cut where link tags begin. Of each piece the tag's attributes are read one by one, with double, single or no
    quotes, and the first ``href`` counts; the text runs to the closing tag or, without one, to the end of its block or the
    next link. Tags without ``href`` and what stands in comments or scripts are no links.
    """
    pieces = F.split(F.regexp_replace("html", SILENT, ""), r"(?i)<a(?=[\s/])")
    cut = pages.select("page_id", "url", F.posexplode(pieces).alias("ord", "piece")).filter("ord > 0")
    whole = F.col("piece").rlike(ATTRIBUTES)
    # A quote that is never closed: the tag ends at the first bracket.
    tags = computed(cut, {"attributes": F.when(whole, F.regexp_extract("piece", ATTRIBUTES, 1)).otherwise(F.regexp_extract("piece", "^([^>]*)>", 1))})
    parts = [F.regexp_extract_all("attributes", F.lit(ATTRIBUTE), F.lit(i)) for i in range(1, 5)]
    read = computed(tags, {"names": F.transform(parts[0], F.lower), "double": parts[1], "single": parts[2], "bare": parts[3]},
                    where=lambda r: F.array_contains(r["names"], "href"))
    at = F.array_position("names", "href").cast("int")
    value = F.concat(*[F.element_at(c, at) for c in ("double", "single", "bare")])
    rest = F.substr("piece", F.length("attributes") + 2)
    inner = F.when(rest.rlike(CLOSING), F.get(F.split(rest, CLOSING, 2), F.lit(0))).otherwise(F.get(F.split(rest, BLOCK_END, 2), F.lit(0)))
    return computed(read, {"href": strip(plain_text(value)), "text": strip(plain_text(F.regexp_replace(inner, "<[^>]*>", "")))},
                    ["page_id", "url", "ord"])


def scored(links: DataFrame, year: Column, extension: str = ".pdf", fragment: bool = True) -> DataFrame:
    """Links to files of the extension with their score and tier for a year."""
    files = links.filter(L.ends_as(F.col("href"), extension, fragment))
    return computed(files, {"score": L.score(F.col("href"), F.col("text"), year), "tier": L.tier(F.col("href"))})


def best_link_on_page(links: DataFrame, year: Column, extension: str = ".pdf") -> DataFrame:
    """Best link of each page for one year: statements before other reports, then by score, then first found.

    Reports on part of a year and links without any report word are left out. The pick is an aggregation,
    so a page with very many links is reduced before it moves.
    """
    whole = links.filter(~L.is_partial_year(F.col("href")) & ~F.coalesce(L.is_partial_year(F.col("text")), F.lit(False)))
    good = scored(whole, year, extension, fragment=False).filter(F.col("score") > 0)
    order = F.struct((F.col("tier") != 1).alias("other"), (-F.col("score")).alias("points"), "ord")
    return good.groupBy("page_id").agg(
        F.min_by(F.struct("href", "score", "tier"), order).alias("b")).select("page_id", "b.*")


def yearly_links(links: DataFrame, as_of, extension: str = ".pdf") -> DataFrame:
    """Links with the year they report on; links without a year are left out."""
    whole = links.filter(L.ends_as(F.col("href"), extension) & ~L.is_partial_year(F.col("href")))
    year = year_of_link(F.col("href"), F.col("text"), F.year(as_date(as_of)))
    dated = computed(whole, {"year": year}, where=lambda r: r["year"].isNotNull())
    return computed(dated, {"score": L.score(F.col("href"), F.col("text"), F.col("year"))})


def best_link_per_year(links: DataFrame, as_of, extension: str = ".pdf", site: str = "page_id") -> DataFrame:
    """Best link of each site and year by score, the first found on ties, as a full address."""
    dated = yearly_links(links, as_of, extension)
    full = L.absolute(F.col("href"), L.origin_of(F.col("url")))
    return dated.groupBy(site, "year").agg(
        F.min_by(F.struct(full.alias("link"), "score"), F.struct((-F.col("score")).alias("points"), "ord")).alias("b")
    ).select(site, "year", "b.*")


def first_hit(hits: DataFrame, extension: str = ".pdf") -> DataFrame:
    """First result of each search that leads to a file of the extension."""
    return hits.filter(L.ends_as(F.col("href"), extension, fragment=False)).groupBy("query").agg(
        F.min_by("href", "rank").alias("href"))


def snippets(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` results of each search as ``title: body``; of equal ranks the smaller text comes first.

    Outer colons and blanks are cut, so a missing title or body leaves no mark; a result without either takes its place but
    gives no snippet. Only the first ``n`` of a search survive in each task before they meet.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = hits.select("query", "rank", F.trim(F.concat(said("title"), F.lit(": "), said("body")), F.lit(": ")).alias("snippet"))
    place = F.row_number().over(W.partitionBy("query").orderBy("rank", "snippet"))
    return each.withColumn("place", place).where(F.col("place") <= n).where("snippet <> ''").select("query", "place", "snippet")


# --- remembered addresses ---------------------------------------------------------------------------

def merge_year_links(old: DataFrame, new: DataFrame, newer_wins: bool) -> DataFrame:
    """Merge ``slug, year, url`` tables; either the new or the old address of a year stays."""
    a = old.select("slug", "year", F.col("url").alias("_old"))
    b = new.select("slug", "year", F.col("url").alias("_new"))
    url = F.coalesce("_new", "_old") if newer_wins else F.coalesce("_old", "_new")
    return a.join(b, ["slug", "year"], "full").select("slug", "year", url.alias("url"))


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge site profiles (``schema.PROFILES``).

    New scalars win where given; a known address pattern or path is never replaced by an empty one; failed
    searches and known report addresses accumulate.
    """
    def entries(side: str, c: str) -> Column:
        return F.coalesce(F.map_entries(F.col(f"{side}.{c}")), F.array())

    def merged_map(c: str) -> Column:
        fresh = F.coalesce(F.map_keys(F.col(f"b.{c}")), F.array())
        kept = F.filter(entries("a", c), lambda e: ~F.array_contains(fresh, e["key"]))
        both = F.concat(kept, entries("b", c))
        return F.when(F.size(both) > 0, F.map_from_entries(both))

    def scalar(c: str) -> Column:
        return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))

    out = {
        "domain": scalar("domain"), "last_success": scalar("last_success"), "strategy": scalar("strategy"),
        "pdf_url_pattern": F.coalesce(
            F.nullif(F.col("b.pdf_url_pattern"), F.lit("")), F.nullif(F.col("a.pdf_url_pattern"), F.lit("")),
            F.col("b.pdf_url_pattern")),
        "nav_path": F.coalesce(F.when(F.size("b.nav_path") > 0, F.col("b.nav_path")), F.col("a.nav_path"), F.col("b.nav_path")),
        "doc_tier": scalar("doc_tier"),
        "failed_ddgs_queries": F.array_distinct(F.concat(
            F.coalesce(F.col("a.failed_ddgs_queries"), F.array()),
            F.coalesce(F.col("b.failed_ddgs_queries"), F.array()))),
        "historical_pdfs": merged_map("historical_pdfs"),
        "t2_pdfs": F.coalesce(F.col("b.t2_pdfs"), F.col("a.t2_pdfs")),
        "notes": scalar("notes"),
    }
    return old.alias("a").join(new.alias("b"), "slug", "full").select("slug", *[c.alias(n) for n, c in out.items()])


def report_url(meta: DataFrame, requests: DataFrame) -> DataFrame:
    """Address of the report of a company's year from its profile's map."""
    return requests.join(meta.select("slug", "t2_pdfs"), "slug", "left").select(
        "slug", "fiscal_year", F.try_element_at("t2_pdfs", F.col("fiscal_year")).alias("url"))


def with_domain(companies: DataFrame, profiles: DataFrame) -> DataFrame:
    """Company address, or its profile's domain where none is known."""
    known = profiles.select("slug", F.col("domain").alias("_domain"))
    return companies.join(known, "slug", "left").withColumn(
        "url", F.coalesce(F.nullif("url", F.lit("")), F.col("_domain"), F.lit(""))).drop("_domain")
