"""Narrative sections of management reports.

Page numbers are found first, by aggregations over page flags alone; texts are then joined only for the
two pages a section can have. No report's pages are gathered or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import strip
from ledgerline.functions.text import is_contents_page, mentions, opens_with

ANYWHERE = ["objections", "portfolio"]
# Fixed value: lines of a page among which a section's heading stands.
FIRST_LINES = 8


def content_pages(pages: DataFrame, words: dict[str, list[str]], first_lines: int = FIRST_LINES) -> DataFrame:
    """Pages with text that are not tables of contents, with a flag per section, judged by their ``first_lines``."""
    text = F.col("text")
    flags = {}
    for name in words:
        hit = opens_with(text, words[name], first_lines)
        flags[name] = hit | mentions(text, words[name]) if name in ANYWHERE else hit
    content = pages.filter((strip(text) != "") & ~is_contents_page(text))
    return content.select("doc", "page", *[c.alias(n) for n, c in flags.items()])


def section_pages(pages: DataFrame, words: dict[str, list[str]] | None = None, first_lines: int = FIRST_LINES) -> DataFrame:
    """Per report and section the one or two pages it is taken from.

    A section starts on the first page that announces it and runs over the next content page. Without such
    a page the introduction is the first two content pages and the conclusions the last two.
    """
    words = words or fixed.NARRATIVE_WORDS
    content = content_pages(pages, words, first_lines)
    page = F.col("page")
    firsts = content.groupBy("doc").agg(
        F.min(page).alias("head"), F.max(page).alias("tail"),
        *[F.min(F.when(F.col(n), page)).alias(f"at_{n}") for n in words])
    placed = content.select("doc", "page").join(firsts, "doc")
    nexts = placed.groupBy("doc").agg(
        F.first("head").alias("head"), F.first("tail").alias("tail"),
        F.min(F.when(page > F.col("head"), page)).alias("second"),
        F.max(F.when(page < F.col("tail"), page)).alias("second_last"),
        *[F.first(f"at_{n}").alias(f"at_{n}") for n in words],
        *[F.min(F.when(page > F.col(f"at_{n}"), page)).alias(f"next_{n}") for n in words])

    def taken(a: Column, b: Column) -> Column:
        return F.array_compact(F.array(a, b))

    found = {n: F.when(F.col(f"at_{n}").isNotNull(), taken(F.col(f"at_{n}"), F.col(f"next_{n}"))) for n in words}
    default = {"intro": taken(F.col("head"), F.col("second")), "conclusions": taken(F.col("second_last"), F.col("tail"))}
    chosen = {n: F.coalesce(c, default[n]) if n in default else c for n, c in found.items()}
    staged = nexts.select("doc", *[c.alias(n) for n, c in chosen.items()])
    # A closing section on the pages of an earlier one is not repeated.
    keep = {n: F.lit(True) for n in words}
    if {"intro", "conclusions"} <= set(words):
        keep["conclusions"] = F.col("conclusions") != F.col("intro")
    if {"intro", "conclusions", "portfolio"} <= set(words):
        keep["portfolio"] = (F.col("portfolio") != F.col("intro")) & (F.col("portfolio") != F.col("conclusions"))
    entries = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("section"), F.when(keep[n], F.col(n)).alias("pages"))
        for i, n in enumerate(words)])
    return staged.select("doc", F.explode(entries).alias("s")).select("doc", "s.*").filter(
        F.col("pages").isNotNull() & (F.size("pages") > 0))


def narrative_sections(pages: DataFrame, words: dict[str, list[str]] | None = None,
                       lengths: dict[str, int] | None = None, first_lines: int = FIRST_LINES) -> DataFrame:
    """Text of each section; with ``lengths``, cut to the room each has (see ``fixed.NARRATIVE_LENGTHS``)."""
    wanted = section_pages(pages, words, first_lines).select("doc", "place", "section", F.explode("pages").alias("page"))
    texts = wanted.join(pages.select("doc", "page", "text"), ["doc", "page"])
    # A section has at most two pages.
    joined = texts.groupBy("doc", "place", "section").agg(F.concat_ws(
        "\n\n", F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])).alias("t"))
    text = strip(F.col("t"))
    if lengths is not None:
        text = F.substring(text, F.lit(1), F.create_map(*[F.lit(x) for k, v in lengths.items() for x in (k, v)])[F.col("section")])
    return joined.select("doc", "place", "section", text.alias("text"))


def narrative(pages: DataFrame, words: dict[str, list[str]] | None = None) -> DataFrame:
    """One text per report: its titled sections in order."""
    titles = F.create_map(*[F.lit(x) for k, v in fixed.NARRATIVE_TITLES.items() for x in (k, v)])
    block = F.concat_ws("\n", titles[F.col("section")], F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("place", block.alias("b"))))
    return narrative_sections(pages, words).groupBy("doc").agg(
        F.concat_ws("\n\n", F.transform(blocks, lambda x: x["b"])).alias("narrative"))
