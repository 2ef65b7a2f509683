"""Fiscal years and quarters. "Today" is always an argument, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerline.functions.numbers import once


EARLIEST_LINK_YEAR = 2015
EARLIEST_FILE_YEAR = 2018


def as_date(day) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def same_quarter(a: Column, b: Column) -> Column:
    return (F.year(a) == F.year(b)) & (F.quarter(a) == F.quarter(b))


def is_stale(last_loaded: Column, as_of) -> Column:
    """Not loaded in the quarter of ``as_of``; unknown or unreadable times count as stale."""
    when = F.try_to_timestamp(last_loaded.cast("string"))
    return F.coalesce(~same_quarter(when, as_date(as_of)), F.lit(True))


def default_report_year(as_of) -> Column:
    """Last year from July on, before that the year before it."""
    day = as_date(as_of)
    return F.year(day) - F.when(F.month(day) >= 7, 1).otherwise(2)


def _first_valid(text: Column, pattern: str, latest: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: s.cast("int"))
    return F.try_element_at(
        F.filter(found, lambda y: y.between(F.lit(EARLIEST_LINK_YEAR), latest)), F.lit(1)
    )


def year_in_text(text: Column, latest: Column) -> Column:
    """First year from 2015 to ``latest`` standing as a word, else first one inside a longer word."""
    return F.coalesce(
        _first_valid(text, r"\b(20[12]\d)\b", latest),
        _first_valid(text, r"(20[12]\d)", latest),
    )


def year_of_link(href: Column, text: Column, latest: Column) -> Column:
    """Year of a report link: from the file name, else the link text, else the whole address."""
    name = F.substring_index(href, "/", -1)
    return F.coalesce(
        year_in_text(name, latest), year_in_text(text, latest), year_in_text(href, latest)
    )


def year_of_file(name: Column, as_of) -> Column:
    """The first ``20dd`` of a file name when it is from 2018 to now, else the default year."""
    found = F.regexp_extract(name, r"(20\d{2})", 1).try_cast("int")
    return F.when(
        found.between(F.lit(EARLIEST_FILE_YEAR), F.year(as_date(as_of))), found
    ).otherwise(default_report_year(as_of))


def year_in_cell(year: Column, cell: Column) -> Column:
    """The cell names the year in full, or as two digits after a hyphen or space."""
    full = year.cast("string")
    two = F.substring(full, 3, 4)
    text = F.coalesce(cell, F.lit(""))
    endings = F.regexp_extract_all(text, F.lit(r"[-\s](\d\d)\b"), F.lit(1))
    return text.contains(full) | (text.contains(two) & F.array_contains(endings, two))


def header_years(text: Column, as_of, span: int | None = None) -> Column:
    """``struct(current, previous, current_is_left)`` of a two-column statement, from its text or the first ``span`` characters.

    The two latest years found are the columns. Their order comes from the first line that holds both,
    else from where each first stands.
    """
    now = F.year(as_date(as_of))

    def years_in(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(r"\b(20[12]\d)\b"), F.lit(1)).cast("array<int>")

    def in_order(latest: Column, before: Column) -> Column:
        def holds_both(line: Column) -> Column:
            named = line.contains(latest.cast("string")) & line.contains(before.cast("string"))
            return named & once(years_in(line), lambda ys: F.array_contains(ys, latest) & F.array_contains(ys, before))

        lines = F.filter(F.split(head, "\n"), holds_both)
        return once(years_in(F.coalesce(F.get(lines, F.lit(0)), head)), lambda ys: F.array_position(ys, latest) < F.array_position(ys, before))

    def judge(years: Column) -> Column:
        latest, before = F.get(years, F.lit(0)), F.get(years, F.lit(1))
        return F.struct(
            F.coalesce(latest, now - 1).alias("current"),
            F.coalesce(before, latest - 1, now - 2).alias("previous"),
            F.coalesce(F.when(before.isNotNull(), in_order(latest, before)), F.lit(False)).alias("current_is_left"),
        )

    head = text if span is None else F.substring(text, 1, span)
    return once(F.sort_array(F.array_distinct(years_in(head)), asc=False), judge)


def whole_year(start: Column, end: Column) -> Column:
    """The period is longer than 300 days."""
    return F.datediff(end, start) > 300


