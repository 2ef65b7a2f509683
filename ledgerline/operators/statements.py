"""Statement values from report contents: cell tables, text lines, and lines of recognised scans.

All three produce the same long table ``EXTRACTED`` plus the labels they could not map. Reports may be of
any length: no text or table row of a long one is gathered in one task, only narrow rows of its pages and known lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline import fixed
from ledgerline.computed import computed
from ledgerline.functions.numbers import parse_number, parse_numbers, strip, strip_footnote
from ledgerline.functions.text import (
    is_non_current, is_scanned_page, lines_of, section_of,
)
from ledgerline.functions.years import header_years, year_in_cell
from ledgerline.operators.carry import carry_forward, long_groups
from ledgerline.operators.labels import map_labels

PAGE_BLOCK = 1024
#: Pages whose headings are kept together, and rows of a table that one task fills.
HEADING_BLOCK, ROW_BLOCK = 64, 1024


@dataclass
class Extraction:
    """Values found, and the rows whose label is unknown (with ``company`` and ``pdf`` for the review).

    ``readings`` are the values with one more row, without field and value, for each report and year that was read.
    """

    values: DataFrame
    unmatched: DataFrame
    readings: DataFrame | None = None


# --- sections ----------------------------------------------------------------------------------------

def page_sections(pages: DataFrame) -> DataFrame:
    """Section of each page: its own heading, else the last one before it, else ``unknown``."""
    carried = carry_forward(
        pages.select("doc", "page", section_of(F.col("text")).alias("heading")), ["doc"], ["page"], {"section": F.col("heading")},
        F.floor(F.col("page") / PAGE_BLOCK))
    return carried.select("doc", "page", F.coalesce("section", F.lit("unknown")).alias("section"))


def scanned_docs(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Per report whether more than half of its pages are pictures without text."""
    scanned = is_scanned_page(F.coalesce("text", F.lit("")), F.col("n_images"))
    return pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(scanned).alias("n_scanned")
    ).withColumn("is_scanned", F.col("n_scanned") > F.col("n_pages") * share)


# --- cell tables -------------------------------------------------------------------------------------

def _empty_number(v: Column) -> Column:
    return v.isNull() | (v == 0)


def is_header_row(cells: Column) -> Column:
    """No cell after the first holds an amount: each is null, a four-digit year, not a number, or zero."""
    rest = F.slice(cells, F.lit(2), F.size(cells))
    return F.forall(rest, lambda c: c.isNull() | strip(c).rlike(r"^\d{4}$") | _empty_number(parse_number(c)))


def _is_header(rest: Column, numbers: Column) -> Column:
    """The same test for the cells after the first with their numbers at hand."""
    is_year = lambda c, v: (v > 0) & (v < 10000) & strip(c).rlike(r"^\d{4}$")
    return F.forall(F.zip_with(rest, numbers, lambda c, v: _empty_number(v) | is_year(c, v)), lambda b: b)


def column_of_year(cells: Column, year: Column) -> Column:
    """Position (from 0) of the first cell naming the year; null when none does."""
    named = F.transform(cells, lambda c: year_in_cell(year, c))
    at = F.array_position(named, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def rightmost_number(cells: Column) -> Column:
    """Last cell after the first that reads as a number."""
    return _last_known(parse_numbers(F.slice(cells, F.lit(2), F.size(cells))))


def _last_known(numbers: Column) -> Column:
    return F.try_element_at(F.filter(numbers, lambda v: v.isNotNull()), F.lit(-1))


def _parsed_rows(cells: DataFrame) -> DataFrame:
    """Each table row parsed once: label, amounts and where the last one stands, and the year columns that a header row names.

    Rows that neither name a year nor show a label and an amount are left out.
    """
    year, row, place = F.col("fiscal_year"), F.col("cells"), ["doc", "country", "fiscal_year", "page", "table_no", "row_no"]
    known_year = F.coalesce(year != 0, F.lit(False))
    # What ends in another sign than a number's may be an amount with a footnote; any other cell reads the same without this.
    footnoted = F.transform(row, lambda c: F.when(c.rlike(r"[0-9]") & c.rlike(r"[^0-9.,)(\-]$"), strip_footnote(c)))
    rows = computed(cells.filter(F.size("cells") >= 2), {"read": parse_numbers(row), "marked": parse_numbers(footnoted)}, [*place, "cells"])
    rest, numbers = F.slice(row, F.lit(2), F.size(row)), F.slice("read", F.lit(2), F.size(row))  # of the cells after the first
    first = strip(F.coalesce(F.get(row, F.lit(0)), F.lit("")))
    second = strip(F.coalesce(F.get(row, F.lit(1)), F.lit("")))
    second_is_text = (second != "") & _empty_number(F.get("read", F.lit(1)))
    last_at = F.array_max(F.transform("read", lambda v, i: F.when(v.isNotNull() & (i > 0), i)))
    rows = computed(rows, {
        "is_header": known_year & _is_header(rest, numbers), "label": F.when(first != "", first).when(second_is_text, second),
        "last_at": last_at, "amounts": F.zip_with("read", "marked", lambda v, m: F.coalesce(v, m))}, [*place, "cells"])
    named, before = column_of_year(row, year), column_of_year(row, year - 1)
    rows = computed(rows, {
        "here": F.when(F.col("is_header"), named), "before_here": F.when(F.col("is_header") & (named != before), before),
        "shows": ~F.col("is_header") & (F.length("label") >= 4) & F.exists("amounts", lambda v: v.isNotNull())},
        [*place, "is_header", "label", "last_at", "amounts"])
    return rows.filter(F.col("here").isNotNull() | F.col("shows")).drop("shows")


def _with_values(rows: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """Amounts of :func:`_parsed_rows` under the year columns of their report, header rows removed; of the texts only ``name`` travels.

    A report of few rows is one block, so that only its rows move; a longer one is cut by rows within a table. Which ones are
    long is counted before, from the reports' names alone.
    """
    place = ["doc", "country", "fiscal_year", "page", "table_no", "row_no"]
    listed = long_groups(cells, "doc").select(F.struct(F.col("doc").alias("long_doc")).alias("_long"))
    rows = rows.join(F.broadcast(listed), F.col("doc").eqNullSafe(F.col("_long.long_doc")), "left")
    run = F.struct("page", "table_no", F.floor(F.col("row_no") / ROW_BLOCK).alias("rows"))
    rows = carry_forward(
        rows, ["doc"], ["page", "table_no", "row_no"], {"year_col": F.col("here"), "before_col": F.col("before_here")},
        F.when(F.col("_long").isNotNull(), run), keep=[*place, "is_header", name, "last_at", "amounts"])

    col, before, amounts = F.col("year_col"), F.col("before_col"), F.col("amounts")
    beside = F.when(col > 0, F.get(amounts, col - 1))
    return computed(
        rows.filter(~F.col("is_header")),
        {
            "value": F.coalesce(F.when(col < F.size(amounts), F.coalesce(F.get(amounts, col), beside)), F.get(amounts, F.col("last_at"))),
            "value_before": F.when(before < F.size(amounts), F.get(amounts, before)),
        },
        [*place, name], lambda r: r["value"].isNotNull())


def cell_rows(cells: DataFrame) -> DataFrame:
    """Each table row with its label, its amount and that of the year before, header rows removed.

    The year columns come from the last header row of the report that names the year. With the year's cell
    empty, the cell to its left counts, then the rightmost number of the row. Cells are read and parsed once;
    blocks are cut by rows within a table, so a long report on one page is many tasks.
    """
    return _with_values(_parsed_rows(cells), cells, "label")


def known_cell_rows(cells: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """:func:`cell_rows` whose label is known, with its field in place of the label. Labels are looked up first, so other rows stay where they are."""
    rows = map_labels(_parsed_rows(cells), learned=learned)
    return _with_values(rows.filter(F.col("here").isNotNull() | F.col("canonical").isNotNull()), cells, "canonical")


def fallback_columns(cells: DataFrame) -> DataFrame:
    """Reports whose year heads the second column, which is also the guess used without a header."""
    year, row = F.col("fiscal_year"), F.col("cells")
    hit = is_header_row(row) & (column_of_year(row, year) == 1) & (F.size(row) >= 2)
    return cells.filter(hit).groupBy("doc").agg(F.count(F.lit(1)).alias("n_warnings")).withColumn(
        "warning", F.lit("fallback_year_column_used"))


def headings(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """Per report and block of pages the headings in it (a page has three at most), and the last one of the blocks before."""
    found = pages.select("doc", "page", section_of(F.col("text") if text is None else text).alias("heading"))
    entry = F.when(F.col("heading").isNotNull(), F.struct("page", "heading"))
    blocks = found.groupBy("doc", F.floor(F.col("page") / HEADING_BLOCK).alias("block")).agg(F.array_sort(F.collect_set(entry)).alias("headings"))
    before = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.try_element_at("headings", F.lit(-1))["heading"]
    return blocks.withColumn("earlier", F.last(last, ignorenulls=True).over(before))


def _with_sections(rows: DataFrame, pages: DataFrame | None, text: Column | None = None) -> DataFrame:
    """``rows`` with the section their page stands in: the page's own heading, else the last one before it."""
    if pages is None:
        return rows.withColumn("section", F.lit("unknown"))
    joined = rows.withColumn("block", F.floor(F.col("page") / HEADING_BLOCK)).join(headings(pages, text), ["doc", "block"], "left")
    here = F.try_element_at(F.filter("headings", lambda h: h["page"] <= F.col("page")), F.lit(-1))["heading"]
    return joined.withColumn("section", F.coalesce(here, "earlier", F.lit("unknown"))).drop("block", "headings", "earlier")


def _best(rows: DataFrame, rank: list[Column]) -> DataFrame:
    """One value per report, year and field: the row that comes first by ``rank``.

    A row offers its value for the report's year and, where ``before`` is given, ``value_before`` for that
    year; both go through one aggregation.
    """
    def offer(year: str, value: str, comparative: bool) -> Column:
        return F.struct(F.col(year).alias("fiscal_year"), F.col(value).alias("value"), F.lit(comparative).alias("comparative"))

    offers = [offer("fiscal_year", "value", False)]
    if "before" in rows.columns:
        offers.append(offer("before", "value_before", True))
    known = rows.filter(F.col("canonical").isNotNull())
    rest = [c for c in known.columns if c not in ("fiscal_year", "value", "value_before", "before")]
    one = F.explode(F.filter(F.array(*offers), lambda o: o["value"].isNotNull())).alias("o")
    long = known.select(*rest, one).select(*rest, "o.*")
    best = long.groupBy("doc", "country", "fiscal_year", "canonical", "comparative").agg(
        F.min_by(F.struct("value", "page"), F.struct(*rank)).alias("v"))
    return best.select("doc", "country", "fiscal_year", "canonical", "v.*", "comparative")


def _extraction(rows: DataFrame, rank: list[Column], method: str, pages: DataFrame | None) -> Extraction:
    """The best row per field with its section, which is looked up for the chosen rows only."""
    values = _with_sections(_best(rows, rank), pages)
    unmatched = _with_sections(rows.filter(F.col("canonical").isNull()), pages).withColumns(
        {"company": F.col("doc"), "pdf": F.col("doc")})
    return Extraction(values.withColumn("method", F.lit(method)).select(*VALUES), unmatched)


def extract_cells(cells: DataFrame, pages: DataFrame | None = None, learned: DataFrame | None = None) -> Extraction:
    """Fields from cell tables: the first row per field, for the report's year and the year before it."""
    rows = map_labels(cell_rows(cells), learned=learned).withColumn("before", F.col("fiscal_year") - 1)
    return _extraction(rows, [F.col("page"), F.col("table_no"), F.col("row_no")], "cell_table", pages)


# --- text lines --------------------------------------------------------------------------------------

def text_rows(pages: DataFrame) -> DataFrame:
    """Label and rightmost number of each line whose parts are two or more spaces (or a tab) apart."""
    lines = pages.select(
        "doc", "country", "fiscal_year", "page", F.posexplode(lines_of(F.col("text"))).alias("line", "raw"))
    place = ["doc", "country", "fiscal_year", "page", "line"]
    lines = lines.filter(F.col("raw").rlike("[0-9]"))  # a line without a digit shows no amount
    parts = computed(lines, {"parts": F.split(strip(F.col("raw")), r"\s{2,}|\t")}, place, lambda r: F.size(r["parts"]) >= 2)
    return computed(
        parts, {"label": strip(F.get("parts", F.lit(0))), "value": rightmost_number(F.col("parts"))}, place,
        lambda r: r["value"].isNotNull() & (F.length(r["label"]) >= 4))


def extract_lines(pages: DataFrame, learned: DataFrame | None = None) -> Extraction:
    """Fields from plain text: the first line per field."""
    rows = map_labels(text_rows(pages), learned=learned)
    return _extraction(rows, [F.col("page"), F.col("line")], "text_lines", pages)


# --- recognised scans, and the choice between readings ---------------------------------------------------

TEXT, SCAN, CELLS, PAGE = "text_lines", "scan_lines", "cell_table", "page"


def recognised_text(pages: DataFrame) -> Column:
    """What a scan is read from: the column ``recognised`` where pages have one, else their text."""
    return F.col("recognised") if "recognised" in pages.columns else F.col("text")


def _kind_rows(pages: DataFrame, as_of, kinds: tuple[str, ...], max_pages: int | None, learned: DataFrame | None,
               heads: Column | None = None) -> DataFrame:
    """One row for each page, and for each line that shows a label and an amount, read as text or as a scan.

    Lines have ``label``, ``canonical`` and the amounts ``a`` and ``b`` (the second of a scan's line, if it is another one);
    pages whether they are ``scanned``, the ``heading`` of a section in ``heads`` and, the first one, the ``years`` of its
    columns. Each text is taken apart once.
    """
    place = ["doc", "country", "fiscal_year", "page", "heading"]
    pages = pages.withColumn("heading", section_of(recognised_text(pages) if heads is None else heads))

    scan_text = recognised_text(pages)
    if max_pages is not None:
        scan_text = F.when(F.col("page") <= max_pages, scan_text)
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.coalesce(text, F.lit("")).alias("part"))
    parts = [part(PAGE, F.lit("")), *[part(k, F.col("text") if k == TEXT else scan_text) for k in kinds]]
    rows = computed(pages, {
        "scanned": is_scanned_page(F.coalesce("text", F.lit("")), F.col("n_images")),
        "years": F.when(F.col("page") == 1, header_years(recognised_text(pages), as_of)), "parts": F.array(*parts)}, place)
    place = [*place, "scanned", "years", "kind"]
    rows = rows.select(*place[:-1], F.explode("parts").alias("p")).select(*place[:-1], "p.*")
    is_scan, is_text, raw = F.col("kind") == SCAN, F.col("kind") == TEXT, F.col("raw")
    # A line without a digit shows no amount.
    rows = rows.select(*place, F.posexplode(lines_of(F.col("part"))).alias("line", "raw")).filter((F.col("kind") == PAGE) | raw.rlike("[0-9]"))
    rows = rows.withColumn("raw", strip(raw))
    place = [*place, "line"]
    wide = F.split(raw, r"\s{2,}|\t")
    rows = computed(rows, {
        "words": F.when(is_text, wide), "money": F.when(is_scan, F.regexp_extract_all("raw", F.lit(f"({fixed.MONEY_PATTERN})"), F.lit(1)))},
        [*place, "raw"], lambda r: (F.size(r["words"]) >= 2) | (F.size(r["money"]) > 0) | ~(is_text | is_scan))

    start = F.position(F.get("money", F.lit(0)), raw)
    before_money = strip(F.regexp_replace(strip(F.substring(raw, F.lit(1), start - 1)), r"\s*[\[(].*$", ""))
    amounts = F.transform(F.slice("money", 1, 2), lambda m: F.translate(m, "$", ""))
    rows = computed(rows, {
        "wide": F.when(is_text, F.col("words")).when(is_scan, wide), "beside": F.when(is_scan, before_money),
        "read": parse_numbers(F.when(is_text, F.slice("words", F.lit(2), F.size("words"))).when(is_scan, amounts))}, place)
    label = F.when(F.col("beside") != "", F.col("beside")).when(F.size("wide") >= 2, strip(F.get("wide", F.lit(0))))
    rows = computed(
        rows, {"label": label, "a": F.when(is_text, _last_known(F.col("read"))).when(is_scan, F.get("read", F.lit(0))),
               "second": F.when(is_scan, F.get("read", F.lit(1)))}, place,
        lambda r: (F.col("kind") == PAGE) | (r["a"].isNotNull() & (F.length(r["label"]) >= 4) & (is_text | ~is_non_current(r["label"]))))
    return map_labels(rows, learned=learned).withColumn("b", F.when(F.col("second") != F.col("a"), F.col("second"))).drop("second")


#: What tells one offer of a report from another; ``year`` and ``comparative`` are those of cells, ``block`` is one of pages. In this
#: order the aggregation leaves rows sorted as the windows over a report's kinds and blocks want them.
OFFER = ["doc", "country", "kind", "block", "canonical", "year", "comparative"]


def _reduced(rows: DataFrame, in_cells: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """Per report, kind of reading and field: the first amount of texts, the largest of scans under either order of columns.

    A scan's column order stands on its first page, a field's amounts may stand on any; both orders are kept and the order is
    chosen afterwards. Pages become a row for each block of ``HEADING_BLOCK``, in which every section has a bit for each page
    with its heading. Values ``in_cells`` go along. Lines of known fields and pages move once, as narrow rows dealt out by
    report: every later step finds a report's rows together, and nothing is sorted before it moves.
    """
    page, is_page = F.col("page"), F.col("kind") == PAGE
    narrow = rows.filter(is_page | F.col("canonical").isNotNull()).select(
        "doc", "country", "kind", "canonical", "fiscal_year", page.cast("bigint").alias("page"), "line", "a", "b",
        *[F.when(is_page, F.col(c)).alias(c) for c in ("scanned", "years", "heading")])
    if in_cells is not None:
        best = in_cells.select("doc", "country", F.lit(CELLS).alias("kind"), "canonical", "fiscal_year", page.cast("bigint").alias("page"),
                               F.col("value").alias("a"), F.col("fiscal_year").alias("year"), "comparative")
        narrow = narrow.unionByName(best, allowMissingColumns=True)
    else:
        narrow = narrow.withColumns({"year": F.lit(None).cast("int"), "comparative": F.lit(None).cast("boolean")})
    listed = is_page if max_pages is None else is_page & (page <= max_pages)
    dealt = narrow.repartition("doc").withColumn("block", F.when(listed, F.floor(page / HEADING_BLOCK)))

    a, b, scan = F.col("a"), F.col("b"), F.col("kind") == SCAN

    def foremost(value: Column) -> Column:
        rank = F.when(scan, -F.abs(value)).otherwise(0.0)  # lines of texts count by their place alone
        return F.min(F.when(value.isNotNull(), F.struct(rank.alias("rank"), "page", "line", value.alias("value"))))

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _in_block(page))
    heads = {s: F.bit_or(F.when(listed & (F.col("heading") == s), bit)).alias(s) for s in fixed.SECTION_HEADINGS}
    return dealt.groupBy(*OFFER).agg(
        F.max("fiscal_year").alias("fiscal_year"), F.count_if(is_page).alias("n_pages"), F.count_if(is_page & F.col("scanned")).alias("n_scanned"),
        F.max("years").alias("years"), foremost(a).alias("left"), foremost(F.when(scan, b)).alias("right"),
        foremost(F.when(scan, F.coalesce(b, a))).alias("right_or_only"), foremost(F.when(scan & b.isNotNull(), a)).alias("left_of_two"), *heads.values())


def _in_block(page: Column) -> Column:
    return F.pmod(page, F.lit(HEADING_BLOCK)).cast("int")


def _last_heading(page: Column) -> Column:
    """The last heading up to ``page`` in its block, from the bits of the sections; of two on one page the greater name."""
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(HEADING_BLOCK - 1) - _in_block(page))
    bits = {s: F.col(s).bitwiseAND(upto) for s in fixed.SECTION_HEADINGS}
    return F.greatest(*[F.when(b != 0, F.struct(F.length(F.bin(b)).alias("at"), F.lit(s).alias("heading"))) for s, b in bits.items()])


def _scan_offers(years: Column) -> Column:
    """The two readings of a reduced scan field, under the order its report has."""
    def offer(year: Column, left_first: str, right_first: str, comparative: bool) -> Column:
        best = F.when(years["current_is_left"], F.col(left_first)).otherwise(F.col(right_first))
        return F.struct(year.alias("fiscal_year"), best["value"].alias("value"), best["page"].alias("page"), F.lit(comparative).alias("comparative"))

    return F.array(offer(years["current"], "left", "right_or_only", False), offer(years["previous"], "right", "left_of_two", True))


VALUES = ["doc", "country", "fiscal_year", "canonical", "value", "page", "section", "method", "comparative"]


def _chosen(offers: DataFrame, as_of, weak: float, fixed_kind: str | None = None) -> DataFrame:
    """Values of the reading that suits each report with their section, and a row without field for every report and year that was read.

    ``offers`` holds the reduced rows of all readings (26 a reading at most) and rows of ``PAGE`` for each report. All steps
    are windows within a report, so its rows stay where :func:`_reduced` brought them.
    """
    report, same = Window.partitionBy("doc"), Window.partitionBy("doc", "country", "kind")
    counts = lambda kind, more=F.lit(True): F.count_if((F.col("kind") == kind) & F.col("canonical").isNotNull() & more).over(report)
    unknown = header_years(F.lit(""), as_of)
    offers = offers.select("*", F.row_number().over(same.orderBy("block")).alias("nth"), F.max("fiscal_year").over(same).alias("read_year"))
    known = offers.select(
        "*", F.max("years").over(report).alias("header"), counts(CELLS, ~F.col("comparative")).alias("n_cells"), counts(TEXT).alias("n_lines"),
        (F.sum("n_scanned").over(report) > F.sum("n_pages").over(report) * 0.5).alias("is_scanned"))
    header = F.coalesce("header", unknown)
    scanned = F.coalesce("is_scanned", F.lit(False)) if fixed_kind is None else F.lit(fixed_kind == SCAN)
    use_text = (F.col("n_cells") / F.lit(22.0) < weak) & (F.col("n_lines") > F.col("n_cells"))
    is_kind = F.col("kind")
    kind_of = "array<struct<fiscal_year:int,value:double,page:bigint,comparative:boolean>>"
    own = F.array(F.struct("fiscal_year", "left.value", "left.page", F.coalesce("comparative", F.lit(False)).alias("comparative")))
    none = F.array().cast(kind_of)

    def bare(year: Column, page: Column, comparative: Column) -> Column:
        return F.array(F.struct(year.alias("fiscal_year"), F.lit(None).cast("double").alias("value"), page.alias("page"), comparative.alias("comparative"))).cast(kind_of)

    read = bare(F.when(scanned, header["current"]).otherwise(F.col("read_year")), F.lit(None), F.lit(False))
    # A block of pages goes along, neither current nor comparative, for its headings; it stands at its last page.
    block = bare(F.lit(None), F.col("block") * HEADING_BLOCK + (HEADING_BLOCK - 1), F.lit(None))
    takes = (
        F.when(is_kind == PAGE, F.concat(F.when(F.col("nth") == 1, read).otherwise(none), F.when(F.col("block").isNotNull(), block).otherwise(none)))
        .when(F.col("canonical").isNull(), none)
        .when((is_kind == SCAN) & scanned, F.filter(_scan_offers(header), lambda o: o["value"].isNotNull()))
        .when((is_kind == TEXT) & ~scanned & use_text, own)
        .when((is_kind == CELLS) & ~scanned & (F.col("comparative") | ~use_text), own))
    taken = known.select("doc", "country", "canonical", F.col("kind").alias("method"), *fixed.SECTION_HEADINGS, F.explode(takes).alias("o")).select(
        "doc", "country", "canonical", "method", *fixed.SECTION_HEADINGS, "o.*")
    return _in_sections(taken).filter(F.col("comparative").isNotNull()).select(*VALUES)


def _in_sections(taken: DataFrame) -> DataFrame:
    """The section each row's page stands in: the last heading before it in its block of pages, else in the blocks before.

    Rows that are neither current nor comparative are the blocks. A page of a block without any page is in no known section.
    """
    is_block = F.col("comparative").isNull()
    here, before = Window.partitionBy("doc", "block"), Window.partitionBy("doc").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    rows = taken.withColumn("block", F.floor(F.col("page") / HEADING_BLOCK))
    last = F.when(is_block, _last_heading(F.col("page")))
    earlier = F.max(F.when(last.isNotNull(), F.struct(F.col("block").alias("block"), last.alias("last")))).over(before)
    rows = rows.select(
        *[c for c in rows.columns if c not in fixed.SECTION_HEADINGS], earlier["last"]["heading"].alias("earlier"), F.count_if(is_block).over(here).alias("n_blocks"),
        *[F.bit_or(F.when(is_block, F.col(s))).over(here).alias(s) for s in fixed.SECTION_HEADINGS])
    found = F.when(F.col("n_blocks") > 0, F.coalesce(_last_heading(F.col("page"))["heading"], "earlier"))
    return rows.withColumn("section", F.coalesce(F.when(F.col("block").isNotNull(), found), F.lit("unknown")))


def extract_scans(pages: DataFrame, as_of, learned: DataFrame | None = None,
                  max_pages: int | None = None) -> Extraction:
    """Fields from recognised scans: the largest amount per field, for both years.

    ``max_pages`` leaves out what follows a page, as where the later pages are ledgers.
    """
    rows = _kind_rows(pages, as_of, (SCAN,), max_pages, learned)
    chosen = _chosen(_reduced(rows, max_pages=max_pages), as_of, 0.0, SCAN)
    kept = pages if max_pages is None else pages.filter(F.col("page") <= max_pages)
    unmatched = rows.filter((F.col("kind") == SCAN) & F.col("canonical").isNull())
    return Extraction(chosen.filter("canonical IS NOT NULL"), _unmatched(unmatched, kept, recognised_text(pages)))


def _unmatched(rows: DataFrame, pages: DataFrame, text: Column | None = None) -> DataFrame:
    return _with_sections(rows.select("doc", "country", "label", F.col("a").alias("value"), "page", "line"), pages, text).withColumns(
        {"company": F.col("doc"), "pdf": F.col("doc")})


def choose_reading(cell_values: DataFrame, line_values: DataFrame, docs: DataFrame, weak: float = 0.4) -> DataFrame:
    """Per report the cell reading, or the text reading where cells cover under 40 % and text found more.

    Values of the year before always come from the cell reading. ``docs`` lists the reports. Both readings hold a
    value per field, so a report's rows are few and one window counts them.
    """
    report = Window.partitionBy("doc")
    listed = docs.select("doc").distinct()
    both = cell_values.withColumn("_text", F.lit(False)).unionByName(line_values.withColumn("_text", F.lit(True))).join(listed, "doc", "left_semi")
    count = lambda text: F.count_if((F.col("_text") == text) & ~F.col("comparative")).over(report)
    counted = both.withColumns({"_cells": count(False), "_lines": count(True)})
    use_text = (F.col("_cells") / F.lit(22.0) < weak) & (F.col("_lines") > F.col("_cells"))
    return counted.filter(F.when(F.col("_text"), use_text).otherwise(F.col("comparative") | ~use_text)).drop("_text", "_cells", "_lines")


def unmatched_counts(unmatched: DataFrame) -> DataFrame:
    """Per report how many rows, and how many different labels, could not be mapped."""
    per_label = unmatched.groupBy("doc", "label").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy("doc").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_labels"))


def read_reports(
    cells: DataFrame, pages: DataFrame, as_of, learned: DataFrame | None = None, weak: float = 0.4,
) -> Extraction:
    """Read every report the way that suits it: scans as scans, others by cells or, failing that, text.

    Pages are read once for all their readings and headings, cells once. Lines of known fields meet their report in one
    exchange; there every reading is reduced to a row per field, and windows over these few rows choose and find the sections.
    """
    text = F.coalesce(recognised_text(pages), F.col("text"))
    rows = _kind_rows(pages, as_of, (TEXT, SCAN), None, learned, text)
    known = known_cell_rows(cells, learned).withColumn("before", F.col("fiscal_year") - 1)
    in_cells = _best(known, [F.col("page"), F.col("table_no"), F.col("row_no")])
    readings = _chosen(_reduced(rows, in_cells), as_of, weak)
    # Unknown labels of a report come from all readings of its kind.
    kind = scanned_docs(pages).select("doc", "is_scanned")
    columns = ["doc", "country", "label", "value", "page", "part", "line", "is_scan"]
    from_pages = rows.filter((F.col("kind") != PAGE) & F.col("canonical").isNull()).select(
        "doc", "country", "label", F.col("a").alias("value"), "page", F.lit(0).alias("part"), "line", (F.col("kind") == SCAN).alias("is_scan"))
    from_cells = map_labels(cell_rows(cells), learned=learned).filter(F.col("canonical").isNull()).select(
        "doc", "country", "label", "value", "page", F.col("table_no").alias("part"), F.col("row_no").alias("line"), F.lit(False).alias("is_scan"))
    unknown = from_cells.unionByName(from_pages).join(kind, "doc", "left").filter(
        F.col("is_scan") == F.coalesce("is_scanned", F.lit(False))).select(*columns[:-1])
    unmatched = _with_sections(unknown, pages, text).withColumns({"company": F.col("doc"), "pdf": F.col("doc")})
    return Extraction(readings.filter("canonical IS NOT NULL"), unmatched, readings)
