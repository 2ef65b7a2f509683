"""The two ways a company enters the tables, and the jobs around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import usable
from ledgerline.operators import cleaning, company, facts as facts_ops, flags as flag_ops, kpis as kpi_ops, state, statements
from ledgerline.schema import STATEMENT_FIELDS, conform_financials

REPORTED_KPIS = ["current_ratio", "dso", "dpo"]


@dataclass
class Result:
    financials: DataFrame
    kpis: DataFrame
    errors: DataFrame | None = None


def from_facts(facts: DataFrame, companies: DataFrame) -> Result:
    """Regulator facts of all companies to financials and ratios; unusable companies become error rows."""
    financials = cleaning.fill_gaps(conform_financials(facts_ops.raw_financials(facts)))
    return Result(financials, kpi_ops.calculate_kpis(financials), facts_ops.companies_without_data(facts, companies))


def _with_report(extracted: DataFrame) -> DataFrame:
    """Values with the place of their report: ``report_order``, then ``doc``; without these columns all are one report."""
    order = F.col("report_order") if "report_order" in extracted.columns else F.lit(0)
    doc = F.col("doc") if "doc" in extracted.columns else F.lit("")
    return extracted.withColumn("_report", F.struct(order.cast("bigint").alias("report_order"), doc.alias("doc")))


def rows_from_extracted(extracted: DataFrame) -> DataFrame:
    """Long values ``ticker, fiscal_year, canonical, value`` to one row per year, all statement fields present.

    With ``report_order`` and ``doc`` a company may have several reports: the whole row of a year comes from the last
    report that gives it, fields it lacks stay null. A row without ``canonical`` says that a report gave the year. One
    aggregation finds each field's last report and the year's; a field stays where the two are one.
    Fields that are not statement fields (such as reported ratios) are left out.
    """
    rows = _with_report(extracted)
    at, value = F.col("_report"), F.col("value")
    last = rows.groupBy("ticker", "fiscal_year").agg(F.max(at).alias("_at"), *[
        F.max(F.when((F.col("canonical") == f) & value.isNotNull(), F.struct(at.alias("at"), value.alias("value")))).alias(f) for f in STATEMENT_FIELDS])
    return conform_financials(last.select("ticker", "fiscal_year", *[
        F.when(F.col(f)["at"] == F.col("_at"), F.col(f)["value"]).alias(f) for f in STATEMENT_FIELDS]))


def override_kpis(kpis: DataFrame, extracted: DataFrame) -> DataFrame:
    """Take a ratio printed in a report where it could not be computed; of several reports the first that prints it."""
    names = [k for k in REPORTED_KPIS if k in kpis.columns]
    rows = _with_report(extracted).filter(F.col("canonical").isin(names) & F.col("value").isNotNull())
    printed = rows.groupBy("ticker", "fiscal_year").agg(*[
        F.min(F.when(F.col("canonical") == k, F.struct("_report", "value"))).alias(f"_{k}") for k in names])
    joined = kpis.join(printed, ["ticker", "fiscal_year"], "left")
    return joined.select(*[
        F.coalesce(c, F.col(f"_{c}")["value"]).alias(c) if c in names else F.col(c) for c in kpis.columns])


def from_reports(existing: DataFrame, extracted: DataFrame) -> Result:
    """Values read off reports into the stored financials: replace years, repair, compute, fill in printed ratios."""
    new = rows_from_extracted(extracted)
    merged = state.upsert(conform_financials(existing), new, ["ticker", "fiscal_year"])
    financials = cleaning.repair(merged)
    return Result(financials, override_kpis(kpi_ops.calculate_kpis(financials), extracted))


def recompute(financials: DataFrame, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Ratios and findings from stored financials, for companies that need no new data."""
    return kpi_ops.calculate_kpis(financials), flag_ops.of_companies(company.of_financials(financials), rules)


def confirm_corrections(existing: DataFrame, corrections: DataFrame, kept: DataFrame | None = None) -> Result:
    """Corrected reports into the stored financials; reports with an unedited doubtful field are held back.

    ``kept`` holds further values read for the report that the form does not show.
    """
    values = state.corrected_values(state.confirmable(corrections))
    if kept is not None:
        shown = list(fixed.DISPLAY_NAMES)
        reports = values.select("ticker", "fiscal_year").distinct()
        values = values.unionByName(
            kept.filter(~F.col("canonical").isin(shown)).join(reports, ["ticker", "fiscal_year"], "left_semi"))
    return from_reports(existing, values)


def reports_to_financials(existing: DataFrame, cells: DataFrame, pages: DataFrame, as_of,
                          learned: DataFrame | None = None, reports: DataFrame | None = None) -> tuple[Result, statements.Extraction]:
    """From report contents to stored financials.

    ``reports`` says whose each document is and in which order they count: ``doc, ticker, report_order``. Without it the
    document key is the company key. A later report replaces the whole row of every year it gives.
    """
    found = statements.read_reports(cells, pages, as_of, learned)
    values = found.readings.select("doc", "fiscal_year", "canonical", usable(F.col("value")).alias("value"))
    if reports is None:
        extracted = values.withColumn("ticker", F.col("doc"))
    else:
        extracted = values.join(reports.select("doc", "ticker", "report_order"), "doc")
    return from_reports(existing, extracted.filter(F.col("fiscal_year").isNotNull())), found


def run_log(financials: DataFrame, errors: DataFrame, scraped: bool) -> DataFrame:
    """One row per processed company for ``state.merge_run_metadata``."""
    done = cleaning.field_completeness(financials).select(
        "ticker", F.lit(scraped).alias("scraped"), F.lit("success").alias("status"), "fy_count",
        F.lit(None).cast("string").alias("error_message"), "fields_missing")
    failed = errors.select(
        "ticker", F.lit(scraped).alias("scraped"), F.lit("error").alias("status"), F.lit(0).alias("fy_count"),
        "error_message", F.lit(None).cast("array<string>").alias("fields_missing"))
    return done.unionByName(failed)


