"""Dashboard queries over the KPI and financials tables, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import dimensions, fixed
from ledgerline.functions.numbers import delta_text, kpi_text, local_kpi_text, money_text
from ledgerline.operators.kpis import unpivot_kpis
from ledgerline.operators.state import stored_years
from ledgerline.windows import by_year


def _checked(kpis: list[str]) -> list[str]:
    if len(kpis) > fixed.MAX_KPIS:
        raise ValueError(f"at most {fixed.MAX_KPIS} KPIs can be selected")
    return kpis


def in_years(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        df = df.filter(F.col("fiscal_year") >= first)
    if last is not None:
        df = df.filter(F.col("fiscal_year") <= last)
    return df


def kpi_values(kpis: DataFrame, names: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Known values only: KPIs without any value for a company do not appear."""
    return unpivot_kpis(in_years(kpis, first, last).select("ticker", "fiscal_year", *names), names).filter(
        F.col("value").isNotNull())


def kpi_cards(kpis: DataFrame, names: list[str] | None = None, first: int | None = None, last: int | None = None,
              currency: Column | None = None) -> DataFrame:
    """Latest known value of each KPI, the known one before it, and the change relative to its size."""
    values = kpi_values(kpis, _checked(names or fixed.DEFAULT_KPIS), first, last)
    staged = values.withColumns({
        "prior": F.lag("value").over(by_year("kpi")), "later": F.lead("fiscal_year").over(by_year("kpi"))})
    cards = staged.filter(F.col("later").isNull()).select(
        "ticker", "kpi", "fiscal_year", F.col("value").alias("latest"), "prior",
        F.try_divide(F.col("value") - F.col("prior"), F.abs("prior")).alias("delta"))
    meta = dimensions.kpi_meta(kpis.sparkSession)
    text = kpi_text(F.col("latest"), F.col("style")) if currency is None else local_kpi_text(
        F.col("latest"), F.col("style"), currency)
    return cards.join(F.broadcast(meta), "kpi").select(
        "ticker", "kpi", F.col("kpi_label").alias("label"), "category", "fiscal_year", "latest", "prior", "delta",
        text.alias("latest_text"), delta_text(F.col("delta")).alias("delta_text"))


def kpi_trend(kpis: DataFrame, kpi: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A KPI by year, nulls included."""
    return in_years(kpis, first, last).select("ticker", "fiscal_year", F.col(kpi).alias("value"))


def kpi_comparison(kpis: DataFrame, kpi: str, tickers: list[str], first: int | None = None,
                   last: int | None = None) -> DataFrame:
    """One column per chosen company, one row per year."""
    chosen = kpi_trend(kpis.filter(F.col("ticker").isin(tickers)), kpi, first, last)
    return chosen.groupBy("fiscal_year").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col("value"))).alias(t) for t in tickers])


def statement_table(financials: DataFrame, currency: Column) -> DataFrame:
    """The five summary lines per year as texts in the company's currency."""
    return financials.select("ticker", "fiscal_year", *[
        money_text(F.col(f), currency).alias(f) for f, _ in fixed.SUMMARY_FIELDS])


def year_span(kpis: DataFrame) -> DataFrame:
    return kpis.groupBy("ticker").agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


def fiscal_years(financials: DataFrame) -> DataFrame:
    """Stored years of each company in ascending and descending order."""
    years = F.collect_set("fiscal_year")
    return stored_years(financials).groupBy("ticker").agg(
        F.sort_array(years).alias("ascending"), F.sort_array(years, asc=False).alias("descending"))


def kpi_sources(cards: DataFrame, extracted: DataFrame) -> DataFrame:
    """Page of the report behind each KPI, through the field it rests on.

    ``extracted`` holds one row per ``ticker, canonical`` with its ``page``.
    """
    meta = dimensions.kpi_meta(cards.sparkSession).select("kpi", "source_field")
    pages = extracted.select("ticker", F.col("canonical").alias("source_field"), F.col("page").alias("source_page"))
    return cards.join(F.broadcast(meta), "kpi").join(pages, ["ticker", "source_field"], "left")


def available_companies(meta: DataFrame, kpis: DataFrame) -> DataFrame:
    """Companies with both a record and ratios; the ``test`` country is left out."""
    return meta.filter(F.lower("country") != "test").join(
        kpis.select(F.col("ticker").alias("slug")).distinct(), "slug", "left_semi")
