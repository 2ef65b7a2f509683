"""Regulator facts to raw financials.

Exchanges: one on ``(ticker, tag, end)`` for the latest filing of each period, with partial aggregation
first so that a hot company or tag is reduced before it moves; then one on ``ticker``, when a company
holds at most one row per tag and period end. Every later step, KPIs included, reuses the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline import dimensions, fixed
from ledgerline.functions.years import whole_year
from ledgerline.schema import PERIOD_FIELDS, STATEMENT_FIELDS


def annual_facts(facts: DataFrame) -> DataFrame:
    """Facts that can fill a statement field, with ``field`` and tag ``priority``.

    Only amounts in USD from annual filings count. Period fields must also cover a fiscal year of more
    than 300 days.
    """
    tags = dimensions.field_tags(facts.sparkSession)
    names = [t for group in fixed.FIELD_TAGS.values() for t in group]
    annual = facts.filter((F.col("unit") == "USD") & (F.col("form") == "10-K") & F.col("tag").isin(names))
    joined = annual.join(F.broadcast(tags), "tag")
    over_year = (F.col("fp") == "FY") & whole_year(F.col("start"), F.col("end"))
    return joined.filter(
        F.col("end").isNotNull() & F.col("val").isNotNull()
        & (~F.col("field").isin(PERIOD_FIELDS) | F.coalesce(over_year, F.lit(False))))


def latest_by_period(facts: DataFrame) -> DataFrame:
    """One value per company, tag and period end: the last filed; the first listed on equal dates."""
    newest_first = F.struct((-F.unix_date("filed")).alias("f"), F.col("pos").alias("p"))
    return facts.groupBy("ticker", "field", "priority", "tag", "end").agg(
        F.min_by("val", newest_first).alias("val"), F.min("pos").alias("first_pos"))


def latest_by_year(periods: DataFrame) -> DataFrame:
    """One value per company, tag and calendar year of the period end.

    With two period ends in one year (52/53-week years) the one listed later wins.
    """
    return periods.groupBy("ticker", "field", "priority", F.year("end").alias("fiscal_year")).agg(
        F.max_by("val", "first_pos").alias("val"))


def preferred_tag(series: DataFrame) -> DataFrame:
    """Keep, per company and field, the whole series of the most preferred tag that has any value."""
    best = F.min("priority").over(Window.partitionBy("ticker", "field"))
    return series.withColumn("best", best).filter("priority = best").drop("best", "priority")


def widen(series: DataFrame) -> DataFrame:
    """Long ``(ticker, fiscal_year, field, val)`` to one row per year with all statement fields."""
    return series.groupBy("ticker", "fiscal_year").agg(*[
        F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in STATEMENT_FIELDS])


def field_series(facts: DataFrame) -> DataFrame:
    """Long form of the raw financials: one value per company, field and fiscal year."""
    return preferred_tag(latest_by_year(latest_by_period(annual_facts(facts)).repartition("ticker")))


def raw_financials(facts: DataFrame) -> DataFrame:
    return widen(field_series(facts))


def companies_without_data(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies of which no field could be filled, with the reason."""
    usable = annual_facts(facts).select("ticker").distinct()
    return companies.select("ticker").join(usable, "ticker", "left_anti").withColumn(
        "error_message", F.concat(F.col("ticker"), F.lit(": no statement field could be filled")))


def profile(facts: DataFrame, companies: DataFrame) -> DataFrame:
    """Fiscal years of annual filings over all tags and units, with a reason when there are none.

    The filing's own ``fy`` is used here.
    """
    annual = (F.col("form") == "10-K") & (F.col("fp") == "FY") & F.col("fy").isNotNull()
    # The years of a company are few, so one aggregation over the facts finds both.
    seen = facts.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_facts"), F.collect_set(F.when(annual, F.col("fy"))).alias("fys")).select(
        "ticker", "n_facts", F.when(F.size("fys") > 0, F.size("fys")).alias("fy_count"),
        F.array_min("fys").alias("earliest_fy"), F.array_max("fys").alias("latest_fy"))
    found = F.col("fy_count").isNotNull()
    reason: Column = F.when(found, None).when(F.col("n_facts").isNull(), "no facts found").otherwise(
        "no annual filing entries")
    return (
        companies.select("ticker").join(seen, "ticker", "left")
        .select("ticker", found.alias("ok"), F.coalesce("fy_count", F.lit(0)).alias("fy_count"),
                "earliest_fy", "latest_fy", reason.alias("reason"))
    )


def resolve_ids(tickers: DataFrame, ids: DataFrame) -> DataFrame:
    """Regulator id of each ticker: exact, else with ``.`` and ``-`` exchanged. Unknown ones get an error.

    ``ids`` is ``(ticker, cik)`` with upper-case tickers; Spark broadcasts it only while it is small.
    """
    name = F.upper("ticker")
    other = F.when(F.instr(name, ".") > 0, F.translate(name, ".", "-")).otherwise(F.translate(name, "-", "."))
    a = ids.select(F.col("ticker").alias("_name"), F.col("cik").alias("_cik1"))
    b = ids.select(F.col("ticker").alias("_other"), F.col("cik").alias("_cik2"))
    cik = F.coalesce("_cik1", "_cik2")
    return (
        tickers.join(a, name == F.col("_name"), "left").join(b, other == F.col("_other"), "left")
        .select(*[tickers[c] for c in tickers.columns], cik.alias("cik"),
                F.when(cik.isNull(), F.concat(F.lit("unknown ticker "), name)).alias("error"))
    )
