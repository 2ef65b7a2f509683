"""Repairs on the financials table: gap filling, misread balance sheets and misread gross profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.schema import STATEMENT_FIELDS
from ledgerline.windows import by_year

NEAR = 0.01


def fill_gaps(financials: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Fill a null with the mean of its neighbour rows (median of at most two values).

    Neighbours are rows, not calendar years, and always original values, so the middle of a gap of
    three or more stays null while the first and last row take their only neighbour.
    """
    around = by_year().rowsBetween(-1, 1)
    fields = fields or [f for f in STATEMENT_FIELDS if f in financials.columns]
    filled = {f: F.coalesce(F.col(f), F.avg(f).over(around)) for f in fields}
    return financials.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in financials.columns])


def repair_liabilities(financials: DataFrame) -> DataFrame:
    """Liabilities equal to assets, or next to nothing (or negative), were misread: use assets - equity."""
    ta, tl, te = F.col("total_assets"), F.col("total_liabilities"), F.col("total_equity")
    known = ta.isNotNull() & tl.isNotNull() & te.isNotNull() & (ta != 0)
    wrong = (F.try_divide(F.abs(tl - ta), F.abs(ta)) < NEAR) | (F.try_divide(tl, F.abs(ta)) < NEAR)
    return financials.withColumn("total_liabilities", F.when(known & wrong, ta - te).otherwise(tl))


def drop_tiny_gross_profit(financials: DataFrame) -> DataFrame:
    """A gross profit under 0.1 % of revenue beside a plausible operating income is noise: null it and COGS."""
    rev, oi, gp = F.col("revenue"), F.col("operating_income"), F.col("gross_profit")
    noise = F.coalesce(
        (rev > 0) & (oi > 0) & (F.try_divide(F.abs(gp), rev) < 0.001) & (F.try_divide(F.abs(oi), rev) > NEAR),
        F.lit(False),
    )
    return financials.withColumns({
        "gross_profit": F.when(~noise, gp),
        "cogs": F.when(~noise, F.col("cogs")),
    })


def repair(financials: DataFrame) -> DataFrame:
    return drop_tiny_gross_profit(repair_liabilities(financials))


def field_completeness(financials: DataFrame) -> DataFrame:
    """Per company: fields with any value, fields with none, and the number of years."""
    counts = financials.groupBy("ticker").agg(
        F.count(F.lit(1)).cast("int").alias("fy_count"),
        *[F.count(f).alias(f) for f in STATEMENT_FIELDS])
    present = F.array_compact(F.array(*[F.when(F.col(f) > 0, F.lit(f)) for f in STATEMENT_FIELDS]))
    absent = F.array_compact(F.array(*[F.when(F.col(f) == 0, F.lit(f)) for f in STATEMENT_FIELDS]))
    return counts.select("ticker", "fy_count", present.alias("fields_extracted"), absent.alias("fields_missing"))


def incomplete_years(financials: DataFrame, fields: list[str]) -> DataFrame:
    """Rows lacking at least one of the fields."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return financials.filter(missing)


def missing_critical_fields(financials: DataFrame, critical: Column) -> DataFrame:
    """Per company: required fields that hold no value in any year.

    ``critical`` is an array column over ``financials``, the same in all years of a company.
    """
    present = F.array_compact(F.array(*[F.when(F.col(f"n_{f}") > 0, F.lit(f)) for f in STATEMENT_FIELDS]))
    counts = financials.withColumn("_critical", critical).groupBy("ticker").agg(
        F.first("_critical").alias("critical"), *[F.count(f).alias(f"n_{f}") for f in STATEMENT_FIELDS])
    return counts.select("ticker", F.array_except("critical", present).alias("missing_critical"))
