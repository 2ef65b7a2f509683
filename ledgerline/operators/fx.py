"""Exchange rates: annual means, lookup and quality marks. Stored amounts stay in their own currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import fixed


def annual_rates(daily: DataFrame) -> DataFrame:
    """Mean of daily rates ``(currency, day, rate)`` per calendar year."""
    return daily.groupBy("currency", F.year("day").alias("year")).agg(
        F.avg("rate").alias("rate")).withColumn("approximated", F.lit(False))


def merge_rates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add rates for years not stored yet; stored ones stay."""
    return stored.unionByName(new.join(stored.select("currency", "year"), ["currency", "year"], "left_anti"))


def currency_of(country: Column) -> Column:
    out = F.lit("USD")
    for code, currency in fixed.COUNTRY_CURRENCY.items():
        out = F.when(country == code, currency).otherwise(out)
    return out


def is_low_confidence(currency: Column) -> Column:
    return currency.isin(fixed.LOW_CONFIDENCE_CURRENCIES)


def is_approximated(currency: Column, rate_approximated: Column | None = None) -> Column:
    """The rate is a spot rate: always outside the averaged currencies, and where marked so."""
    base = (currency != "USD") & ~currency.isin(fixed.AVERAGED_CURRENCIES)
    return base if rate_approximated is None else base | F.coalesce(rate_approximated, F.lit(False))


def to_usd(df: DataFrame, rates: DataFrame, amount: str = "amount", currency: str = "currency",
           year: str = "fiscal_year") -> DataFrame:
    """Add ``rate`` and ``usd``. USD amounts stay as they are; without a rate ``usd`` is null.

    A currency and year has one rate (of several the smallest), so no amount is multiplied. Rates carry no broadcast hint:
    Spark checks their size, and joins by exchange beyond its limit.
    """
    r = rates.groupBy(F.col("currency").alias("_currency"), F.col("year").alias("_year")).agg(F.min("rate").alias("rate"))
    own = F.col(currency) == "USD"
    return (
        df.join(r, (F.col(currency) == F.col("_currency")) & (F.col(year) == F.col("_year")) & ~own, "left")
        .withColumn("usd", F.when(own, F.col(amount)).otherwise(F.col(amount) * F.col("rate")))
        .drop("_currency", "_year")
    )
