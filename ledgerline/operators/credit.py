"""Credit and receivables-financing position of each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import billions, clamp, rounded
from ledgerline.operators import company


def dso_zone(dso: Column) -> Column:
    a, b, c, d = fixed.DSO_ZONES
    return F.when(dso.isNull(), "N/D").when(dso < 90, a).when(dso <= 120, b).when(dso <= 210, c).otherwise(d)


def debt_zone(x: Column) -> Column:
    a, b, c = fixed.DEBT_ZONES
    return F.when(x.isNull(), "N/D").when(x < 3.5, a).when(x < 5, b).otherwise(c)


def financing_rating(dso: Column, debt_ebitda: Column, margin: Column) -> Column:
    """Null when nothing applies or DSO or debt/EBITDA is unknown."""
    firm = F.when(
        margin.isNotNull() & debt_ebitda.isNotNull() & dso.isNotNull(),
        F.when((dso > 150) & (debt_ebitda < 3.5) & (margin > 0.08), fixed.RATINGS["priority"])
        .when((dso > 150) & ((debt_ebitda > 5) | (margin < 0.05)), fixed.RATINGS["restricted"])
        .when((debt_ebitda > 5) & (margin <= 0), fixed.RATINGS["rejected"]),
    )
    middling = dso.between(120, 150) | ((debt_ebitda >= 3.5) & (debt_ebitda < 5))
    known = dso.isNotNull() & debt_ebitda.isNotNull()
    return F.coalesce(firm, F.when(known & middling, fixed.RATINGS["moderate"]))


def trend(delta: Column) -> Column:
    return F.when(delta.isNull(), "N/D").when(F.abs(delta) < 5, "estable").when(delta > 0, "creciente").otherwise(
        "decreciente")


def mean_growth() -> Column:
    """Mean yearly revenue growth within [-10 %, 40 %]; 10 % when there is none."""
    mean = F.try_divide(F.col("growth")["total"], F.col("growth")["n"].cast("double"))
    bounded = F.when(F.isnan(mean), -0.10).otherwise(clamp(mean, -0.10, 0.40))
    return F.when(mean.isNull(), 0.10).otherwise(bounded)


def of_companies(companies: DataFrame) -> DataFrame:
    """One row per company whose ratios and statement are known; a map over its state (``company``)."""
    zero = F.lit(0.0)
    k, f = F.col("k"), F.col("f")
    both = companies.filter(k.isNotNull() & f.isNotNull()).select(
        "ticker", *[k[c].alias(c) for c in ("dso", "cash_conversion_cycle", "current_ratio", "debt_to_ebitda", "debt_to_equity", "ebitda_margin")],
        F.coalesce(f["revenue"], zero).alias("revenue"), F.coalesce(f["receivables"], zero).alias("receivables"),
        (F.coalesce(f["long_term_debt"], zero) + F.coalesce(f["short_term_debt"], zero) - F.coalesce(f["cash"], zero)).alias("net_debt"),
        mean_growth().alias("avg_growth"), (F.col("cycles")["now"] - F.col("cycles")["before"]).alias("delta"))
    dso, debt, margin = F.col("dso"), F.col("debt_to_ebitda"), F.col("ebitda_margin")
    revenue, receivables = F.col("revenue"), F.col("receivables")
    projected = F.when(dso.isNotNull() & (revenue > 0), revenue * (1 + F.col("avg_growth")))

    def bn(c: Column) -> Column:
        return billions(c, 1)

    return both.select(
        "ticker",
        rounded(dso, 1).alias("dso_days"),
        dso_zone(dso).alias("dso_zone"),
        rounded(F.col("cash_conversion_cycle"), 1).alias("ccc_days"),
        trend(F.col("delta")).alias("ccc_trend"),
        rounded(F.col("current_ratio"), 2).alias("current_ratio"),
        bn(revenue).alias("revenue_mmm"),
        bn(receivables).alias("receivables_mmm"),
        rounded(F.col("avg_growth") * 100, 1).alias("avg_growth_pct"),
        bn(projected).alias("projected_revenue_mmm"),
        bn(dso / 365 * projected - receivables).alias("wc_gap_mmm"),
        bn(F.when(receivables > 0, receivables * 0.70)).alias("factoring_eligible_mmm"),
        rounded(debt, 2).alias("debt_ebitda"),
        debt_zone(debt).alias("debt_ebitda_zone"),
        rounded(F.col("debt_to_equity"), 2).alias("debt_equity"),
        bn(F.col("net_debt")).alias("net_debt_mmm"),
        rounded(margin * 100, 1).alias("ebitda_margin_pct"),
        financing_rating(dso, debt, margin).alias("factoring_rating"),
    )


def credit_context(kpis: DataFrame, financials: DataFrame) -> DataFrame:
    """The same from stored ratios and statements."""
    return of_companies(company.of_tables(kpis, financials))


def scenarios_of(companies: DataFrame) -> DataFrame:
    """Best, worst and mean year of each company's history of at least two years.

    The measure is the ten-year growth where the latest year has it, else the EBITDA margin. The first
    year wins ties.
    """
    growth = F.col("k")["revenue_cagr_10y"].isNotNull()
    values = F.transform("years", lambda y: F.struct(
        F.when(growth, y["revenue_cagr_10y"]).otherwise(y["ebitda_margin"]).alias("v"), y["fiscal_year"].alias("year")))
    rows = companies.filter(F.size("years") >= 2).select(
        "ticker", F.when(growth, "revenue_cagr_10y").otherwise("ebitda_margin").alias("metric"),
        F.filter(values, lambda x: x["v"].isNotNull()).alias("known")).filter(F.size("known") > 0)
    best = F.array_max(F.transform("known", lambda x: F.struct(x["v"].alias("v"), (-x["year"]).alias("y"))))
    worst = F.array_min("known")
    total = F.aggregate("known", F.lit(0.0), lambda s, x: s + x["v"])
    return rows.select("ticker", "metric", (-best["y"]).alias("best_year"), best["v"].alias("best"), worst["year"].alias("worst_year"),
                       worst["v"].alias("worst"), (total / F.size("known")).alias("mean"))


def scenarios(kpis: DataFrame) -> DataFrame:
    """The same from stored ratios."""
    return scenarios_of(company.of_kpis(kpis))
