"""What is judged about a company, from one pass over its years.

All years of a company are gathered once, sorted, and folded into one row: its latest ratios and statement, its loss
years, its growth and the last two values of its cash cycle. Rules, credit position and scenarios then are maps over
that row. A company has one row a year, so its array is as long as its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.kpis import KPIS, calculate_kpis
from ledgerline.schema import STATEMENT_FIELDS

#: Ratios that are folded over the years.
FOLDED = ["net_profit_margin", "revenue_growth_yoy", "cash_conversion_cycle", "revenue_cagr_10y", "ebitda_margin"]


def _struct(df: DataFrame, fields: list[str]) -> Column:
    """A struct of the fields; those the table lacks are null."""
    return F.struct(*[(F.col(f) if f in df.columns else F.lit(None)).cast("double").alias(f) for f in fields])


def of_financials(financials: DataFrame) -> DataFrame:
    """The state of every company from its statements; ratios are computed on the way, in the same exchange."""
    rows = calculate_kpis(financials, keep=tuple(f for f in STATEMENT_FIELDS if f in financials.columns))
    return _folded(rows.select("ticker", "fiscal_year", _struct(rows, KPIS).alias("k"), _struct(rows, STATEMENT_FIELDS).alias("f")))


def of_tables(kpis: DataFrame, financials: DataFrame) -> DataFrame:
    """The same from stored ratios and statements, whose years may differ."""
    named = [c for c in kpis.columns if c not in ("ticker", "fiscal_year")]
    ratios = kpis.select("ticker", "fiscal_year", _struct(kpis, list(dict.fromkeys([*named, *KPIS]))).alias("k"))
    statements = financials.select("ticker", "fiscal_year", _struct(financials, STATEMENT_FIELDS).alias("f"))
    return _folded(ratios.unionByName(statements, allowMissingColumns=True))


def of_kpis(kpis: DataFrame) -> DataFrame:
    """The same from stored ratios alone."""
    return of_tables(kpis, kpis.limit(0).select("ticker", "fiscal_year"))


def _folded(rows: DataFrame) -> DataFrame:
    """``ticker, k, k_year, f, f_year, years, losses, growth, cycles``: one row per company.

    ``years`` are the sorted years with the folded ratios, ``losses`` the longest run and the last year of losses, ``growth`` the
    sum and number of growth figures, ``cycles`` the last two known cash cycles.
    """
    gathered = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", "k", "f"))).alias("rows"))
    last = lambda part: F.try_element_at(F.filter("rows", lambda r: r[part].isNotNull()), F.lit(-1))
    years = F.transform(F.filter("rows", lambda r: r["k"].isNotNull()), lambda r: F.struct(
        r["fiscal_year"].cast("int").alias("fiscal_year"), *[r["k"][f].alias(f) for f in FOLDED]))
    found = gathered.select("ticker", last("k").alias("lk"), last("f").alias("lf"), years.alias("years"))
    return found.select("ticker", "lk.k", F.col("lk.fiscal_year").alias("k_year"), "lf.f", F.col("lf.fiscal_year").alias("f_year"), "years", _fold().alias("s")).select(
        "ticker", "k", "k_year", "f", "f_year", "years", "s.*")


def _fold() -> Column:
    """One walk over the years. A margin ends or goes on with a run of losses; years without one are passed over."""
    no_year, no_value = F.lit(None).cast("int"), F.lit(None).cast("double")

    def state(run: Column, longest: Column, last: Column, total: Column, n: Column, before: Column, now: Column) -> Column:
        return F.struct(run.alias("run"), longest.alias("longest"), last.alias("last"), total.alias("total"), n.alias("n"), before.alias("before"), now.alias("now"))

    def step(s: Column, y: Column) -> Column:
        margin, growth, cycle = y["net_profit_margin"], y["revenue_growth_yoy"], y["cash_conversion_cycle"]
        loss = F.coalesce(margin < 0, F.lit(False))
        run = F.when(margin.isNull(), s["run"]).when(loss, s["run"] + 1).otherwise(0)
        return state(
            run, F.greatest(s["longest"], run), F.when(loss, y["fiscal_year"]).otherwise(s["last"]),
            F.when(growth.isNull(), s["total"]).otherwise(s["total"] + growth), F.when(growth.isNull(), s["n"]).otherwise(s["n"] + 1),
            F.when(cycle.isNull(), s["before"]).otherwise(s["now"]), F.coalesce(cycle, s["now"]))

    def done(s: Column) -> Column:
        return F.struct(
            F.when(s["longest"] > 0, F.struct(s["longest"].alias("longest_run"), s["last"].alias("last_loss_year"))).alias("losses"),
            F.struct(s["total"].alias("total"), s["n"].alias("n")).alias("growth"),
            F.struct(s["before"].alias("before"), s["now"].alias("now")).alias("cycles"))

    return F.aggregate("years", state(F.lit(0), F.lit(0), no_year, F.lit(0.0), F.lit(0), no_value, no_value), step, done)
