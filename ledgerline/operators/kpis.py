"""Twenty ratios and growth figures per company and year.

Every ratio is a column expression; those that look back share one window, so the whole set costs one
exchange and one sort by company. A company has at most one row per fiscal year, which bounds the
window's groups. Rows must be unique on ``(ticker, fiscal_year)`` (see ``state.upsert``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.numbers import ratio, usable
from ledgerline.windows import by_year

MAX_DA_SHARE = 0.20
GROWTH_YEARS = 10


class Statement:
    """Access to statement fields of the current and earlier rows; a field the table lacks is null."""

    def __init__(self, columns):
        self._columns = set(columns)

    def __getattr__(self, field: str) -> Column:
        if field.startswith("_"):
            raise AttributeError(field)
        if field in self._columns:
            return F.col(field)
        return F.lit(None).cast("double")

    def previous(self, field: str) -> Column:
        return F.lag(getattr(self, field)).over(by_year())

    def average(self, field: str) -> Column:
        """Mean of this row and the one before; this row alone when there is none."""
        now = getattr(self, field)
        return (now + F.coalesce(self.previous(field), now)) / 2

    @property
    def depreciation(self) -> Column:
        """Size of D&A, or 0 when unknown or above a fifth of revenue (a misread figure)."""
        size = F.abs(self.depreciation_amortization)
        return F.when(ratio(size, self.revenue) <= MAX_DA_SHARE, size).otherwise(0.0)

    @property
    def operating_result(self) -> Column:
        return F.coalesce(self.operating_income, self.gross_profit)

    @property
    def ebitda(self) -> Column:
        return self.operating_result + self.depreciation

    @property
    def debt(self) -> Column:
        """Reported debt lines; without any, liabilities that are not current."""
        return F.when(
            self.long_term_debt.isNotNull() | self.short_term_debt.isNotNull(),
            F.coalesce(self.long_term_debt, F.lit(0.0)) + F.coalesce(self.short_term_debt, F.lit(0.0)),
        ).otherwise(self.total_liabilities - self.current_liabilities)


def growth(now: Column, before: Column) -> Column:
    """Relative change from the row before; infinite after a zero."""
    from_zero = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    return F.when(before == 0, from_zero).otherwise(ratio(now, before) - 1)


def annual_growth(s: Statement, field: str) -> Column:
    """Yearly growth since the farthest of the last ten calendar years with a non-zero value."""
    value = getattr(s, field)
    reach = by_year().rangeBetween(-GROWTH_YEARS, -1)
    base = F.first(
        F.when(value.isNotNull() & (value != 0), F.struct(F.col("fiscal_year").alias("y"), value.alias("v"))),
        ignorenulls=True,
    ).over(reach)
    years = (F.col("fiscal_year") - base["y"]).cast("double")
    return usable(F.pow(ratio(value, base["v"]), F.lit(1.0) / years) - 1)


def _days(amount: Column, flow: Column) -> Column:
    return ratio(amount, flow) * 365


REGISTRY: dict[str, Callable[[Statement], Column]] = {
    "revenue_growth_yoy": lambda s: growth(s.revenue, s.previous("revenue")),
    "revenue_cagr_10y": lambda s: annual_growth(s, "revenue"),
    "gross_profit_margin": lambda s: ratio(s.gross_profit, s.revenue),
    "operating_margin": lambda s: ratio(s.operating_result, s.revenue),
    "net_profit_margin": lambda s: ratio(s.net_income, s.revenue),
    "ebitda_margin": lambda s: ratio(s.ebitda, s.revenue),
    "roe": lambda s: ratio(s.net_income, s.total_equity),
    "roa": lambda s: ratio(s.net_income, s.total_assets),
    "current_ratio": lambda s: ratio(s.current_assets, s.current_liabilities),
    "quick_ratio": lambda s: ratio(
        s.cash + F.coalesce(s.short_term_investments, F.lit(0.0)) + F.coalesce(s.receivables, F.lit(0.0)),
        s.current_liabilities),
    "cash_ratio": lambda s: ratio(s.cash, s.current_liabilities),
    "working_capital": lambda s: s.current_assets - s.current_liabilities,
    "debt_to_equity": lambda s: ratio(s.total_liabilities, s.total_equity),
    "debt_to_ebitda": lambda s: ratio(s.debt, s.ebitda),
    "interest_coverage": lambda s: ratio(s.operating_income, s.interest_expense),
    "debt_to_assets": lambda s: ratio(s.debt, s.total_assets),
    "asset_turnover": lambda s: ratio(s.revenue, s.average("total_assets")),
    "inventory_turnover": lambda s: ratio(s.cogs, s.average("inventory")),
    "dso": lambda s: _days(s.average("receivables"), s.revenue),
    "cash_conversion_cycle": lambda s: (
        _days(s.average("inventory"), s.cogs)
        + _days(s.average("receivables"), s.revenue)
        - _days(s.average("accounts_payable"), s.cogs)),
}

KPIS = list(REGISTRY)


def calculate_kpis(
    financials: DataFrame,
    registry: dict[str, Callable[[Statement], Column]] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per company and year with every ratio of the registry.

    A ratio whose expression cannot be built or resolved becomes a null column; the others are not
    affected. A failure while rows are computed ends the job, so entries divide by ``ratio`` or ``try_divide``. ``keep`` names further input columns to carry along.
    """
    registry = REGISTRY if registry is None else registry
    s = Statement(financials.columns)
    out = []
    for name, build in registry.items():
        try:
            column = build(s)
            financials.select(column)
        except Exception:  # whatever one entry does, the others go on
            column = F.lit(None).cast("double")
        out.append(column.alias(name))
    return financials.select("ticker", "fiscal_year", *keep, *out)


def unpivot_kpis(kpis: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long form ``(ticker, fiscal_year, kpi, value)``."""
    names = names or [c for c in kpis.columns if c not in ("ticker", "fiscal_year")]
    return kpis.unpivot(["ticker", "fiscal_year"], names, "kpi", "value")
