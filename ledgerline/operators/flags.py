"""Warning signs: threshold rules on the latest ratios, cash-flow quality and loss streaks.

Rules are configuration of fixed size, so they are turned into column expressions. Testing them is then
a map over the latest row of each company, with no join and no exchange of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline import fixed
from ledgerline.operators import company
from ledgerline.schema import struct


FLAG = struct(
    "flag_id string, name string, description string, severity string, kpi string, kpi_value double, "
    "threshold map<string,double>, rank int, ord int"
)


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(fixed.SEVERITIES))
    for rank, name in reversed(list(enumerate(fixed.SEVERITIES))):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def in_band(value: Column, band: dict[str, float]) -> Column:
    """All bounds of the band hold."""
    tests = {
        "gt": lambda t: value > t, "lt": lambda t: value < t,
        "gte": lambda t: value >= t, "lte": lambda t: value <= t,
    }
    out = F.lit(True)
    for bound, limit in band.items():
        out = out & tests[bound](F.lit(float(limit)))
    return out


def _rule_flag(rule: dict, ord_: int, values: Column, known: set[str]) -> Column:
    """The finding of one rule, or null. The severest band that holds decides."""
    value = values[rule["kpi"]] if rule["kpi"] in known else F.lit(None).cast("double")
    out = F.lit(None).cast(FLAG)
    for rank, severity in reversed(list(enumerate(fixed.SEVERITIES))):
        band = rule.get(severity)
        if not band:
            continue
        bounds = F.create_map(*[F.lit(x) for k, v in band.items() for x in (k, float(v))])
        found = F.struct(
            F.lit(rule["id"]), F.lit(rule["name"]), F.lit(rule["description"]), F.lit(severity),
            F.lit(rule["kpi"]), value, bounds, F.lit(rank), F.lit(ord_),
        ).cast(FLAG)
        out = F.when(in_band(value, band), found).otherwise(out)
    return out


# --- findings as columns of a company's state ---------------------------------------------------------

def _dated(flag: Column, year: Column) -> Column:
    return F.when(flag.isNotNull(), F.struct(year.cast("int").alias("fiscal_year"), flag.alias("f")))


def _threshold_findings(companies: DataFrame, rules: dict, sector: Column | None) -> Column:
    """Rules tested on the latest ratios; companies of an unknown sector take the default rules."""
    known = set(companies.schema["k"].dataType.names)
    nothing = F.array().cast(T.ArrayType(FLAG))
    default = rules.get("default_sector", "healthcare")
    found = {
        name: F.array(*[_rule_flag(r, i, F.col("k"), known) for i, r in enumerate(specs)]) if specs else nothing
        for name, specs in rules.get("sectors", {}).items()
    }
    out = found.get(default, nothing)
    if sector is not None:
        for name, flags in found.items():
            if name != default:
                out = F.when(sector == name, flags).otherwise(out)
    return F.transform(F.coalesce(out, nothing), lambda f: _dated(f, F.col("k_year")))


def _cash_flow_finding() -> Column:
    """Profit with negative operating cash flow in the latest year."""
    ocf, net = F.col("f")["operating_cash_flow"], F.col("f")["net_income"]
    flag = F.struct(
        F.lit(fixed.CASH_FLOW_FLAG["id"]), F.lit(fixed.CASH_FLOW_FLAG["name"]),
        F.lit(fixed.CASH_FLOW_FLAG["description"]), F.lit("Alta"), F.lit(None), F.lit(None),
        F.create_map(F.lit("operating_cash_flow"), ocf, F.lit("net_income"), net), F.lit(0), F.lit(1000),
    ).cast(FLAG)
    return _dated(F.when((ocf < 0) & (net > 0), flag), F.col("f_year"))


def _loss_finding() -> Column:
    run = F.col("losses")["longest_run"]
    many = run >= 2
    flag = F.struct(
        F.lit(fixed.LOSS_FLAG["id"]), F.lit(fixed.LOSS_FLAG["name"]),
        F.when(many, F.format_string(fixed.LOSS_FLAG["many"], run)).otherwise(fixed.LOSS_FLAG["one"]),
        F.when(many, "Alta").otherwise("Media"), F.lit("net_profit_margin"), F.lit(None),
        F.create_map(F.lit("consecutive_loss_years"), run.cast("double")),
        F.when(many, 0).otherwise(1), F.lit(1001),
    ).cast(FLAG)
    return _dated(F.when(run.isNotNull(), flag), F.col("losses")["last_loss_year"])


def _rows(companies: DataFrame, findings: Column) -> DataFrame:
    return (
        companies.select("ticker", F.explode(F.array_compact(findings)).alias("d"))
        .select("ticker", "d.f.flag_id", "d.f.name", "d.f.description", "d.f.severity", "d.f.kpi", "d.f.kpi_value",
                "d.fiscal_year", "d.f.threshold", "d.f.rank", "d.f.ord")
    )


def of_companies(companies: DataFrame, rules: dict | None = None, sector: Column | None = None) -> DataFrame:
    """All findings of companies whose state is known (``company``): a map, without join or exchange."""
    rules = fixed.RULES if rules is None else rules
    findings = _threshold_findings(companies, rules, sector)
    if rules:
        findings = F.concat(findings, F.array(_cash_flow_finding(), _loss_finding()))
    return _rows(companies, findings)


def threshold_flags(kpis: DataFrame, rules: dict | None = None, sector: Column | None = None) -> DataFrame:
    """The findings of the rules alone."""
    companies = company.of_kpis(kpis)
    return _rows(companies, _threshold_findings(companies, fixed.RULES if rules is None else rules, sector))


def cash_flow_flags(financials: DataFrame) -> DataFrame:
    """The cash-flow findings alone."""
    return _rows(company.of_tables(financials.limit(0).select("ticker", "fiscal_year"), financials), F.array(_cash_flow_finding()))


def loss_flags(kpis: DataFrame) -> DataFrame:
    """The findings on loss years alone."""
    return _rows(company.of_kpis(kpis), F.array(_loss_finding()))


def loss_streaks(kpis: DataFrame) -> DataFrame:
    """Per company with any loss: longest run of negative net margins and the last loss year.

    Years without a margin are left out and do not end a run.
    """
    return company.of_kpis(kpis).filter("losses IS NOT NULL").select("ticker", "losses.*")


def evaluate_flags(
    kpis: DataFrame, financials: DataFrame, rules: dict | None = None, sector: Column | None = None,
) -> DataFrame:
    """All findings from stored ratios and statements. Sort by ``(ticker, rank, ord)`` to list the severest first."""
    return of_companies(company.of_tables(kpis, financials), rules, sector)


def in_order(flags: DataFrame) -> DataFrame:
    return flags.orderBy("ticker", "rank", "ord")


def checklist_of(companies: DataFrame, rules: dict | None = None) -> DataFrame:
    """Every rule of the default sector for every company with its severity, or ``OK``: a map over the companies' states."""
    rules = fixed.RULES if rules is None else rules
    known = set(companies.schema["k"].dataType.names)
    entries = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(r["id"]).alias("flag_id"), F.lit(r["name"]).alias("name"), F.lit(r["description"]).alias("description"),
                 F.coalesce(_rule_flag(r, i, F.col("k"), known)["severity"], F.lit("OK")).alias("severity"))
        for i, r in enumerate(rules["sectors"][rules["default_sector"]])])
    return companies.select("ticker", F.explode(entries).alias("e")).select("ticker", "e.*")


def rule_checklist(companies: DataFrame, flags: DataFrame, rules: dict | None = None,
                   sector: str | None = None) -> DataFrame:
    """Every rule for every company with its severity, or ``OK``."""
    rules = fixed.RULES if rules is None else rules
    specs = rules["sectors"][sector or rules["default_sector"]]
    catalogue = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(r["id"]).alias("flag_id"), F.lit(r["name"]).alias("name"),
                 F.lit(r["description"]).alias("description")) for i, r in enumerate(specs)]))
    listed = companies.select("ticker", catalogue.alias("r")).select("ticker", "r.*")
    return listed.join(flags.select("ticker", "flag_id", "severity"), ["ticker", "flag_id"], "left").select(
        "ticker", "ord", "flag_id", "name", "description", F.coalesce("severity", F.lit("OK")).alias("severity"))
