import random

import pytest
from pyspark.sql import functions as F

from ledgerline import fixed, schema
from ledgerline.operators import cleaning, company, credit, flags, kpis, views
from ledgerline.schema import FINANCIALS, STATEMENT_FIELDS, conform_financials


def fin(spark, rows):
    names = sorted({k for r in rows for k in r} - {"ticker", "fiscal_year"})
    ddl = "ticker string, fiscal_year int" + "".join(f", {n} double" for n in names)
    data = [(r.get("ticker", "A"), r["fiscal_year"], *[float(r[n]) if r.get(n) is not None else None for n in names]) for r in rows]
    return conform_financials(spark.createDataFrame(data, ddl))


def by_year(df, column):
    return {r["fiscal_year"]: r[column] for r in df.select("fiscal_year", column).collect()}


def test_registry_has_twenty_kpis_and_schema(spark):
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2023, "revenue": 100e9, "gross_profit": 40e9, "net_income": 20e9},
                                          {"fiscal_year": 2024, "revenue": 110e9, "gross_profit": 44e9, "net_income": 22e9}]))
    assert len(kpis.KPIS) == 20 and out.columns == ["ticker", "fiscal_year", *kpis.KPIS]
    assert by_year(out, "gross_profit_margin")[2024] == pytest.approx(0.4)
    assert by_year(out, "net_profit_margin")[2024] == pytest.approx(0.2)
    assert by_year(out, "revenue_growth_yoy") == {2023: None, 2024: pytest.approx(0.1)}
    assert FINANCIALS.fieldNames() == ["ticker", "fiscal_year", *STATEMENT_FIELDS]


def test_failing_kpi_is_isolated(spark):
    def broken(s):
        raise ValueError("no such ratio")

    registry = {**kpis.REGISTRY, "broken": broken, "unresolved": lambda s: F.col("nowhere") * 2}
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2024, "revenue": 10.0, "net_income": 2.0}]), registry).first()
    assert out["broken"] is None and out["unresolved"] is None and out["net_profit_margin"] == 0.2


def test_growth_after_zero_and_missing(spark):
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": y, "revenue": v} for y, v in
                                          [(2018, 0.0), (2019, 5.0), (2020, 0.0), (2021, 0.0), (2022, None), (2023, 4.0), (2024, -2.0)]]))
    assert by_year(out, "revenue_growth_yoy") == {
        2018: None, 2019: float("inf"), 2020: -1.0, 2021: None, 2022: None, 2023: None, 2024: -1.5}


def test_cagr_uses_farthest_year_within_ten(spark):
    values = {2009: 1.0, 2010: 100.0, 2012: None, 2013: 0.0, 2020: 200.0}
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": y, "revenue": v} for y, v in values.items()]))
    got = by_year(out, "revenue_cagr_10y")
    assert got[2020] == pytest.approx(2 ** 0.1 - 1) and got[2012] is None and got[2010] == pytest.approx(99.0)
    neg = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2022, "revenue": 10.0}, {"fiscal_year": 2023, "revenue": 5.0},
                                          {"fiscal_year": 2024, "revenue": -5.0}]))
    assert by_year(neg, "revenue_cagr_10y")[2024] is None


def test_cagr_random_against_loop(spark):
    rng = random.Random(3)
    rows = [{"ticker": t, "fiscal_year": y, "revenue": rng.choice([None, 0.0, 5.0, 8.0, -3.0, rng.random() * 100])}
            for t in "ABCDEFGH" for y in range(2000, 2025) if rng.random() < 0.7]
    stored = {(r["ticker"], r["fiscal_year"]): r["revenue"] for r in rows}
    for r in kpis.calculate_kpis(fin(spark, rows)).select("ticker", "fiscal_year", "revenue_cagr_10y").collect():
        now, want = stored[r["ticker"], r["fiscal_year"]], None
        for back in range(10, 0, -1):
            base = stored.get((r["ticker"], r["fiscal_year"] - back))
            if now is not None and base:
                power = (now / base) ** (1 / back)
                want = None if isinstance(power, complex) else power - 1
                break
        assert r["revenue_cagr_10y"] == (want if want is None else pytest.approx(want))


def test_leverage_and_ebitda_guards(spark):
    out = kpis.calculate_kpis(fin(spark, [
        {"ticker": "neg", "fiscal_year": 2024, "revenue": 100, "operating_income": 10, "depreciation_amortization": -5},
        {"ticker": "big", "fiscal_year": 2024, "revenue": 100, "operating_income": 10, "depreciation_amortization": 25},
        {"ticker": "gp", "fiscal_year": 2024, "revenue": 100, "gross_profit": 30, "total_liabilities": 90, "current_liabilities": 30},
        {"ticker": "debt", "fiscal_year": 2024, "revenue": 100, "operating_income": 10, "short_term_debt": 20},
    ]))
    got = {r["ticker"]: r for r in out.collect()}
    assert got["neg"]["ebitda_margin"] == 0.15 and got["big"]["ebitda_margin"] == 0.1
    assert got["gp"]["debt_to_ebitda"] == 2.0 and got["debt"]["debt_to_ebitda"] == 2.0
    assert got["gp"]["interest_coverage"] is None


def test_two_year_averages(spark):
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2023, "receivables": 10, "revenue": 365},
                                          {"fiscal_year": 2024, "receivables": 30, "revenue": 365}]))
    assert by_year(out, "dso") == {2023: 10.0, 2024: 20.0}


def test_one_exchange_serves_all_kpis(spark):
    plan = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2024, "revenue": 1}]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and plan.count("Exchange") == 1
    assert plan.count("+- Sort [ticker") + plan.count("Sort [ticker") >= 1 and "BatchEvalPython" not in plan


@pytest.mark.parametrize("given,expected", [
    ([10, None, 30], [10, 20, 30]), ([None, 4], [4, 4]), ([1, None, None, None, 5], [1, 1, None, 5, 5]), ([None, None], [None, None]),
])
def test_gap_fill(spark, given, expected):
    out = cleaning.fill_gaps(fin(spark, [{"fiscal_year": 2000 + i, "revenue": v} for i, v in enumerate(given)]))
    assert [by_year(out, "revenue")[2000 + i] for i in range(len(given))] == expected


@pytest.mark.parametrize("ta,tl,te,expected", [
    (100, 100, 40, 60), (100, 0.5, 40, 60), (100, 55, 40, 55), (100, -5, 40, 60), (0, 0, 0, 0), (100, 100, None, 100),
])
def test_liabilities_repair(spark, ta, tl, te, expected):
    out = cleaning.repair(fin(spark, [{"fiscal_year": 2024, "total_assets": ta, "total_liabilities": tl, "total_equity": te}]))
    assert out.first()["total_liabilities"] == expected


def test_gross_profit_noise(spark):
    row = cleaning.repair(fin(spark, [{"fiscal_year": 2024, "revenue": 1e9, "gross_profit": 10845, "operating_income": 5e7, "cogs": 3}])).first()
    assert row["gross_profit"] is None and row["cogs"] is None
    kept = cleaning.repair(fin(spark, [{"fiscal_year": 2024, "revenue": 1e9, "gross_profit": 10845, "cogs": 3}])).first()
    assert kept["gross_profit"] == 10845 and kept["cogs"] == 3


def kpi_frame(spark, rows):
    names = sorted({k for r in rows for k in r} - {"ticker", "fiscal_year"})
    ddl = "ticker string, fiscal_year int" + "".join(f", {n} double" for n in names)
    df = spark.createDataFrame([(r.get("ticker", "A"), r["fiscal_year"], *[r.get(n) for n in names]) for r in rows], ddl)
    return df.select("*", *[F.lit(None).cast("double").alias(k) for k in kpis.KPIS if k not in names])


@pytest.mark.parametrize("kpi,value,severity", [
    ("debt_to_ebitda", 4.0, "Media"), ("debt_to_ebitda", 4.01, "Alta"), ("debt_to_ebitda", 1.5, None), ("debt_to_ebitda", 1.6, "Baja"),
    ("current_ratio", 1.0, "Media"), ("current_ratio", 2.0, None), ("current_ratio", 0.99, "Alta"), ("dso", 120.0, "Media"),
    ("revenue_growth_yoy", -0.1, "Media"), ("debt_to_equity", -3.0, None), ("net_profit_margin", 0.0, "Baja"),
])
def test_threshold_bands(spark, kpi, value, severity):
    found = flags.threshold_flags(kpi_frame(spark, [{"fiscal_year": 2024, kpi: value}, {"fiscal_year": 2023, kpi: -99.0}])).collect()
    assert [f["severity"] for f in found if f["kpi"] == kpi] == ([severity] if severity else [])


def test_rules_by_sector_and_without_rules(spark):
    rules = {"default_sector": "a", "sectors": {
        "a": [{"id": "R1", "name": "n", "description": "d", "kpi": "roe", "Alta": {"lt": 0.0}, "Media": {}}],
        "b": [{"id": "R2", "name": "n", "description": "d", "kpi": "roa", "Baja": {"gte": 1.0, "lte": 2.0}}]}}
    k = kpi_frame(spark, [{"ticker": t, "fiscal_year": 2024, "roe": -1.0, "roa": 1.5} for t in ("x", "y", "z")])
    sector = F.when(F.col("ticker") == "y", "b").when(F.col("ticker") == "z", "unknown").otherwise("a")
    got = {r["ticker"]: (r["flag_id"], r["threshold"]) for r in flags.threshold_flags(k, rules, sector).collect()}
    assert got == {"x": ("R1", {"lt": 0.0}), "y": ("R2", {"gte": 1.0, "lte": 2.0}), "z": ("R1", {"lt": 0.0})}
    assert flags.evaluate_flags(k, fin(spark, [{"fiscal_year": 2024}]), {}).count() == 0


@pytest.mark.parametrize("margins,longest,last,severity", [
    ([-1.0, -1.0, 1.0, -1.0], 2, 2003, "Alta"), ([-1.0, None, -1.0], 2, 2002, "Alta"), ([1.0, -1.0, 0.0], 1, 2001, "Media"), ([1.0, 0.0], None, None, None),
])
def test_loss_streaks(spark, margins, longest, last, severity):
    k = kpi_frame(spark, [{"fiscal_year": 2000 + i, "net_profit_margin": m} for i, m in enumerate(margins)])
    got = flags.loss_flags(k).collect()
    assert [(f["severity"], f["fiscal_year"], f["threshold"]["consecutive_loss_years"]) for f in got] == (
        [(severity, last, longest)] if severity else [])


def test_flags_in_order_and_checklist(spark):
    f = fin(spark, [{"fiscal_year": 2024, "revenue": 100, "net_income": 1, "operating_cash_flow": -1,
                     "current_assets": 15, "current_liabilities": 10}])
    k = kpis.calculate_kpis(f)
    listed = flags.in_order(flags.evaluate_flags(k, f)).collect()
    assert [r["flag_id"] for r in listed] == ["FLAG-S01", "FLAG-002", "FLAG-005"] or [r["severity"] for r in listed] == sorted(
        [r["severity"] for r in listed])
    checks = {r["flag_id"]: r["severity"] for r in flags.rule_checklist(f.select("ticker"), flags.evaluate_flags(k, f)).collect()}
    assert len(checks) == 8 and checks["FLAG-001"] == "OK" and checks["FLAG-005"] == "Baja" and checks["FLAG-002"] == "Baja"


@pytest.mark.parametrize("dso,debt,margin,expected", [
    (160.0, 3.0, 0.09, "CANDIDATO PRIORITARIO"), (160.0, 6.0, 0.09, "CANDIDATO CON RESTRICCIONES"), (160.0, 3.0, 0.04, "CANDIDATO CON RESTRICCIONES"),
    (100.0, 6.0, 0.0, "NO RECOMENDADO"), (130.0, 1.0, 0.2, "CANDIDATO MODERADO"), (100.0, 4.0, None, "CANDIDATO MODERADO"),
    (None, 4.0, 0.1, None), (160.0, 3.0, None, None), (100.0, 1.0, 0.2, None),
])
def test_financing_rating(value, dso, debt, margin, expected):
    c = [F.lit(v).cast("double") for v in (dso, debt, margin)]
    assert value(credit.financing_rating(*c)) == expected


def test_credit_context(spark):
    rows = [{"fiscal_year": y, "revenue": r, "receivables": 4e8, "cash": 1e8, "long_term_debt": 3e8, "cogs": 5e8,
             "inventory": 1e8, "accounts_payable": 1e8, "operating_income": 1e8} for y, r in ((2022, 1e9), (2023, 2e9), (2024, 3e9))]
    f = fin(spark, rows)
    got = credit.credit_context(kpis.calculate_kpis(f), f).first()
    assert got["avg_growth_pct"] == 40.0 and got["net_debt_mmm"] == 0.2 and got["projected_revenue_mmm"] == 4.2
    assert got["factoring_eligible_mmm"] == 0.3 and got["ccc_trend"] == "decreciente" and got["dso_zone"].startswith("Excelente")


def test_views(spark):
    k = kpi_frame(spark, [{"ticker": "A", "fiscal_year": y, "roe": v} for y, v in ((2020, 0.1), (2021, -0.2), (2022, None))])
    card = views.kpi_cards(k, ["roe", "dso"]).collect()
    assert len(card) == 1 and card[0]["fiscal_year"] == 2021 and card[0]["delta"] == pytest.approx(-3.0)
    assert card[0]["latest_text"] == "-20.0%" and card[0]["delta_text"] == "-300.0%"
    with pytest.raises(ValueError):
        views.kpi_cards(k, kpis.KPIS[:6])
    assert len(fixed.KPI_META) == 20
    meta = spark.createDataFrame([("A", "co"), ("B", "co"), ("T", "test")], "slug string, country string")
    assert [r["slug"] for r in views.available_companies(meta, k).collect()] == ["A"]
    pages = spark.createDataFrame([("A", "net_income", 12)], "ticker string, canonical string, page int")
    assert views.kpi_sources(views.kpi_cards(k, ["roe"]), pages).first()["source_page"] == 12


def test_scenarios(spark):
    k = kpi_frame(spark, [{"fiscal_year": y, "ebitda_margin": v} for y, v in ((2020, 0.1), (2021, 0.3), (2022, 0.3), (2023, 0.1))])
    got = credit.scenarios(k).first()
    assert (got["metric"], got["best_year"], got["worst_year"], got["mean"]) == ("ebitda_margin", 2021, 2020, pytest.approx(0.2))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([("A", 2024, float("nan"))], "ticker string, fiscal_year int, revenue double")
    assert conform_financials(df).first()["revenue"] is None


def test_a_failing_entry_of_the_registry_itself(spark, monkeypatch):
    def fails(s):
        raise ZeroDivisionError

    monkeypatch.setitem(kpis.REGISTRY, "fails", fails)
    out = kpis.calculate_kpis(fin(spark, [{"fiscal_year": 2024, "revenue": 10.0, "net_income": 2.0}])).first()
    assert out["fails"] is None and sum(v is not None for v in out.asDict().values()) > 2


def test_one_walk_over_the_years_reads_the_source_once(spark, tmp_path):
    rows = [{"ticker": t, "fiscal_year": y, "revenue": 10.0 * y, "net_income": (-1.0) ** y, "operating_cash_flow": -1.0} for t in "ab" for y in (2021, 2022, 2023)]
    fin(spark, rows).write.parquet(str(tmp_path / "fin"))
    stored = schema.conform_financials(spark.read.parquet(str(tmp_path / "fin")))
    states = company.of_financials(stored)
    for out in (flags.of_companies(states), credit.of_companies(states), credit.scenarios_of(states), flags.checklist_of(states)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan
        executed = out._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange hashpartitioning") == 1


def test_states_from_tables_and_from_statements_agree(spark):
    rng = random.Random(3)
    rows = [{"ticker": f"t{c}", "fiscal_year": 2000 + y, "revenue": rng.choice([None, 0.0, 100.0, 250.0]), "net_income": rng.choice([None, -5.0, 5.0]),
             "operating_cash_flow": rng.choice([None, -5.0, 5.0]), "receivables": rng.choice([None, 20.0]), "inventory": 7.0, "cogs": rng.choice([None, 30.0]),
             "accounts_payable": 3.0, "gross_profit": rng.choice([None, 40.0])} for c in range(40) for y in range(rng.randint(1, 6))]
    f = fin(spark, rows)
    k = kpis.calculate_kpis(f)
    states = company.of_financials(f)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(flags.of_companies(states)) == order(flags.evaluate_flags(k, f))
    assert order(credit.of_companies(states)) == order(credit.credit_context(k, f))
    assert order(credit.scenarios_of(states)) == order(credit.scenarios(k))
    # Runs of losses, walked by hand.
    margins = {}
    for r in k.orderBy("ticker", "fiscal_year").collect():
        margins.setdefault(r["ticker"], []).append((r["fiscal_year"], r["net_profit_margin"]))
    want = {}
    for t, years in margins.items():
        run = longest = 0
        last = None
        for y, m in years:
            if m is not None:
                run = run + 1 if m < 0 else 0
                longest, last = max(longest, run), y if m < 0 else last
        if longest:
            want[t] = (longest, last)
    assert {r["ticker"]: (r["longest_run"], r["last_loss_year"]) for r in flags.loss_streaks(k).collect()} == want


def test_rounding_is_of_the_exact_value(spark, value):
    from ledgerline.functions.numbers import billions, rounded

    for v, digits in [(2.675, 2), (0.25, 1), (0.35, 1), (-0.25, 1), (1e22 / 3, 1), (0.125, 2), (-2.5, 0), (1234567.0005, 3)]:
        assert value(rounded(F.col("v"), digits), v=v) == round(v, digits)
    assert value(rounded(F.col("v"), 1), v=float("inf")) == float("inf") and value(billions(F.col("v")), v=2500500000.0) == round(2.5005, 3)


def test_growth_without_figures_is_ten_per_cent(spark):
    assert credit.of_companies(company.of_financials(fin(spark, [{"fiscal_year": 2024, "revenue": 5.0}]))).first()["avg_growth_pct"] == 10.0
