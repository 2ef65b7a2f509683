"""Ratios, repairs, findings and credit context on the derived financials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.operators import cleaning, company, credit, flags, kpis, views
from ledgerline.operators.labels import critical_fields
from ledgerline.schema import STATEMENT_FIELDS, conform_financials
from workload.inputs import FINANCIALS, duck, financials, load
from workload.registry import query

FIN = duck(FINANCIALS)

# The check's own statement of the ratios: nullif for empty denominators, a self join for the look-back.
KPI_STEPS = """
p AS (
  SELECT f.*, lag(revenue) OVER w AS revenue_1, lag(total_assets) OVER w AS assets_1, lag(inventory) OVER w AS inventory_1,
    lag(receivables) OVER w AS receivables_1, lag(accounts_payable) OVER w AS payable_1,
    (CASE WHEN abs(depreciation_amortization) / nullif(revenue, 0) <= 0.20 THEN abs(depreciation_amortization) ELSE 0e0 END) AS da,
    (CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL
     THEN coalesce(long_term_debt, 0e0) + coalesce(short_term_debt, 0e0)
     ELSE total_liabilities - current_liabilities END) AS debt
  FROM fin f WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)),
base AS (
  SELECT a.ticker, a.fiscal_year, max(a.fiscal_year - b.fiscal_year) AS n,
    arg_max(b.revenue, a.fiscal_year - b.fiscal_year) AS v
  FROM fin a JOIN fin b ON a.ticker = b.ticker AND b.fiscal_year BETWEEN a.fiscal_year - 10 AND a.fiscal_year - 1
    AND b.revenue <> 0 GROUP BY 1, 2),
k AS (
  SELECT p.ticker, p.fiscal_year,
    revenue / nullif(revenue_1, 0) - 1 AS revenue_growth_yoy,
    CASE WHEN revenue / base.v >= 0 OR base.n = 1 THEN power(revenue / base.v, 1e0 / base.n) - 1 END AS revenue_cagr_10y,
    gross_profit / nullif(revenue, 0) AS gross_profit_margin,
    coalesce(operating_income, gross_profit) / nullif(revenue, 0) AS operating_margin,
    net_income / nullif(revenue, 0) AS net_profit_margin,
    (coalesce(operating_income, gross_profit) + da) / nullif(revenue, 0) AS ebitda_margin,
    net_income / nullif(total_equity, 0) AS roe,
    net_income / nullif(total_assets, 0) AS roa,
    current_assets / nullif(current_liabilities, 0) AS current_ratio,
    (cash + coalesce(short_term_investments, 0e0) + coalesce(receivables, 0e0)) / nullif(current_liabilities, 0) AS quick_ratio,
    cash / nullif(current_liabilities, 0) AS cash_ratio,
    current_assets - current_liabilities AS working_capital,
    total_liabilities / nullif(total_equity, 0) AS debt_to_equity,
    debt / nullif(coalesce(operating_income, gross_profit) + da, 0) AS debt_to_ebitda,
    operating_income / nullif(interest_expense, 0) AS interest_coverage,
    debt / nullif(total_assets, 0) AS debt_to_assets,
    revenue / nullif((total_assets + coalesce(assets_1, total_assets)) / 2, 0) AS asset_turnover,
    cogs / nullif((inventory + coalesce(inventory_1, inventory)) / 2, 0) AS inventory_turnover,
    (receivables + coalesce(receivables_1, receivables)) / 2 / nullif(revenue, 0) * 365 AS dso,
    (inventory + coalesce(inventory_1, inventory)) / 2 / nullif(cogs, 0) * 365
      + (receivables + coalesce(receivables_1, receivables)) / 2 / nullif(revenue, 0) * 365
      - (accounts_payable + coalesce(payable_1, accounts_payable)) / 2 / nullif(cogs, 0) * 365 AS cash_conversion_cycle
  FROM p LEFT JOIN base USING (ticker, fiscal_year))
"""
KPI_CTES = f"fin AS ({FIN}), {KPI_STEPS}"


def rounded(df, names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def kpi_table(spark, sf_dir):
    return kpis.calculate_kpis(financials(spark, sf_dir))


@query(FIN)
def financials_conformed(spark, sf_dir):
    return conform_financials(financials(spark, sf_dir))


@query(f"WITH {KPI_CTES} SELECT * REPLACE (round(revenue_cagr_10y, 9) AS revenue_cagr_10y) FROM k")
def kpi_all(spark, sf_dir):
    return rounded(kpi_table(spark, sf_dir), ["revenue_cagr_10y"])


@query(f"""WITH {KPI_CTES} SELECT ticker, fiscal_year, round(net_profit_margin, 9) AS net_profit_margin,
  round(revenue_growth_yoy, 9) AS revenue_growth_yoy, round(revenue_cagr_10y, 9) AS revenue_cagr_10y FROM k""")
def margin_and_growth(spark, sf_dir):
    names = ["net_profit_margin", "revenue_growth_yoy", "revenue_cagr_10y"]
    chosen = {n: kpis.REGISTRY[n] for n in names}
    return rounded(kpis.calculate_kpis(financials(spark, sf_dir), chosen), names)


def _filled(f: str) -> str:
    other = f"lag({f}) OVER w"
    after = f"lead({f}) OVER w"
    return (f"CASE WHEN {f} IS NOT NULL THEN {f} WHEN {other} IS NOT NULL AND {after} IS NOT NULL "
            f"THEN ({other} + {after}) / 2 ELSE coalesce({other}, {after}) END")


@query(f"""WITH fin AS ({FIN}), filled AS (SELECT ticker, fiscal_year,
  {", ".join(f"{_filled(f)} AS {f}" for f in STATEMENT_FIELDS)}
  FROM fin WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))
  SELECT * FROM filled""")
def gap_fill(spark, sf_dir):
    return cleaning.fill_gaps(financials(spark, sf_dir))


REPAIRED = """
SELECT * REPLACE (
  CASE WHEN total_assets <> 0 AND total_equity IS NOT NULL AND
       (abs(total_liabilities - total_assets) < 0.01 * abs(total_assets) OR total_liabilities < 0.01 * abs(total_assets))
       THEN total_assets - total_equity ELSE total_liabilities END AS total_liabilities,
  CASE WHEN revenue > 0 AND operating_income > 0 AND abs(gross_profit) / revenue < 0.001 AND operating_income / revenue > 0.01
       THEN NULL ELSE gross_profit END AS gross_profit,
  CASE WHEN revenue > 0 AND operating_income > 0 AND abs(gross_profit) / revenue < 0.001 AND operating_income / revenue > 0.01
       THEN NULL ELSE cogs END AS cogs)
FROM fin
"""


@query(f"WITH fin AS ({FIN}) {REPAIRED}")
def statement_repairs(spark, sf_dir):
    return cleaning.repair(financials(spark, sf_dir))


# Each rule as its three cut points; the sign tells which side is bad.
CUTS = [
    ("FLAG-001", "debt_to_ebitda", ">", 4.0, 2.5, 1.5), ("FLAG-002", "current_ratio", "<", 1.0, 1.5, 2.0),
    ("FLAG-003", "interest_coverage", "<", 1.5, 2.5, 3.5), ("FLAG-004", "operating_margin", "<", 0.0, 0.03, 0.05),
    ("FLAG-005", "net_profit_margin", "<", -0.05, 0.0, 0.02), ("FLAG-006", "debt_to_equity", ">", 2.0, 1.0, 0.8),
    ("FLAG-007", "revenue_growth_yoy", "<", -0.10, 0.0, 0.03), ("FLAG-008", "dso", ">", 120.0, 90.0, 75.0),
]
LAST = "last AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) = 1)"
LAST_FIN = "lastfin AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) = 1)"
RUNS = """
m AS (SELECT ticker, fiscal_year, net_profit_margin < 0 AS loss FROM k WHERE net_profit_margin IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year)
             - row_number() OVER (PARTITION BY ticker, loss ORDER BY fiscal_year) AS run FROM m),
r AS (SELECT ticker, run, count(*) AS years, max(fiscal_year) AS last_year FROM g WHERE loss GROUP BY 1, 2),
runs AS (SELECT ticker, CAST(max(years) AS INT) AS longest_run, CAST(max(last_year) AS INT) AS last_loss_year FROM r GROUP BY 1)
"""
FLAG_ROWS = " UNION ALL ".join(
    f"""SELECT ticker, '{i}' AS flag_id, CASE WHEN {k} {o} {a} THEN 'Alta' WHEN {k} {o} {b} THEN 'Media' ELSE 'Baja' END AS severity,
    '{k}' AS kpi, {k} AS kpi_value, fiscal_year FROM last WHERE {k} {o} {c}""" for i, k, o, a, b, c in CUTS)
FLAGS_SQL = f"""
WITH {KPI_CTES}, {LAST}, {LAST_FIN}, {RUNS},
flags AS ({FLAG_ROWS}
  UNION ALL SELECT ticker, 'FLAG-S01', 'Alta', NULL, NULL, fiscal_year FROM lastfin
    WHERE operating_cash_flow < 0 AND net_income > 0
  UNION ALL SELECT ticker, 'FLAG-S02', CASE WHEN longest_run >= 2 THEN 'Alta' ELSE 'Media' END, 'net_profit_margin', NULL,
    last_loss_year FROM runs)
"""


@query(FLAGS_SQL + "SELECT ticker, flag_id, severity, kpi, round(kpi_value, 9) AS kpi_value, CAST(fiscal_year AS INT) AS fiscal_year FROM flags")
def red_flags(spark, sf_dir):
    found = flags.of_companies(company.of_financials(financials(spark, sf_dir)))
    return found.select("ticker", "flag_id", "severity", "kpi", F.round("kpi_value", 9).alias("kpi_value"), "fiscal_year")


@query(FLAGS_SQL + "SELECT severity, count(*) AS n, count(DISTINCT ticker) AS companies FROM flags GROUP BY 1")
def red_flag_summary(spark, sf_dir):
    found = flags.of_companies(company.of_financials(financials(spark, sf_dir)))
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("companies"))


@query(f"WITH {KPI_CTES}, {RUNS} SELECT * FROM runs")
def loss_streaks(spark, sf_dir):
    return company.of_financials(financials(spark, sf_dir)).filter("losses IS NOT NULL").select("ticker", "losses.*")


@query(FLAGS_SQL + f""", rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r['id']}')" for i, r in enumerate(fixed.RULES['sectors']['healthcare']))}) t(ord, flag_id))
SELECT c.ticker, CAST(rules.ord AS INT) AS ord, rules.flag_id, coalesce(flags.severity, 'OK') AS severity
FROM (SELECT DISTINCT ticker FROM fin) c CROSS JOIN rules LEFT JOIN flags ON flags.ticker = c.ticker AND flags.flag_id = rules.flag_id""")
def rule_checklist(spark, sf_dir):
    states = company.of_financials(financials(spark, sf_dir))
    listed = flags.checklist_of(states)
    return listed.select("ticker", "ord", "flag_id", "severity")


def exact(value: str, digits: int) -> str:
    """The check's rounding: a decimal text of the exact value, halves to even."""
    return f"CAST(format('{{{{:.{digits}f}}}}', {value}) AS DOUBLE)".replace("{{", "{").replace("}}", "}")


CREDIT_SQL = f"""
WITH {KPI_CTES}, {LAST}, {LAST_FIN},
c2 AS (SELECT ticker, fiscal_year, cash_conversion_cycle - lag(cash_conversion_cycle) OVER (PARTITION BY ticker ORDER BY fiscal_year) AS delta,
   row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC) AS back FROM k WHERE cash_conversion_cycle IS NOT NULL),
gr AS (SELECT ticker, CASE WHEN avg(revenue_growth_yoy) IS NULL THEN 0.10 ELSE greatest(-0.10, least(avg(revenue_growth_yoy), 0.40)) END AS g FROM k GROUP BY 1),
x AS (
  SELECT last.*, coalesce(lf.revenue, 0) AS rev, coalesce(lf.receivables, 0) AS ar, gr.g AS g, c2.delta AS delta,
    coalesce(lf.long_term_debt, 0) + coalesce(lf.short_term_debt, 0) - coalesce(lf.cash, 0) AS nd
  FROM last JOIN lastfin lf USING (ticker) JOIN gr USING (ticker) LEFT JOIN c2 ON c2.ticker = last.ticker AND c2.back = 1)
SELECT ticker, {exact('dso', 1)} AS dso_days,
  CASE WHEN dso IS NULL THEN 'N/D' WHEN dso < 90 THEN 'Excelente' WHEN dso <= 120 THEN 'Bueno' WHEN dso <= 210 THEN 'Rango' ELSE 'Cartera' END AS dso_zone,
  {exact('cash_conversion_cycle', 1)} AS ccc_days,
  CASE WHEN delta IS NULL THEN 'N/D' WHEN abs(delta) < 5 THEN 'estable' WHEN delta > 0 THEN 'creciente' ELSE 'decreciente' END AS ccc_trend,
  {exact('current_ratio', 2)} AS current_ratio, {exact('g * 100', 1)} AS avg_growth_pct,
  {exact('debt_to_ebitda', 2)} AS debt_ebitda,
  CASE WHEN debt_to_ebitda IS NULL THEN 'N/D' WHEN debt_to_ebitda < 3.5 THEN 'Saludable' WHEN debt_to_ebitda < 5 THEN 'Vigilancia' ELSE 'Estres' END AS debt_ebitda_zone,
  {exact('debt_to_equity', 2)} AS debt_equity, {exact('ebitda_margin * 100', 1)} AS ebitda_margin_pct,
  {exact('rev / 1e9', 1)} AS revenue_mmm, {exact('nd / 1e9', 1)} AS net_debt_mmm, {exact('ar / 1e9', 1)} AS receivables_mmm,
  {exact('CASE WHEN dso IS NOT NULL AND rev > 0 THEN rev * (1 + g) END / 1e9', 1)} AS projected_revenue_mmm,
  {exact('CASE WHEN dso IS NOT NULL AND rev > 0 THEN (dso / 365 * (rev * (1 + g)) - ar) / 1e9 END', 1)} AS wc_gap_mmm,
  {exact('CASE WHEN ar > 0 THEN ar * 0.7 / 1e9 END', 1)} AS factoring_eligible_mmm,
  CASE WHEN dso > 150 AND debt_to_ebitda < 3.5 AND ebitda_margin > 0.08 THEN 'CANDIDATO PRIORITARIO'
       WHEN dso > 150 AND debt_to_ebitda IS NOT NULL AND ebitda_margin IS NOT NULL AND (debt_to_ebitda > 5 OR ebitda_margin < 0.05) THEN 'CANDIDATO CON RESTRICCIONES'
       WHEN debt_to_ebitda > 5 AND ebitda_margin <= 0 AND dso IS NOT NULL THEN 'NO RECOMENDADO'
       WHEN dso IS NOT NULL AND debt_to_ebitda IS NOT NULL AND (dso BETWEEN 120 AND 150 OR (debt_to_ebitda >= 3.5 AND debt_to_ebitda < 5)) THEN 'CANDIDATO MODERADO'
       END AS factoring_rating
FROM x
"""


@query(CREDIT_SQL)
def credit_context(spark, sf_dir):
    out = credit.of_companies(company.of_financials(financials(spark, sf_dir)))
    first_word = {c: F.regexp_extract(c, "^(N/D|[A-Za-z]+)", 1) for c in ("dso_zone", "debt_ebitda_zone")}
    return out.withColumns(first_word)


@query(f"""WITH {KPI_CTES}, {LAST},
h AS (SELECT k.ticker, CASE WHEN l.revenue_cagr_10y IS NOT NULL THEN 'revenue_cagr_10y' ELSE 'ebitda_margin' END AS metric,
   k.fiscal_year, CASE WHEN l.revenue_cagr_10y IS NOT NULL THEN k.revenue_cagr_10y ELSE k.ebitda_margin END AS v
   FROM k JOIN last l USING (ticker)),
s AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS years,
   row_number() OVER (PARTITION BY ticker ORDER BY v DESC NULLS LAST, fiscal_year) AS b,
   row_number() OVER (PARTITION BY ticker ORDER BY v NULLS LAST, fiscal_year) AS w FROM h)
SELECT ticker, metric, max(CASE WHEN b = 1 THEN fiscal_year END) AS best_year, round(max(v), 6) AS best,
   max(CASE WHEN w = 1 THEN fiscal_year END) AS worst_year, round(min(v), 6) AS worst, round(avg(v), 6) AS mean
FROM s WHERE years >= 2 GROUP BY 1, 2 HAVING max(v) IS NOT NULL""")
def scenarios(spark, sf_dir):
    out = credit.scenarios_of(company.of_financials(financials(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("best", "worst", "mean")})


def _names(test: str) -> str:
    return "array_to_string([" + ", ".join(f"CASE WHEN {test.format(f)} THEN '{f}' END" for f in STATEMENT_FIELDS) + "], ',')"


@query(f"""WITH fin AS ({FIN}) SELECT ticker, CAST(count(*) AS INT) AS fy_count,
  {_names("count({}) > 0")} AS fields_extracted, {_names("count({}) = 0")} AS fields_missing FROM fin GROUP BY 1""")
def field_completeness(spark, sf_dir):
    out = cleaning.field_completeness(financials(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("fields_extracted", "fields_missing")})


@query(f"""WITH fin AS ({FIN}) SELECT ticker, fiscal_year FROM fin WHERE total_assets IS NULL OR total_equity IS NULL
  OR operating_income IS NULL OR cash IS NULL OR receivables IS NULL""")
def incomplete_years(spark, sf_dir):
    return cleaning.incomplete_years(financials(spark, sf_dir), fixed.BACKFILL_FIELDS).select("ticker", "fiscal_year")


@query(f"""WITH fin AS ({FIN}), c AS (SELECT ticker, CASE n_nationkey WHEN 1 THEN 'CO' WHEN 2 THEN 'PE' WHEN 3 THEN 'CL' ELSE 'XX' END AS country,
  count(revenue) > 0 AS revenue, count(net_income) > 0 AS net_income, count(total_assets) > 0 AS total_assets,
  count(total_liabilities) > 0 AS total_liabilities, count(total_equity) > 0 AS total_equity, count(operating_cash_flow) > 0 AS ocf
  FROM fin JOIN customer ON CAST(c_custkey AS STRING) = ticker JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT ticker, array_to_string(list_filter([
   CASE WHEN NOT revenue THEN 'revenue' END,
   CASE WHEN country <> 'CO' AND NOT net_income THEN 'net_income' END,
   CASE WHEN NOT total_assets THEN 'total_assets' END,
   CASE WHEN country <> 'CL' AND NOT total_liabilities THEN 'total_liabilities' END,
   CASE WHEN country IN ('CO', 'CL') AND NOT total_equity THEN 'total_equity' END,
   CASE WHEN NOT ocf THEN 'operating_cash_flow' END], lambda x: x IS NOT NULL), ',') AS missing_critical FROM c""")
def missing_critical_fields(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    nation = F.col("c_nationkey")
    country = F.when(nation == 1, "CO").when(nation == 2, "PE").when(nation == 3, "CL").otherwise("XX")
    own = customers.select(F.col("c_custkey").cast("string").alias("ticker"), country.alias("country"))
    fin = financials(spark, sf_dir).join(own, "ticker")
    found = cleaning.missing_critical_fields(fin, critical_fields(F.col("country")))
    return found.select("ticker", F.array_join("missing_critical", ",").alias("missing_critical"))


# --- dashboard ---------------------------------------------------------------------------------------

CARDS = fixed.DEFAULT_KPIS


@query(f"""WITH {KPI_CTES}, v AS (UNPIVOT (SELECT ticker, fiscal_year, {", ".join(CARDS)} FROM k WHERE fiscal_year BETWEEN 1996 AND 2000)
   ON {", ".join(CARDS)} INTO NAME kpi VALUE value),
 o AS (SELECT *, lead(value) OVER w AS prior, row_number() OVER w AS back FROM v WINDOW w AS (PARTITION BY ticker, kpi ORDER BY fiscal_year DESC))
SELECT ticker, kpi, fiscal_year, round(value, 6) AS latest, round(prior, 6) AS prior,
  round((value - prior) / nullif(abs(prior), 0), 6) AS delta FROM o WHERE back = 1""")
def kpi_cards(spark, sf_dir):
    out = views.kpi_cards(kpi_table(spark, sf_dir), CARDS, 1996, 2000)
    return out.select("ticker", "kpi", "fiscal_year", *[F.round(c, 6).alias(c) for c in ("latest", "prior", "delta")])


@query(f"""WITH {KPI_CTES}, v AS (UNPIVOT (SELECT ticker, fiscal_year, {", ".join(CARDS)} FROM k)
   ON {", ".join(CARDS)} INTO NAME kpi VALUE value),
 o AS (SELECT *, row_number() OVER (PARTITION BY ticker, kpi ORDER BY fiscal_year DESC) AS back FROM v)
SELECT ticker, o.kpi, label, category,
  CASE style WHEN 'percentage' THEN printf('%.1f%%', value * 100) WHEN 'ratio_x' THEN printf('%.2fx', value) ELSE printf('%.0fd', value) END AS latest_text
FROM o JOIN (VALUES ('revenue_cagr_10y', 'Revenue CAGR (10Y)', 'Crecimiento', 'percentage'), ('ebitda_margin', 'EBITDA Margin', 'Rentabilidad', 'percentage'),
  ('quick_ratio', 'Quick Ratio', 'Liquidez', 'ratio_x'), ('debt_to_ebitda', 'Debt / EBITDA', 'Solvencia', 'ratio_x'),
  ('dso', 'Days Sales Outstanding', 'Eficiencia', 'days')) t(kpi, label, category, style) ON t.kpi = o.kpi WHERE back = 1""")
def kpi_card_texts(spark, sf_dir):
    return views.kpi_cards(kpi_table(spark, sf_dir)).select("ticker", "kpi", "label", "category", "latest_text")


@query(f"WITH {KPI_CTES} SELECT ticker, fiscal_year, round(roe, 9) AS value FROM k WHERE fiscal_year BETWEEN 1996 AND 1999")
def kpi_trend(spark, sf_dir):
    return rounded(views.kpi_trend(kpi_table(spark, sf_dir), "roe", 1996, 1999), ["value"])


@query(f"""WITH {KPI_CTES} SELECT fiscal_year, max(CASE WHEN ticker = '605' THEN round(roa, 9) END) AS "605",
  max(CASE WHEN ticker = '10' THEN round(roa, 9) END) AS "10" FROM k WHERE ticker IN ('605', '10') GROUP BY 1""")
def kpi_comparison(spark, sf_dir):
    return rounded(views.kpi_comparison(kpi_table(spark, sf_dir), "roa", ["605", "10"]), ["605", "10"])


def _money(f: str) -> str:
    return (f"CASE WHEN {f} IS NULL THEN 'N/A' WHEN abs({f}) >= 1e9 THEN printf('COP %.2f miles de mill.', {f} / 1e9) "
            f"WHEN abs({f}) >= 1e6 THEN printf('COP %.1fM', {f} / 1e6) ELSE 'COP ' || format('{{:,.0f}}', {f}) END AS {f}")


@query(f"WITH fin AS ({FIN}) SELECT ticker, fiscal_year, {', '.join(_money(f) for f, _ in fixed.SUMMARY_FIELDS)} FROM fin")
def statement_table(spark, sf_dir):
    return views.statement_table(financials(spark, sf_dir), F.lit("COP"))


@query(f"""WITH fin AS ({FIN}) SELECT ticker, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year,
  array_to_string(list_sort(list(fiscal_year)), ',') AS ascending, array_to_string(list_reverse_sort(list(fiscal_year)), ',') AS descending
  FROM fin GROUP BY 1""")
def stored_years(spark, sf_dir):
    fin = financials(spark, sf_dir)
    joined = views.year_span(fin).join(views.fiscal_years(fin), "ticker")
    return joined.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("ascending", "descending")})


@query(f"""WITH {KPI_CTES}, v AS (UNPIVOT (SELECT ticker, fiscal_year, roe, dso, cash_ratio FROM k) ON roe, dso, cash_ratio INTO NAME kpi VALUE value)
SELECT ticker, kpi, count(*) AS n_years FROM v GROUP BY 1, 2""")
def kpis_with_values(spark, sf_dir):
    return views.kpi_values(kpi_table(spark, sf_dir), ["roe", "dso", "cash_ratio"]).groupBy("ticker", "kpi").agg(
        F.count(F.lit(1)).alias("n_years"))
