"""Regulator facts: every order line as one reported fact of a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import facts as ops, state
from ledgerline.plans import jobs
from ledgerline.schema import PERIOD_FIELDS, STATEMENT_FIELDS
from workload.inputs import FACTS, duck, load, spark_sql
from workload.registry import query

RAW = duck(FACTS)

TAG_ROWS = ", ".join(f"('{t}', '{f}', {i})" for t, f, i in [
    ("Revenues", "revenue", 2), ("SalesRevenueNet", "revenue", 3), ("RevenuesNetOfInterestExpense", "revenue", 5),
    ("Liabilities", "total_liabilities", 0), ("LiabilitiesAndStockholdersEquity", "total_liabilities", 1),
    ("Assets", "total_assets", 0), ("NetIncomeLoss", "net_income", 0), ("CommonStockSharesOutstanding", "shares_outstanding", 0),
])
PERIODS = ", ".join(f"'{f}'" for f in PERIOD_FIELDS)

# The check ranks single filings, the library aggregates them.
SERIES_CTES = f"""
raw AS ({RAW}),
c AS (SELECT raw.*, t.field, t.priority FROM raw JOIN (VALUES {TAG_ROWS}) t(tag, field, priority) USING (tag)
  WHERE unit = 'USD' AND form = '10-K'
    AND (field NOT IN ({PERIODS}) OR (fp = 'FY' AND date_diff('day', start, "end") > 300))),
e AS (SELECT *, row_number() OVER (PARTITION BY ticker, tag, "end" ORDER BY filed DESC, p1, p2, p3) AS rk,
        row_number() OVER (PARTITION BY ticker, tag ORDER BY p1, p2, p3) AS pos FROM c),
f AS (SELECT *, min(pos) OVER (PARTITION BY ticker, tag, "end") AS first_pos FROM e),
y AS (SELECT *, row_number() OVER (PARTITION BY ticker, tag, year("end") ORDER BY first_pos DESC) AS yk FROM f WHERE rk = 1),
z AS (SELECT *, min(priority) OVER (PARTITION BY ticker, field) AS best FROM y WHERE yk = 1),
series AS (SELECT ticker, CAST(year("end") AS INT) AS fiscal_year, field, val FROM z WHERE priority = best)
"""
WIDE_CTE = f"""wide AS (SELECT ticker, fiscal_year, {", ".join(f"max(CASE WHEN field = '{f}' THEN val END) AS {f}" for f in STATEMENT_FIELDS)}
  FROM series GROUP BY 1, 2)"""


def facts(spark, sf_dir):
    raw = spark_sql(spark, sf_dir, FACTS)
    return raw.withColumn("pos", F.struct("p1", "p2", "p3")).drop("p1", "p2", "p3")


# Parts report facts; suppliers are asked for too and have none.
ASKED = "SELECT CAST(p_partkey AS STRING) AS ticker FROM part UNION ALL SELECT s_name FROM supplier"


def companies(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ticker"))
    return parts.unionByName(load(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker")))


@query(f"WITH {SERIES_CTES} SELECT * FROM series")
def fact_series(spark, sf_dir):
    return ops.field_series(facts(spark, sf_dir)).select("ticker", "fiscal_year", "field", "val")


@query(f"WITH {SERIES_CTES}, {WIDE_CTE} SELECT * FROM wide")
def fact_financials(spark, sf_dir):
    return ops.raw_financials(facts(spark, sf_dir))


def _near(f: str) -> str:
    return (f"CASE WHEN {f} IS NOT NULL THEN {f} WHEN lag({f}) OVER w IS NULL THEN lead({f}) OVER w "
            f"WHEN lead({f}) OVER w IS NULL THEN lag({f}) OVER w ELSE (lag({f}) OVER w + lead({f}) OVER w) / 2 END AS {f}")


@query(f"""WITH {SERIES_CTES}, {WIDE_CTE},
clean AS (SELECT ticker, fiscal_year, {", ".join(_near(f) for f in ("revenue", "net_income", "total_assets", "total_liabilities"))}
  FROM wide WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))
SELECT ticker, fiscal_year, net_income / nullif(revenue, 0) AS net_profit_margin, net_income / nullif(total_assets, 0) AS roa,
  revenue / nullif(lag(revenue) OVER w, 0) - 1 AS revenue_growth_yoy,
  revenue / nullif((total_assets + coalesce(lag(total_assets) OVER w, total_assets)) / 2, 0) AS asset_turnover
FROM clean WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)""")
def fact_etl(spark, sf_dir):
    done = jobs.from_facts(facts(spark, sf_dir), companies(spark, sf_dir))
    return done.kpis.select("ticker", "fiscal_year", "net_profit_margin", "roa", "revenue_growth_yoy", "asset_turnover")


@query(f"""WITH {SERIES_CTES} SELECT ticker, ticker || ': no statement field could be filled' AS error_message
FROM ({ASKED}) WHERE ticker NOT IN (SELECT ticker FROM c)""")
def fact_errors(spark, sf_dir):
    return jobs.from_facts(facts(spark, sf_dir), companies(spark, sf_dir)).errors


@query(f"""WITH raw AS ({RAW}), a AS (SELECT ticker, CAST(count(DISTINCT fy) AS INT) AS fy_count, min(fy) AS earliest_fy, max(fy) AS latest_fy
  FROM raw WHERE form = '10-K' AND fp = 'FY' GROUP BY 1)
SELECT p.ticker, a.ticker IS NOT NULL AS ok, coalesce(fy_count, 0) AS fy_count, earliest_fy, latest_fy,
  CASE WHEN a.ticker IS NOT NULL THEN NULL WHEN p.ticker IN (SELECT ticker FROM raw) THEN 'no annual filing entries' ELSE 'no facts found' END AS reason
FROM ({ASKED}) p LEFT JOIN a USING (ticker)""")
def fact_profile(spark, sf_dir):
    return ops.profile(facts(spark, sf_dir), companies(spark, sf_dir))


@query("""WITH ids AS (SELECT upper(p_brand) || CASE WHEN p_size < 25 THEN '.A' ELSE '-B' END AS ticker,
   lpad(CAST(max(p_partkey) AS STRING), 10, '0') AS cik FROM part GROUP BY 1),
t AS (SELECT p_partkey, p_brand || CASE WHEN p_size < 20 THEN '.a' WHEN p_size < 40 THEN '-a' ELSE '-c' END AS ticker FROM part)
SELECT p_partkey, t.ticker, coalesce(a.cik, b.cik) AS cik,
  CASE WHEN coalesce(a.cik, b.cik) IS NULL THEN 'unknown ticker ' || upper(t.ticker) END AS error
FROM t LEFT JOIN ids a ON a.ticker = upper(t.ticker)
LEFT JOIN ids b ON b.ticker = CASE WHEN contains(t.ticker, '.') THEN replace(upper(t.ticker), '.', '-') ELSE replace(upper(t.ticker), '-', '.') END""")
def ticker_ids(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    brand, size = F.col("p_brand"), F.col("p_size")
    ids = part.groupBy(F.concat(F.upper(brand), F.when(size < 25, ".A").otherwise("-B")).alias("ticker")).agg(
        F.lpad(F.max("p_partkey").cast("string"), 10, "0").alias("cik"))
    asked = part.select("p_partkey", F.concat(
        brand, F.when(size < 20, ".a").when(size < 40, "-a").otherwise("-c")).alias("ticker"))
    return ops.resolve_ids(asked, ids)


@query(f"""WITH {SERIES_CTES}, n AS ({ASKED}),
 done AS (SELECT ticker, count(DISTINCT fiscal_year) AS fy_count FROM series GROUP BY 1)
SELECT CASE WHEN done.ticker IS NULL THEN 'error' ELSE 'success' END AS status, count(*) AS n
FROM n LEFT JOIN done USING (ticker) GROUP BY 1""")
def batch_summary(spark, sf_dir):
    done = jobs.from_facts(facts(spark, sf_dir), companies(spark, sf_dir))
    return state.batch_summary(jobs.run_log(done.financials, done.errors, scraped=True))


