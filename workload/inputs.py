"""Statement-like inputs derived from the supplied tables.

The supplied tables hold no statements, so these SQL texts turn whole tables into them. The same text
runs on Spark and in the check. No row is left out; gaps, nulls and odd values come from the data: a
customer without orders in a year has no fiscal year, and a sum over no line is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Company = customer, fiscal year = order year. Lines are summed per order before they meet the orders.
FINANCIALS = """
SELECT CAST(o_custkey AS STRING) AS ticker, CAST(fy AS INT) AS fiscal_year,
  CASE WHEN sf IS NOT NULL THEN rev END AS revenue,
  CASE WHEN sa IS NULL THEN 0.0005e0 * rev ELSE rev - 0.5e0 * sa END AS gross_profit,
  sr + 0.5e0 * sa AS cogs,
  rev - sr - 0.3e0 * sn AS operating_income,
  COALESCE(sf, 0e0) - COALESCE(so, 0e0) AS net_income,
  0.02e0 * sn AS interest_expense,
  x AS depreciation_amortization,
  2e0 * rev + COALESCE(sa, 0e0) AS total_assets,
  CASE WHEN sr IS NULL THEN 2e0 * rev + COALESCE(sa, 0e0) ELSE rev + sr END AS total_liabilities,
  rev + sa - COALESCE(sr, 0e0) AS total_equity,
  sa + sn AS current_assets,
  sr AS current_liabilities,
  0.1e0 * sn AS cash,
  0.05e0 * sa AS short_term_investments,
  0.25e0 * so AS receivables,
  100e0 * qty AS inventory,
  0.5e0 * so AS long_term_debt,
  0.1e0 * sr AS short_term_debt,
  0.2e0 * sf AS accounts_payable,
  CAST(NULL AS DOUBLE) AS shares_outstanding,
  COALESCE(sf, 0e0) - 1.1e0 * COALESCE(so, 0e0) AS operating_cash_flow,
  0.1e0 * sf AS capex
FROM (
  SELECT o_custkey, year(o_orderdate) AS fy,
    CAST(SUM(rev) AS DOUBLE) AS rev, CAST(SUM(qty) AS DOUBLE) AS qty, CAST(SUM(x) AS DOUBLE) AS x,
    CAST(SUM(sr) AS DOUBLE) AS sr, CAST(SUM(sa) AS DOUBLE) AS sa, CAST(SUM(sn) AS DOUBLE) AS sn,
    CAST(SUM(sf) AS DOUBLE) AS sf, CAST(SUM(so) AS DOUBLE) AS so
  FROM (
    SELECT l_orderkey, SUM(p * (1 - d)) AS rev, SUM(q) AS qty,
      SUM(CASE WHEN s = 'F' THEN p * t * CASE f WHEN 'R' THEN -1 WHEN 'A' THEN 6 ELSE 1 END END) AS x,
      SUM(CASE WHEN f = 'R' THEN p END) AS sr, SUM(CASE WHEN f = 'A' THEN p END) AS sa,
      SUM(CASE WHEN f = 'N' THEN p END) AS sn,
      SUM(CASE WHEN s = 'F' THEN p END) AS sf, SUM(CASE WHEN s = 'O' THEN p END) AS so
    FROM (
      SELECT l_orderkey, l_returnflag AS f, l_linestatus AS s,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d,
        CAST(l_tax AS DECIMAL(4,2)) AS t, CAST(l_quantity AS BIGINT) AS q
      FROM {lineitem}) lines
    GROUP BY l_orderkey) per_order
  JOIN {orders} ON o_orderkey = l_orderkey
  GROUP BY o_custkey, year(o_orderdate)) sums
"""

# Company = part; every order line is one reported fact.
FACTS = """
SELECT CAST(l_partkey AS STRING) AS ticker,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Revenues'
       WHEN l_returnflag = 'R' AND l_linenumber < 5 THEN 'SalesRevenueNet'
       WHEN l_returnflag = 'R' THEN 'RevenuesNetOfInterestExpense'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber < 3 THEN 'Liabilities'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'LiabilitiesAndStockholdersEquity'
       WHEN l_returnflag = 'A' THEN 'Assets'
       WHEN l_linestatus = 'F' THEN 'NetIncomeLoss'
       WHEN l_linenumber < 4 THEN 'CommonStockSharesOutstanding'
       ELSE 'EntityCommonStockSharesOutstanding' END AS tag,
  CASE WHEN l_linenumber = 6 OR (l_returnflag = 'N' AND l_linestatus = 'O') THEN 'shares' ELSE 'USD' END AS unit,
  CASE WHEN l_tax > 0.075 THEN '10-Q' ELSE '10-K' END AS form,
  CASE WHEN l_discount > 0.095 THEN 'Q4' ELSE 'FY' END AS fp,
  CAST(year(l_shipdate) + 1 AS INT) AS fy,
  CAST(l_shipdate - CAST(l_quantity + 290 AS INT) * INTERVAL '1' DAY AS DATE) AS start,
  CAST(l_shipdate AS DATE) AS "end",
  CAST(l_shipdate + l_linenumber * INTERVAL '30' DAY AS DATE) AS filed,
  l_extendedprice AS val,
  l_orderkey AS p1, l_linenumber AS p2, l_suppkey AS p3
FROM {lineitem}
"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sql: str) -> str:
    """The text for the check, where the tables are views of the same names."""
    return sql.format(**{t: t for t in TABLES})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    text = sql.replace('"end"', "`end`")
    return spark.sql(text, **used)


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, FINANCIALS)
