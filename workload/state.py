"""Upserts, missing years, staleness, run records, corrections and exchange rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions.years import default_report_year, year_of_file
from ledgerline.operators import fx, state
from workload.inputs import duck, financials, load, spark_sql
from workload.ratios import FIN
from workload.registry import query

NOW = "2002-03-15"

# Stored: one row per customer and year from orders that are finished or under way. New: open orders, of which the last one counts.
STORED = """SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS fiscal_year, 'stored' AS origin,
  max(o_totalprice) AS amount FROM {orders} WHERE o_orderstatus <> 'O' GROUP BY 1, 2, 3"""
NEW = """SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderpriority AS origin,
  o_totalprice AS amount, o_orderkey FROM {orders} WHERE o_orderstatus = 'O'"""


@query(f"""WITH n AS (SELECT ticker, fiscal_year, arg_max(origin, o_orderkey) AS origin, arg_max(amount, o_orderkey) AS amount FROM ({duck(NEW)}) GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT s.* FROM ({duck(STORED)}) s ANTI JOIN n USING (ticker, fiscal_year)""")
def upsert_years(spark, sf_dir):
    return state.upsert(spark_sql(spark, sf_dir, STORED), spark_sql(spark, sf_dir, NEW), ["ticker", "fiscal_year"], ["o_orderkey"])


TICKERS = "SELECT CAST(c_custkey AS STRING) AS ticker FROM {customer}"


@query(f"""SELECT c.ticker, CAST(y AS INT) AS fiscal_year FROM ({duck(TICKERS)}) c, range(1996, 2002) t(y)
WHERE NOT EXISTS (SELECT 1 FROM ({duck(STORED)}) s WHERE s.ticker = c.ticker AND s.fiscal_year = y)""")
def missing_years(spark, sf_dir):
    return state.missing_years(spark_sql(spark, sf_dir, TICKERS), spark_sql(spark, sf_dir, STORED), NOW)


PLAN_SQL = f"""fin AS ({FIN}), plan AS (SELECT c.ticker, CAST(y AS INT) AS fiscal_year,
  CASE WHEN f.ticker IS NULL OR bad THEN 'pending' ELSE 'skipped' END AS status, coalesce(bad, false) AS forced
FROM ({duck(TICKERS)}) c CROSS JOIN range(1997, 2002) t(y) LEFT JOIN (SELECT ticker, fiscal_year,
  total_assets IS NULL OR total_equity IS NULL OR operating_income IS NULL OR cash IS NULL OR receivables IS NULL AS bad FROM fin) f
  ON f.ticker = c.ticker AND f.fiscal_year = y)"""


@query(f"WITH {PLAN_SQL} SELECT * FROM plan")
def backfill_plan(spark, sf_dir):
    return state.backfill_plan(spark_sql(spark, sf_dir, TICKERS), financials(spark, sf_dir), NOW)


@query(f"WITH {PLAN_SQL} SELECT ticker, count(*) FILTER (status <> 'pending') AS done, count(*) AS total, count(*) FILTER (status = 'pending') AS pending FROM plan GROUP BY 1")
def backfill_progress(spark, sf_dir):
    plan = state.backfill_plan(spark_sql(spark, sf_dir, TICKERS), financials(spark, sf_dir), NOW)
    return state.backfill_progress(plan).select("ticker", "done", "total", "pending")


# A request per customer and year with orders, and one of a year without; each order is a reading, of this year or the next.
REQUESTS = """SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, max(o_orderpriority) = '5-LOW' AS forced,
  min(o_totalprice) > 20000 AS downloaded, CASE WHEN min(o_totalprice) < 5000 THEN 'timed out' END AS error FROM {orders} GROUP BY 1, 2
  UNION ALL SELECT CAST(c_custkey AS STRING), 2003, false, c_acctbal > 0, NULL FROM {customer}"""
READINGS = """SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) AS INT) AS year, o_orderkey AS ord,
  CAST(year(o_orderdate) + CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS INT) AS fiscal_year,
  CASE WHEN o_totalprice > 250000 THEN 'Alta' ELSE 'Media' END AS confidence,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0e0 ELSE o_totalprice END AS revenue, o_totalprice AS total_assets
  FROM {orders}"""
HAVE = "SELECT CAST(o_custkey AS STRING) AS ticker, CAST(year(o_orderdate) + CASE WHEN max(o_totalprice) > 400000 THEN 0 ELSE 100 END AS INT) AS fiscal_year FROM {orders} GROUP BY o_custkey, year(o_orderdate)"


@query(f"""WITH q AS ({duck(REQUESTS)}), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY fiscal_year <> year, ord) AS k FROM ({duck(READINGS)})),
j AS (SELECT q.*, h.ticker IS NOT NULL AS have, r.ticker IS NOT NULL AS read,
  CASE WHEN r.fiscal_year <> r.year OR r.revenue = 0 THEN 'Baja' ELSE r.confidence END AS sure
  FROM q LEFT JOIN r ON r.ticker = q.ticker AND r.year = q.year AND k = 1 LEFT JOIN ({duck(HAVE)}) h ON h.ticker = q.ticker AND h.fiscal_year = q.year),
s AS (SELECT *, CASE WHEN have AND NOT forced THEN 'skipped' WHEN error IS NOT NULL THEN 'error' WHEN NOT downloaded THEN 'not_found'
  WHEN NOT read THEN 'error' WHEN sure = 'Baja' THEN 'low_conf' ELSE 'ok' END AS status FROM j)
SELECT ticker, year, status, CASE WHEN status IN ('ok', 'low_conf') THEN sure END AS confidence,
  CASE WHEN status = 'error' THEN coalesce(error, 'no reading') END AS error_msg FROM s""")
def backfill_outcome(spark, sf_dir):
    return state.backfill_outcome(
        spark_sql(spark, sf_dir, REQUESTS), spark_sql(spark, sf_dir, READINGS), spark_sql(spark, sf_dir, HAVE))


LOADED = "SELECT CAST(o_custkey AS STRING) AS ticker, max(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END) AS last_downloaded FROM {orders} GROUP BY 1"


@query(f"""SELECT c.ticker, l.last_downloaded IS NULL OR NOT (year(last_downloaded) = 2001 AND quarter(last_downloaded) = 2) AS needs_update
FROM ({duck(TICKERS)}) c LEFT JOIN ({duck(LOADED)}) l USING (ticker)""")
def staleness(spark, sf_dir):
    return state.staleness(spark_sql(spark, sf_dir, TICKERS), spark_sql(spark, sf_dir, LOADED), "2001-05-20").select(
        "ticker", "needs_update")


RUN_RECORDS = """SELECT CAST(o_custkey AS STRING) AS ticker, max(o_orderdate) AS last_downloaded, max(o_orderdate) AS last_processed,
  CAST(count(*) AS INT) AS fy_count, 'success' AS status, CAST(NULL AS STRING) AS error_message, '' AS fields_missing
  FROM {orders} GROUP BY 1
  UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), NULL, NULL, CAST(s_nationkey AS INT), 'success', NULL, '' FROM {supplier}"""
RUNS = """SELECT CAST(c_custkey AS STRING) AS ticker, c_acctbal > 5000 AS scraped, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'success' END AS status,
  CAST(c_nationkey AS INT) AS fy_count, CASE WHEN c_acctbal < 0 THEN {repeat}('balance below zero; ', 40) END AS error_message,
  c_mktsegment AS segment FROM {customer}"""


@query(f"""WITH o AS ({duck(RUN_RECORDS)}), r AS ({duck(RUNS.replace("{repeat}", "repeat"))})
SELECT r.ticker, CASE WHEN r.status = 'error' OR (NOT scraped AND o.ticker IS NOT NULL) THEN o.last_downloaded ELSE TIMESTAMP '2002-03-15 00:00:00' END AS last_downloaded,
  CASE WHEN r.status = 'error' THEN 0 ELSE r.fy_count END AS fy_count, r.status, length(r.error_message[1:500]) AS message_length,
  CASE WHEN r.status <> 'error' THEN r.segment || ',x' END AS fields_missing
FROM r LEFT JOIN o USING (ticker)
UNION ALL SELECT ticker, last_downloaded, fy_count, status, NULL, fields_missing FROM o WHERE ticker NOT IN (SELECT ticker FROM r)""")
def run_metadata(spark, sf_dir):
    runs = spark_sql(spark, sf_dir, RUNS.replace("{repeat}", "repeat")).withColumn(
        "fields_missing", F.array("segment", F.lit("x")))
    merged = state.merge_run_metadata(spark_sql(spark, sf_dir, RUN_RECORDS), runs, NOW, message_length=500)
    return merged.select("ticker", "last_downloaded", "fy_count", "status",
                         F.length("error_message").cast("bigint").alias("message_length"), "fields_missing")


OLD_META = """SELECT CAST(c_custkey AS STRING) AS slug, c_name AS name, c_mktsegment AS confidence, CAST(c_nationkey AS INT) AS fy_count, c_acctbal AS fx_rate_usd
  FROM {customer} WHERE c_nationkey < 15"""
NEW_META = """SELECT CAST(c_custkey AS STRING) AS slug, CASE WHEN c_acctbal > 0 THEN upper(c_name) ELSE '' END AS name, CAST(NULL AS STRING) AS confidence,
  CAST(c_nationkey - 10 AS INT) AS fy_count, c_acctbal + 1 AS fx_rate_usd FROM {customer} WHERE c_nationkey >= 10"""


@query(f"""SELECT coalesce(n.slug, o.slug) AS slug, coalesce(nullif(n.name, ''), o.name) AS name, coalesce(n.confidence, o.confidence) AS confidence,
  coalesce(nullif(n.fy_count, 0), o.fy_count) AS fy_count, coalesce(nullif(n.fx_rate_usd, 0), o.fx_rate_usd) AS fx_rate_usd
FROM ({duck(OLD_META)}) o FULL JOIN ({duck(NEW_META)}) n ON n.slug = o.slug""")
def company_meta_merge(spark, sf_dir):
    return state.merge_company_meta(spark_sql(spark, sf_dir, OLD_META), spark_sql(spark, sf_dir, NEW_META))


# Corrections: one form field per order line; the confirmed value differs on discounted lines.
CORRECTIONS = """SELECT CAST(l_orderkey AS STRING) AS slug, CAST(year(max(l_shipdate)) AS INT) AS fiscal_year,
  CASE l_linenumber WHEN 1 THEN 'ingresos' WHEN 2 THEN 'cogs' WHEN 3 THEN 'utilidad_neta' WHEN 4 THEN 'total_activos' WHEN 5 THEN 'patrimonio'
    WHEN 6 THEN 'efectivo' ELSE 'cartera' END AS field,
  max(l_extendedprice) * 1e5 AS original, CASE WHEN max(l_discount) > 0.03 THEN max(l_extendedprice) / 1e4 + max(l_discount) ELSE max(l_extendedprice) * 1e5 / 1e9 END AS corrected_bn,
  CASE WHEN max(l_tax) > 0.07 THEN 'Baja' ELSE 'Alta' END AS field_confidence FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
BLOCKED = f"SELECT * FROM ({duck(CORRECTIONS)}) WHERE field_confidence = 'Baja' AND original <> 0 AND abs(corrected_bn - original / 1e9) < 0.0005"


@query(f"SELECT slug, fiscal_year, field FROM ({BLOCKED})")
def blocked_corrections(spark, sf_dir):
    return state.unedited_low_confidence(spark_sql(spark, sf_dir, CORRECTIONS)).select("slug", "fiscal_year", "field")


@query(f"SELECT slug, fiscal_year, field, original / 1e9 AS original_mmm, corrected_bn AS corrected_mmm FROM ({duck(CORRECTIONS)}) WHERE abs(corrected_bn - original / 1e9) > 0.0005")
def changed_fields(spark, sf_dir):
    return state.changed_fields(spark_sql(spark, sf_dir, CORRECTIONS))


@query(f"""SELECT slug, fiscal_year, bool_or(abs(corrected_bn - original / 1e9) > 0.0005) AS human_validated,
  count(*) FILTER (abs(corrected_bn - original / 1e9) > 0.0005) AS n_changed FROM ({duck(CORRECTIONS)}) GROUP BY 1, 2""")
def correction_audit(spark, sf_dir):
    audit = state.correction_audit(spark_sql(spark, sf_dir, CORRECTIONS), NOW)
    return audit.select("slug", "fiscal_year", "human_validated", F.size("human_validated_fields").cast("bigint").alias("n_changed"))


@query(f"""WITH c AS ({duck(CORRECTIONS)}), b AS (SELECT DISTINCT slug, fiscal_year FROM ({BLOCKED}))
SELECT slug AS ticker, fiscal_year, CASE field WHEN 'ingresos' THEN 'revenue' WHEN 'cogs' THEN 'cogs' WHEN 'utilidad_neta' THEN 'net_income'
  WHEN 'total_activos' THEN 'total_assets' WHEN 'patrimonio' THEN 'total_equity' WHEN 'efectivo' THEN 'cash' ELSE 'receivables' END AS canonical,
  corrected_bn * 1e9 AS value FROM c ANTI JOIN b USING (slug, fiscal_year)""")
def corrected_values(spark, sf_dir):
    return state.corrected_values(state.confirmable(spark_sql(spark, sf_dir, CORRECTIONS)))


EXTRACTED = """SELECT CAST(l_orderkey AS STRING) AS ticker, l_linenumber AS fiscal_year, 'revenue' AS canonical,
  CASE WHEN max(l_returnflag) = 'R' THEN NULL WHEN max(l_linestatus) = 'F' THEN 0e0 ELSE max(l_extendedprice) * 1.371377e6 END AS value FROM {lineitem} GROUP BY 1, 2"""
KEPT = """SELECT CAST(o_orderkey AS STRING) AS ticker, CAST(month(o_orderdate) AS INT) AS fiscal_year, 'revenue' AS canonical, o_totalprice * 1.371377e5 AS value FROM {orders}"""


@query(f"""SELECT e.ticker, e.fiscal_year, e.canonical, CAST(format('{{:.3f}}', CASE WHEN coalesce(e.value, 0) = 0 AND k.value IS NOT NULL THEN k.value ELSE coalesce(e.value, 0) END / 1e9) AS DOUBLE) AS value_bn
FROM ({duck(EXTRACTED)}) e LEFT JOIN ({duck(KEPT)}) k USING (ticker, fiscal_year, canonical)""")
def form_defaults(spark, sf_dir):
    return state.form_defaults(spark_sql(spark, sf_dir, EXTRACTED), spark_sql(spark, sf_dir, KEPT))


@query(f"""WITH fin AS ({FIN}) SELECT ticker, fiscal_year, {", ".join(f"abs(coalesce({c}, 0e0)) AS {d}" for c, d in fixed.DISPLAY_NAMES.items())} FROM fin""")
def edit_view(spark, sf_dir):
    return state.edit_view(financials(spark, sf_dir))


DAILY = """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'BRL' WHEN '2-HIGH' THEN 'MXN' WHEN '3-MEDIUM' THEN 'COP' ELSE 'ARS' END AS currency,
  o_orderdate AS day, o_totalprice / 1e6 AS rate FROM {orders}"""
AMOUNTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS amount, CASE l_returnflag WHEN 'R' THEN 'USD' WHEN 'A' THEN 'BRL' ELSE
  CASE l_linestatus WHEN 'F' THEN 'ARS' ELSE 'CLP' END END AS currency, CAST(year(l_shipdate) AS INT) AS fiscal_year FROM {lineitem}"""
RATES = f"rates AS (SELECT currency, CAST(year(day) AS INT) AS year, avg(rate) AS rate FROM ({duck(DAILY)}) GROUP BY 1, 2)"


@query(f"WITH {RATES} SELECT currency, year, round(rate, 9) AS rate FROM rates")
def annual_fx(spark, sf_dir):
    return fx.annual_rates(spark_sql(spark, sf_dir, DAILY)).select("currency", "year", F.round("rate", 9).alias("rate"))


@query(f"""WITH {RATES} SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.currency,
  round(CASE WHEN a.currency = 'USD' THEN amount ELSE amount * rate END, 4) AS usd, a.currency = 'ARS' AS low_confidence, a.currency IN ('ARS', 'CLP') AS approximated
FROM ({duck(AMOUNTS)}) a LEFT JOIN rates r ON r.currency = a.currency AND r.year = a.fiscal_year""")
def amounts_in_usd(spark, sf_dir):
    rates = fx.annual_rates(spark_sql(spark, sf_dir, DAILY))
    out = fx.to_usd(spark_sql(spark, sf_dir, AMOUNTS), rates)
    currency = F.col("currency")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "currency", F.round("usd", 4).alias("usd"),
        fx.is_low_confidence(currency).alias("low_confidence"), fx.is_approximated(currency).alias("approximated"))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) + 21 BETWEEN 2018 AND 2020 THEN year(o_orderdate) + 21 ELSE 2018 END::INT AS file_year,
  (year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 2 END)::INT AS default_year FROM orders""")
def report_years(spark, sf_dir):
    name = F.concat(F.lit("informe_"), (F.year("o_orderdate") + 21).cast("string"), F.lit("_2019.pdf"))
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", year_of_file(name, "2020-02-01").cast("int").alias("file_year"),
        default_report_year(F.col("o_orderdate")).cast("int").alias("default_year"))


@query(f"""WITH fin AS ({FIN}) SELECT ticker, sum(CASE WHEN revenue IS NULL OR revenue = 0 OR total_assets IS NULL OR total_assets = 0 THEN 1 ELSE 0 END)::BIGINT AS low_years,
  count(*) AS years FROM fin GROUP BY 1""")
def key_field_gate(spark, sf_dir):
    low = state.lacks_key_field(F.col("revenue"), F.col("total_assets"))
    return financials(spark, sf_dir).groupBy("ticker").agg(F.count_if(low).alias("low_years"), F.count(F.lit(1)).alias("years"))
