"""Statements read off reports: cell tables, text lines and scans derived from order lines and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import labels as label_ops, statements
from ledgerline.plans import jobs
from ledgerline.schema import STATEMENT_FIELDS
from workload.inputs import duck, financials, load, spark_sql
from workload.labels import mapping_ctes, number_sql
from workload.ratios import FIN, KPI_STEPS, REPAIRED
from workload.registry import query

# Report = supplier, a page for every thousand orders, a table per order, a row per line.
CELLS = """
SELECT CAST(l_suppkey AS STRING) AS doc, 'CO' AS country, 1998 AS fiscal_year, CAST(floor(l_orderkey / 1000) AS BIGINT) AS page,
  l_orderkey AS table_no, l_partkey * 10 + l_linenumber AS row_no,
  CASE WHEN l_quantity >= 48 AND l_returnflag = 'R' THEN {list}('Concepto', '1998', '1997', 'Var')
       WHEN l_quantity >= 48 AND l_returnflag = 'A' THEN {list}('', 'dic-97', 'dic 98')
       WHEN l_quantity >= 48 THEN {list}('Concepto', 'Nota', '1998')
       WHEN l_linenumber = 6 THEN {list}('', 'Cuentas por cobrar', {amount})
       ELSE {list}(
         CASE l_linenumber WHEN 1 THEN 'Ingresos operacionales' WHEN 2 THEN 'Costo de ventas (nota 4)' WHEN 3 THEN 'Total activos corrientes'
           WHEN 4 THEN 'Utilidad neta' WHEN 5 THEN 'Partidas varias' ELSE 'Caja' END,
         CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN '' WHEN l_tax < 0.01 THEN {amount} || ' *' ELSE '(' || {amount} || ')' END,
         CASE WHEN l_tax < 0.06 THEN {quantity} END)
  END AS cells
FROM {lineitem}
"""
CELL_PAGES = """
SELECT CAST(l_suppkey AS STRING) AS doc, 'CO' AS country, 1998 AS fiscal_year, CAST(floor(l_orderkey / 1000) AS BIGINT) AS page,
  CASE max(l_linenumber + l_quantity) WHEN 57 THEN 'ESTADO DE RESULTADOS y notas' WHEN 56 THEN 'Notas' ELSE 'Balance General' END AS text, 0 AS n_images
FROM {lineitem} GROUP BY CAST(l_suppkey AS STRING), CAST(floor(l_orderkey / 1000) AS BIGINT)
"""


def _both(sql: str) -> tuple[str, str]:
    """The Spark and the check form of a text with amounts and lists."""
    spark = sql.replace("{list}", "array").replace(
        "{amount}", "replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',')").replace(
        "{quantity}", "translate(format_number(l_quantity * 1000, 0), ',', '.')").replace(
        "{total}", "translate(format_number(o_totalprice, 2), ',.', '.,')").replace("{nl}", "'\\n'").replace("{tab}", "'\\t'")
    check = sql.replace("{list}", "list_value").replace(
        "{amount}", "replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',')").replace(
        "{quantity}", "translate(format('{{:,.0f}}', l_quantity * 1000), ',', '.')").replace(
        "{total}", "translate(format('{{:,.2f}}', o_totalprice), ',.', '.,')").replace("{nl}", "chr(10)").replace("{tab}", "chr(9)")
    return spark, duck(check)


CELLS_SPARK, CELLS_DUCK = _both(CELLS)
CELL_PAGES_DUCK = duck(CELL_PAGES)


def section_sql(text: str) -> str:
    low = f"lower({text})"
    return f"""CASE WHEN contains({low}, 'estado de situacion financiera') OR contains({low}, 'estado de situación financiera') OR contains({low}, 'balance general') THEN 'balance'
      WHEN contains({low}, 'estado de resultados') OR contains({low}, 'estado de ganancias y perdidas') OR contains({low}, 'estado de ganancias y pérdidas') OR contains({low}, 'estado de resultado integral') THEN 'income'
      WHEN contains({low}, 'estado de flujos de efectivo') OR contains({low}, 'estado de flujo de efectivo') OR contains({low}, 'flujos de caja') THEN 'cashflow' END"""


def sections_cte(pages: str) -> str:
    return f"""sections AS (SELECT doc, page, coalesce(last_value({section_sql("text")} IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page), 'unknown') AS section
  FROM ({pages}))"""


def _year_at(year: str, short: str) -> str:
    hit = f"(contains(coalesce(c, ''), '{year}') OR regexp_matches(coalesce(c, ''), '[-\\s]{short}\\b'))"
    return f"(nullif(list_position(list_transform(cells, lambda c: {hit}), true), 0) - 1)"


def _amount(cell: str) -> str:
    return number_sql(f"regexp_replace(trim({cell}), '[^0-9.,)(\\-]+$', '')")


CELL_ROWS_CTES = f"""
raw AS ({CELLS_DUCK}),
h AS (SELECT *, len(list_filter(cells[2:], lambda c: NOT (c IS NULL OR regexp_full_match(trim(c), '[0-9]{{4}}')
    OR coalesce({number_sql("c")}, 0) = 0))) = 0 AS is_header FROM raw),
a AS (SELECT *, CASE WHEN is_header THEN {_year_at("1998", "98")} END AS hit, CASE WHEN is_header THEN {_year_at("1997", "97")} END AS hit_before FROM h),
b AS (SELECT *, last_value(hit IGNORE NULLS) OVER w AS yc, last_value(CASE WHEN hit IS NOT NULL AND hit <> hit_before THEN hit_before END IGNORE NULLS) OVER w AS pc
  FROM a WINDOW w AS (PARTITION BY doc ORDER BY page, table_no, row_no ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, trim(CASE WHEN trim(coalesce(cells[1], '')) <> '' THEN cells[1] WHEN coalesce({number_sql("cells[2]")}, 0) = 0 THEN cells[2] END) AS label,
   cells[CAST(yc AS INT) + 1] AS own, CASE WHEN yc > 0 THEN cells[CAST(yc AS INT)] END AS at_left, cells[CAST(pc AS INT) + 1] AS prior
  FROM b WHERE NOT is_header),
v AS (SELECT doc, country, page, table_no, row_no, label, coalesce(CASE WHEN yc < len(cells) THEN coalesce({_amount("own")}, {_amount("at_left")}) END,
     list_filter(list_transform(cells[2:], lambda c: {number_sql("c")}), lambda x: x IS NOT NULL)[-1]) AS value,
   CASE WHEN pc < len(cells) THEN {_amount("prior")} END AS value_before FROM d),
cell_rows AS (SELECT * FROM v WHERE value IS NOT NULL AND length(label) >= 4)
"""


def cells(spark, sf_dir):
    return spark_sql(spark, sf_dir, CELLS_SPARK)


def cell_pages(spark, sf_dir):
    return spark_sql(spark, sf_dir, CELL_PAGES)


@query(f"WITH {CELL_ROWS_CTES} SELECT doc, page, table_no, row_no, label, value, value_before FROM cell_rows")
def cell_rows(spark, sf_dir):
    return statements.cell_rows(cells(spark, sf_dir)).drop("country", "fiscal_year")


CELL_VALUES_CTES = f"""{CELL_ROWS_CTES}, {mapping_ctes("SELECT label FROM cell_rows")}, {sections_cte(CELL_PAGES_DUCK)},
cm AS (SELECT r.*, m.canonical, coalesce(s.section, 'unknown') AS section, row_number() OVER (PARTITION BY r.doc, m.canonical ORDER BY r.page, table_no, row_no) AS rk,
    row_number() OVER (PARTITION BY r.doc, m.canonical, value_before IS NULL ORDER BY r.page, table_no, row_no) AS pk
  FROM cell_rows r LEFT JOIN mapped m USING (label) LEFT JOIN sections s ON s.doc = r.doc AND s.page = r.page),
cell_values AS (
  SELECT doc, 1998 AS fiscal_year, canonical, value, page, section, false AS comparative FROM cm WHERE canonical IS NOT NULL AND rk = 1
  UNION ALL SELECT doc, 1997, canonical, value_before, page, section, true FROM cm WHERE canonical IS NOT NULL AND value_before IS NOT NULL AND pk = 1)"""


@query(f"WITH {CELL_VALUES_CTES} SELECT * FROM cell_values")
def cell_statements(spark, sf_dir):
    return statements.extract_cells(cells(spark, sf_dir), cell_pages(spark, sf_dir)).values.drop("country", "method")


@query(f"WITH {CELL_VALUES_CTES} SELECT doc, sum(n)::BIGINT AS n_rows, count(*) AS n_labels FROM (SELECT doc, label, count(*) AS n FROM cm WHERE canonical IS NULL GROUP BY 1, 2) GROUP BY 1")
def unmatched_labels(spark, sf_dir):
    return statements.unmatched_counts(statements.extract_cells(cells(spark, sf_dir)).unmatched)


@query(f"""WITH {CELL_VALUES_CTES}, s AS (SELECT doc, fiscal_year, list(canonical) AS found FROM cell_values GROUP BY 1, 2)
SELECT doc, fiscal_year, CAST(len(found) AS INT) AS n_fields, len(found) / 22e0 AS coverage,
  array_to_string(list_filter(['operating_cash_flow', 'revenue', 'total_assets', 'total_equity', 'total_liabilities'], lambda c: NOT list_contains(found, c)), ',') AS critical_missing,
  CASE WHEN list_has_all(found, ['operating_cash_flow', 'revenue', 'total_assets', 'total_equity', 'total_liabilities'])
       THEN CASE WHEN len(found) >= 15 THEN 'Alta' ELSE 'Media' END WHEN len(found) >= 8 THEN 'Media' ELSE 'Baja' END AS confidence FROM s""")
def extraction_confidence(spark, sf_dir):
    values = statements.extract_cells(cells(spark, sf_dir)).values
    return label_ops.score_extractions(values).select(
        "doc", "fiscal_year", "n_fields", "coverage", F.array_join("critical_missing", ",").alias("critical_missing"), "confidence")


@query(f"WITH raw AS ({CELLS_DUCK}) SELECT doc, count(*) AS n_warnings FROM raw WHERE cells[2] IN ('1998') OR cells[2] LIKE 'dic%98' GROUP BY 1")
def year_column_warnings(spark, sf_dir):
    return statements.fallback_columns(cells(spark, sf_dir)).drop("warning")


@query(f"WITH {sections_cte(CELL_PAGES_DUCK)} SELECT * FROM sections")
def page_sections(spark, sf_dir):
    return statements.page_sections(cell_pages(spark, sf_dir))


# --- text lines: report = customer, page = order ----------------------------------------------------

LINES = """
SELECT CAST(o_custkey AS STRING) AS doc, 'PE' AS country, CAST(year(o_orderdate) AS INT) AS y, 2001 AS fiscal_year, o_orderkey AS page,
  CASE o_orderstatus WHEN 'F' THEN 'Estado de Ganancias y Pérdidas' WHEN 'O' THEN 'Estado de Flujos de Efectivo' ELSE 'Notas' END || {nl} ||
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Ventas netas' WHEN '2-HIGH' THEN 'Gastos financieros netos' WHEN '3-MEDIUM' THEN 'Total pasivos y patrimonio'
    WHEN '4-NOT SPECIFIED' THEN 'Imprevistos del mes' ELSE 'Actividades de operación' END || '   ' || {total} || '  n.a.' || {nl} ||
  'Deudores' || {tab} || '(' || CAST(o_orderkey AS STRING) || ')' || {nl} || 'sin valor' AS text, 0 AS n_images
FROM {orders}
"""
LINES_SPARK, LINES_DUCK = _both(LINES)


def line_rows_ctes(pages: str) -> str:
    return f"""
lp AS (SELECT doc, page, text, unnest(split(text, chr(10))) AS raw, generate_subscripts(split(text, chr(10)), 1) - 1 AS line FROM ({pages})),
ls AS (SELECT doc, page, line, regexp_split_to_array(trim(raw), '\\s\\s+|\\t') AS parts FROM lp),
line_rows AS (SELECT doc, page, line, trim(parts[1]) AS label, list_filter(list_transform(parts[2:], lambda c: {number_sql("c")}), lambda x: x IS NOT NULL)[-1] AS value
  FROM ls WHERE len(parts) >= 2),
lr AS (SELECT * FROM line_rows WHERE value IS NOT NULL AND length(label) >= 4)
"""


LINE_ROWS_CTES = line_rows_ctes(LINES_DUCK)
LINE_VALUES_CTES = f"""{LINE_ROWS_CTES}, {mapping_ctes("SELECT label FROM lr")}, {sections_cte(LINES_DUCK)},
lm AS (SELECT lr.*, m.canonical, s.section, row_number() OVER (PARTITION BY lr.doc, canonical ORDER BY lr.page, line) AS rk
  FROM lr LEFT JOIN mapped m USING (label) JOIN sections s ON s.doc = lr.doc AND s.page = lr.page),
line_values AS (SELECT doc, canonical, value, page, section FROM lm WHERE canonical IS NOT NULL AND rk = 1)"""


def line_pages(spark, sf_dir):
    return spark_sql(spark, sf_dir, LINES_SPARK)


@query(f"WITH {LINE_VALUES_CTES} SELECT * FROM line_values")
def line_statements(spark, sf_dir):
    return statements.extract_lines(line_pages(spark, sf_dir)).values.select("doc", "canonical", "value", "page", "section")


# --- scans: report = order, two pages ---------------------------------------------------------------

SCANS = """
SELECT CAST(o_orderkey AS STRING) AS doc, 'CL' AS country, 2015 AS fiscal_year, 1 AS page,
  'Estado de Resultados ' || CAST(year(o_orderdate) + 17 AS STRING) || {nl} ||
  CASE o_orderstatus WHEN 'F' THEN 'Cuenta ' || CAST(year(o_orderdate) + 17 AS STRING) || ' ' || CAST(year(o_orderdate) + 16 AS STRING)
    WHEN 'O' THEN 'Cuenta ' || CAST(year(o_orderdate) + 16 AS STRING) || ' ' || CAST(year(o_orderdate) + 17 AS STRING) ELSE '' END || {nl} ||
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Ventas netas [Nota 3]' WHEN '2-HIGH' THEN 'Efectivo' WHEN '3-MEDIUM' THEN 'Total activos no corrientes'
    WHEN '4-NOT SPECIFIED' THEN 'Imprevistos del mes' ELSE 'Utilidad del ejercicio' END || ' $' || {total} || '  1.234.500' || {nl} ||
  'Ventas  5.000.' || substring(CAST(1000 + month(o_orderdate) AS STRING), 2, 3) AS text, 1 AS n_images
FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 'CL', 2015, 2, 'Balance General' || {nl} || 'Efectivo y equivalentes al efectivo  ' || {total} || '  ' || {total}, 0
FROM {orders}
"""
SCANS_SPARK, SCANS_DUCK = _both(SCANS)
MONEY = r"[-–]?\$?\s*\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?|[-–]?\$?\s*\d{1,3}(?:,\d{3})+(?:\.\d{1,3})?"


def scan_rows_ctes(pages: str) -> str:
    return f"""
sp AS ({pages}),
y1 AS (SELECT doc, list_reverse_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b(20[12][0-9])\\b', 1), lambda s: CAST(s AS INT)))) AS ys,
   split(text, chr(10))[2] AS heads FROM sp WHERE page = 1),
yy AS (SELECT doc, ys[1] AS y, CASE WHEN len(ys) > 1 THEN ys[2] ELSE ys[1] - 1 END AS y0,
   len(ys) > 1 AND strpos(heads, CAST(ys[1] AS STRING)) < strpos(heads, CAST(ys[2] AS STRING)) AS is_left FROM y1),
sl AS (SELECT doc, page, unnest(split(text, chr(10))) AS raw, generate_subscripts(split(text, chr(10)), 1) - 1 AS line FROM sp),
sm AS (SELECT sl.*, y, y0, is_left, regexp_extract_all(trim(raw), '{MONEY}') AS money FROM sl JOIN yy USING (doc)),
sv AS (SELECT doc, page, line, y, y0, is_left, trim(regexp_replace(trim(split_part(raw, money[1], 1)), '\\s*[\\[(].*$', '')) AS label,
   {number_sql("replace(money[1], '$', '')")} AS a, {number_sql("replace(money[2], '$', '')")} AS b FROM sm WHERE len(money) > 0),
sw AS (SELECT doc, page, line, y, y0, label, CASE WHEN is_left OR b IS NULL OR b = a THEN a ELSE b END AS value,
   CASE WHEN b <> a THEN CASE WHEN is_left THEN b ELSE a END END AS value_before
  FROM sv WHERE length(label) >= 4 AND NOT contains(lower(label), 'no corriente'))
"""


SX_CTE = """
sx AS (SELECT sw.*, canonical, row_number() OVER (PARTITION BY doc, canonical ORDER BY abs(value) DESC, page, line) AS rk,
   row_number() OVER (PARTITION BY doc, canonical ORDER BY abs(value_before) DESC NULLS LAST, page, line) AS pk
  FROM sw JOIN mapped USING (label) WHERE canonical IS NOT NULL)
"""
SCAN_CTES = f"{scan_rows_ctes(SCANS_DUCK)}, {mapping_ctes('SELECT label FROM sw')}, {SX_CTE}"


@query(f"""WITH {SCAN_CTES} SELECT doc, y AS fiscal_year, canonical, value, page, CASE page WHEN 1 THEN 'income' ELSE 'balance' END AS section, false AS comparative FROM sx WHERE rk = 1
UNION ALL SELECT doc, y0, canonical, value_before, page, CASE page WHEN 1 THEN 'income' ELSE 'balance' END, true FROM sx WHERE pk = 1 AND value_before IS NOT NULL""")
def scan_statements(spark, sf_dir):
    found = statements.extract_scans(spark_sql(spark, sf_dir, SCANS_SPARK), "2024-01-01")
    return found.values.drop("country", "method")


@query(f"""SELECT doc, count(*) AS n_pages, count(*) FILTER (length(trim(text)) < 50 AND n_images > 0) AS n_scanned,
  count(*) FILTER (length(trim(text)) < 50 AND n_images > 0) > count(*) * 0.5 AS is_scanned FROM (
  SELECT source AS doc, text, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS n_images FROM documents
  UNION ALL SELECT 'turns-' || CAST(conv_id AS STRING), text, CASE WHEN role = 'user' THEN 2 ELSE 1 END FROM conversations) GROUP BY 1""")
def scanned_reports(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.col("source").alias("doc"), "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("n_images"))
    turns = load(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turns-"), "conv_id").alias("doc"), "text", F.when(F.col("role") == "user", 2).otherwise(1).alias("n_images"))
    return statements.scanned_docs(docs.unionByName(turns))


# --- whole reports: cells, text pages and scans together --------------------------------------------

# Suppliers' reports have cells, those whose number is a customer's also text pages; every order is a report of two
# recognised pages. Each seventh of these has its text as well and so is no scan.
REPORT_PAGES = """
SELECT doc, country, 1998 AS fiscal_year, page, text, CAST(NULL AS STRING) AS recognised, n_images FROM ({lines_pages}) line_pages
UNION ALL SELECT 'scan-' || doc, country, 1998, CAST(page AS BIGINT), CASE WHEN CAST(doc AS BIGINT) % 7 = 0 THEN text ELSE '' END, text, 1 FROM ({scan_pages}) scan_pages
"""
REPORT_PAGES_SPARK = REPORT_PAGES.replace("{lines_pages}", LINES_SPARK).replace("{scan_pages}", SCANS_SPARK)
REPORT_PAGES_DUCK = REPORT_PAGES.replace("{lines_pages}", LINES_DUCK).replace("{scan_pages}", SCANS_DUCK)

READING_CTES = f"""{CELL_ROWS_CTES}, rp AS MATERIALIZED ({REPORT_PAGES_DUCK}),
dk AS (SELECT doc, count(*) FILTER (length(trim(text)) < 50 AND n_images > 0) > count(*) * 0.5 AS is_scanned FROM rp GROUP BY 1),
{line_rows_ctes("SELECT doc, page, text FROM rp JOIN dk USING (doc) WHERE NOT is_scanned")},
{scan_rows_ctes("SELECT doc, page, recognised AS text FROM rp JOIN dk USING (doc) WHERE is_scanned")},
{mapping_ctes("SELECT label FROM cell_rows UNION SELECT label FROM lr UNION SELECT label FROM sw")},
cc AS (SELECT r.*, canonical, row_number() OVER (PARTITION BY doc, canonical ORDER BY page, table_no, row_no) AS rk,
    row_number() OVER (PARTITION BY doc, canonical, value_before IS NULL ORDER BY page, table_no, row_no) AS pk
  FROM cell_rows r JOIN mapped USING (label) WHERE canonical IS NOT NULL),
ll AS (SELECT lr.*, canonical, row_number() OVER (PARTITION BY doc, canonical ORDER BY page, line) AS rk FROM lr JOIN mapped USING (label) WHERE canonical IS NOT NULL),
{SX_CTE},
nc AS (SELECT doc, count(*) AS n_cells FROM cc WHERE rk = 1 GROUP BY 1),
nl AS (SELECT doc, count(*) AS n_lines FROM ll WHERE rk = 1 GROUP BY 1),
ch AS (SELECT doc, coalesce(n_cells, 0) / 22e0 < 0.4 AND coalesce(n_lines, 0) > coalesce(n_cells, 0) AS use_text FROM nc FULL JOIN nl USING (doc)),
picked AS (
  SELECT doc, 1998 AS fiscal_year, canonical, value, page, 'cell_table' AS method, false AS comparative FROM cc JOIN ch USING (doc) WHERE rk = 1 AND NOT use_text
  UNION ALL SELECT doc, 1997, canonical, value_before, page, 'cell_table', true FROM cc WHERE pk = 1 AND value_before IS NOT NULL
  UNION ALL SELECT doc, 1998, canonical, value, page, 'text_lines', false FROM ll JOIN ch USING (doc) WHERE rk = 1 AND use_text
  UNION ALL SELECT doc, y, canonical, value, page, 'scan_lines', false FROM sx WHERE rk = 1
  UNION ALL SELECT doc, y0, canonical, value_before, page, 'scan_lines', true FROM sx WHERE pk = 1 AND value_before IS NOT NULL)"""
HEADS_CTE = f"""hd AS (SELECT DISTINCT doc, page, {section_sql("coalesce(recognised, text)")} AS section FROM rp WHERE section IS NOT NULL)"""


def report_pages(spark, sf_dir):
    return spark_sql(spark, sf_dir, REPORT_PAGES_SPARK)


@query(f"""WITH {READING_CTES}, {HEADS_CTE},
sections AS (SELECT p.doc, p.page, (CASE WHEN p.page >= h.page THEN h.section END) AS section FROM (SELECT DISTINCT doc, page FROM picked) p ASOF LEFT JOIN hd h ON p.doc = h.doc AND p.page >= h.page),
known AS (SELECT DISTINCT doc, CAST(floor(page / 64) AS BIGINT) AS block FROM rp)
SELECT k.doc, k.fiscal_year, k.canonical, k.value, k.page, k.method, k.comparative, CASE WHEN b.doc IS NULL THEN 'unknown' ELSE coalesce(s.section, 'unknown') END AS section
FROM picked k JOIN sections s ON s.doc = k.doc AND s.page = k.page LEFT JOIN known b ON b.doc = k.doc AND b.block = CAST(floor(k.page / 64) AS BIGINT)""")
def report_reading(spark, sf_dir):
    """Every report by the reading that suits it: scans, cells, or the text where cells hold little."""
    found = statements.read_reports(cells(spark, sf_dir), report_pages(spark, sf_dir), "2024-01-01")
    return found.values.drop("country")


CHOICE_CTES = f"""{CELL_ROWS_CTES}, {LINE_ROWS_CTES}, {mapping_ctes("SELECT label FROM cell_rows UNION SELECT label FROM lr")},
cc AS (SELECT doc, count(DISTINCT canonical) AS n_cells, count(DISTINCT CASE WHEN value_before IS NOT NULL THEN canonical END) AS n_before FROM cell_rows JOIN mapped USING (label) GROUP BY 1),
ll AS (SELECT doc, count(DISTINCT canonical) AS n_lines FROM lr JOIN mapped USING (label) GROUP BY 1),
ch AS (SELECT doc, coalesce(n_cells, 0) AS n_cells, coalesce(n_before, 0) AS n_before, coalesce(n_lines, 0) AS n_lines FROM cc FULL JOIN ll USING (doc))"""


@query(f"""WITH {CHOICE_CTES} SELECT doc, n_lines > n_cells AND n_cells / 22e0 < 0.4 AS by_text,
  n_before + CASE WHEN n_lines > n_cells AND n_cells / 22e0 < 0.4 THEN n_lines ELSE n_cells END AS n_values FROM ch WHERE n_cells + n_lines > 0""")
def reading_choice(spark, sf_dir):
    """The cell reading and the text reading of every report, and what is taken of them."""
    in_cells, pages = cells(spark, sf_dir), line_pages(spark, sf_dir)
    chosen = statements.choose_reading(statements.extract_cells(in_cells).values, statements.extract_lines(pages).values,
                                       in_cells.select("doc").unionByName(pages.select("doc")))
    return chosen.groupBy("doc").agg(F.bool_or(F.col("method") == "text_lines").alias("by_text"), F.count(F.lit(1)).alias("n_values"))


# Several reports of a company: their order is drawn from their number, so that years clash in every order.
REPORT_TICKER = "CAST(CAST({number} AS BIGINT) % 1000 + 1 AS STRING)"
NUMBER = "regexp_extract(doc, '[0-9]+', 0)"
NEW_FIELDS = ", ".join(f"max(CASE WHEN canonical = '{f}' THEN value END) AS {f}" for f in STATEMENT_FIELDS)


@query(f"""WITH {READING_CTES}, all_fin AS ({FIN}),
rd AS (SELECT doc, fiscal_year, canonical, value FROM picked
  UNION ALL SELECT DISTINCT doc, 1998, NULL, NULL FROM dk WHERE NOT is_scanned UNION ALL SELECT doc, coalesce(y, 2023), NULL, NULL FROM dk LEFT JOIN yy USING (doc) WHERE is_scanned),
ro AS (SELECT *, {REPORT_TICKER.format(number=NUMBER)} AS ticker, CAST({NUMBER} AS BIGINT) * 7919 % 1009 AS report_order FROM rd),
per AS (SELECT ticker, fiscal_year, report_order, doc, {NEW_FIELDS} FROM ro GROUP BY ALL),
new AS (SELECT * EXCLUDE (report_order, doc) FROM per QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY report_order DESC, doc DESC) = 1),
fin AS (SELECT * FROM new UNION ALL BY NAME SELECT * FROM all_fin WHERE (ticker, fiscal_year) NOT IN (SELECT (ticker, fiscal_year) FROM new))
{REPAIRED}""")
def report_financials(spark, sf_dir):
    """Reports of all kinds, several for a company and year, into the stored financials."""
    own, pages = cells(spark, sf_dir), report_pages(spark, sf_dir)
    docs = own.select("doc").unionByName(pages.select("doc")).distinct()
    number = F.expr(NUMBER.replace("'[0-9]+'", "'([0-9]+)'").replace(", 0)", ", 1)")).cast("bigint")
    reports = docs.select("doc", (number % 1000 + 1).cast("string").alias("ticker"), (number * 7919 % 1009).alias("report_order"))
    done, _ = jobs.reports_to_financials(financials(spark, sf_dir), own, pages, "2024-01-01", reports=reports)
    return done.financials


# --- report values into stored financials ------------------------------------------------------------

SHARED = ["net_income", "total_assets", "total_liabilities", "total_equity", "gross_profit", "cogs", "operating_income",
          "current_assets", "receivables", "inventory", "accounts_payable"]
NEW_ROWS = f"""
SELECT ticker, fiscal_year, revenue * 2 AS revenue, {", ".join(f if f in SHARED else f"CAST(NULL AS DOUBLE) AS {f}" for f in STATEMENT_FIELDS if f != "revenue")}
FROM all_fin WHERE fiscal_year >= 1999 AND (revenue IS NOT NULL OR net_income IS NOT NULL)
"""


@query(f"""WITH all_fin AS ({FIN}), new AS ({NEW_ROWS}),
merged AS (SELECT * FROM new UNION ALL BY NAME SELECT * FROM all_fin WHERE fiscal_year <= 1999 AND (ticker, fiscal_year) NOT IN (SELECT (ticker, fiscal_year) FROM new)),
fin AS ({REPAIRED.replace("FROM fin", "FROM merged")}), {KPI_STEPS}
SELECT k.ticker, k.fiscal_year, coalesce(k.current_ratio, CASE WHEN k.fiscal_year >= 1999 THEN f.inventory END) AS current_ratio,
  coalesce(k.dso, CASE WHEN k.fiscal_year >= 1999 THEN f.inventory / 2 END) AS dso, k.debt_to_equity, k.gross_profit_margin, k.revenue_growth_yoy
FROM k JOIN all_fin f USING (ticker, fiscal_year)""")
def report_etl(spark, sf_dir):
    """Years from 1999 on come from reports and replace the stored 1999; two printed ratios fill gaps."""
    fin = financials(spark, sf_dir)
    read = fin.filter("fiscal_year >= 1999")
    wide = read.select("ticker", "fiscal_year", (F.col("revenue") * 2).alias("revenue"), *SHARED,
                       F.col("inventory").alias("current_ratio"), (F.col("inventory") / 2).alias("dso"))
    long = wide.unpivot(["ticker", "fiscal_year"], [c for c in wide.columns if c not in ("ticker", "fiscal_year")],
                        "canonical", "value").filter("value IS NOT NULL")
    done = jobs.from_reports(fin.filter("fiscal_year <= 1999"), long)
    return done.kpis.select("ticker", "fiscal_year", "current_ratio", "dso", "debt_to_equity", "gross_profit_margin", "revenue_growth_yoy")
