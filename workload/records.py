"""Records around the statements: files' contents, companies, sites, confirmations, and jobs as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.operators import company, flags, fx, labels as label_ops, links, state, statements, views
from ledgerline.plans import jobs
from ledgerline.sources import readers
from workload.inputs import TABLES, duck, financials, spark_sql
from workload.labels import CANDIDATES_CTES, DECIDED, sightings
from workload.ratios import CARDS, FIN, FLAGS_SQL, KPI_CTES, KPI_STEPS, REPAIRED, kpi_table
from workload.registry import query
from workload.reports import CELL_VALUES_CTES, cell_pages, cells
from workload.state import CORRECTIONS, NOW, BLOCKED

# --- contents of files -------------------------------------------------------------------------------

def _texts(spark, sf_dir, sql: str):
    """Rows of a statement whose texts hold braces of their own: only those around a table's name are marks."""
    escaped = sql.replace("{", "{{").replace("}", "}}")
    for name in TABLES:
        escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
    return spark_sql(spark, sf_dir, escaped)


# A file of facts for each order line, some with two entries, an unreadable day or another section.
FACT_FILES = """SELECT lower('T' || CAST(l_partkey AS STRING)) AS ticker, l_orderkey AS a, l_linenumber AS b, l_suppkey AS c,
  CASE WHEN l_linenumber = 7 THEN 'broken {' ELSE
  '{"entityName": "x", "facts": {"' || CASE WHEN l_linenumber = 6 THEN 'dei' ELSE 'us-gaap' END || '": {"' || CASE l_returnflag WHEN 'R' THEN 'Revenues' ELSE 'Assets' END ||
  '": {"label": "y", "units": {"USD": [{"en' || 'd": "' || substring(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 10) || '", "val": ' || CAST(l_orderkey AS STRING) || ', "fy": 2020, "fp": "FY", "form": "10-K", "filed": "bad"}' ||
  CASE WHEN l_linestatus = 'O' THEN ', {"en' || 'd": "2020-13-45", "val": 2.5e3, "form": "10-Q"}' ELSE '' END || ']}}}}}' END AS json FROM {lineitem}"""


@query("""SELECT 'T' || l_partkey AS ticker, CASE l_returnflag WHEN 'R' THEN 'Revenues' ELSE 'Assets' END AS tag, CAST(pos AS INT) AS pos,
  CASE pos WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day, CASE pos WHEN 0 THEN CAST(l_orderkey AS DOUBLE) ELSE 2500e0 END AS val, count(*) AS n
FROM lineitem, range(2) p(pos) WHERE l_linenumber < 6 AND (pos = 0 OR l_linestatus = 'O') GROUP BY ALL""")
def facts_parsed(spark, sf_dir):
    """The entries of every facts text."""
    rows = readers.parse_facts(_texts(spark, sf_dir, FACT_FILES))
    return rows.groupBy("ticker", "tag", "pos", F.col("end").cast("string").alias("day"), "val").agg(F.count(F.lit(1)).alias("n"))


ID_FILES = """SELECT '{"0": {"cik_str": ' || CAST(s_suppkey AS STRING) || ', "ticker": "s' || CAST(s_suppkey AS STRING) || '", "title": "' || s_name || '"}, "1": {"ticker": "x' ||
  CAST(s_suppkey AS STRING) || '"}}' AS value FROM {supplier}"""


@query("""SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier UNION ALL SELECT 'X' || s_suppkey, NULL FROM supplier""")
def ticker_ids_parsed(spark, sf_dir):
    return readers.parse_ticker_ids(_texts(spark, sf_dir, ID_FILES))


RATE_FILES = """SELECT '{"' || CASE o_orderpriority WHEN '1-URGENT' THEN 'BRL' ELSE 'ARS' END || '_' || CAST(o_orderkey AS STRING) || '": ' || CAST(o_custkey AS STRING) || '.5, "COP_x": 1}' AS value FROM {orders}"""


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'BRL' ELSE 'ARS' END AS currency, CAST(o_orderkey AS INT) AS year, o_custkey + 0.5e0 AS rate, o_orderpriority <> '1-URGENT' AS approximated
FROM orders UNION ALL SELECT 'COP', NULL, 1e0, true FROM orders""")
def rates_parsed(spark, sf_dir):
    return readers.parse_fx(_texts(spark, sf_dir, RATE_FILES))


PROFILE_FILES = """SELECT '{"_about": "' || c_name || '", "c' || CAST(c_custkey AS STRING) || '": {"domain": "' || lower(c_mktsegment) || '.co", "doc_tier": ' || CAST(c_nationkey AS STRING) ||
  ', "nav_path": ["a", "b' || CAST(c_nationkey AS STRING) || '"], "historical_pdfs": {"2020": "u' || CAST(c_custkey AS STRING) || '", "x": "y"}, "unknown": 1}}' AS value FROM {customer}"""


@query("""SELECT 'c' || c_custkey AS slug, lower(c_mktsegment) || '.co' AS domain, CAST(c_nationkey AS INT) AS doc_tier, 'a,b' || c_nationkey AS nav_path, 'u' || c_custkey AS known FROM customer""")
def profiles_parsed(spark, sf_dir):
    found = readers.parse_profiles(_texts(spark, sf_dir, PROFILE_FILES))
    return found.select("slug", "domain", "doc_tier", F.array_join("nav_path", ",").alias("nav_path"), F.try_element_at("historical_pdfs", F.lit(2020)).alias("known"))


# --- companies and sites -----------------------------------------------------------------------------

PROFILES = """SELECT CAST(c_custkey AS STRING) AS slug, {domain} AS domain, CAST(NULL AS STRING) AS last_success, {strategy} AS strategy, {pattern} AS pdf_url_pattern, {path} AS nav_path,
  CAST(c_nationkey AS INT) AS doc_tier, {failed} AS failed_ddgs_queries, {pdfs} AS historical_pdfs, {t2} AS t2_pdfs, CAST(NULL AS STRING) AS notes FROM {customer} WHERE {side}"""
OLD_PROFILES = PROFILES.replace("{domain}", "'old.co'").replace("{strategy}", "'crawl'").replace("{pattern}", "'p*.pdf'").replace("{path}", "array('x')").replace(
    "{failed}", "array('q1', 'q2')").replace("{pdfs}", "map(2020, 'o20', 2021, 'o21')").replace("{t2}", "map(2019, c_name)").replace("{side}", "c_nationkey < 15")
NEW_PROFILES = PROFILES.replace("{domain}", "CASE WHEN c_acctbal > 0 THEN 'new.co' END").replace("{strategy}", "c_mktsegment").replace("{pattern}", "CASE WHEN c_acctbal > 5000 THEN 'n*.pdf' ELSE '' END").replace(
    "{path}", "CASE WHEN c_acctbal > 5000 THEN array('y', 'z') ELSE array() END").replace("{failed}", "array('q2', 'q3')").replace("{pdfs}", "map(2021, 'n21', 2022, 'n22')").replace(
    "{t2}", "CAST(NULL AS MAP<INT, STRING>)").replace("{side}", "c_nationkey >= 10")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS slug, CASE WHEN c_nationkey >= 10 AND c_acctbal > 0 THEN 'new.co' WHEN c_nationkey < 15 THEN 'old.co' END AS domain,
  CASE WHEN c_nationkey >= 10 THEN c_mktsegment ELSE 'crawl' END AS strategy,
  CASE WHEN c_nationkey >= 10 AND c_acctbal > 5000 THEN 'n*.pdf' WHEN c_nationkey < 15 THEN 'p*.pdf' ELSE '' END AS pattern,
  CASE WHEN c_nationkey >= 10 AND c_acctbal > 5000 THEN 'y,z' WHEN c_nationkey < 15 THEN 'x' ELSE '' END AS path,
  CASE WHEN c_nationkey < 10 THEN 'q1,q2' WHEN c_nationkey < 15 THEN 'q1,q2,q3' ELSE 'q2,q3' END AS failed,
  CASE WHEN c_nationkey < 10 THEN '2020=o20,2021=o21' WHEN c_nationkey < 15 THEN '2020=o20,2021=n21,2022=n22' ELSE '2021=n21,2022=n22' END AS known,
  CASE WHEN c_nationkey < 15 THEN c_name END AS report FROM customer""")
def profile_merge(spark, sf_dir):
    """Profiles of two runs merged, and the report address that a profile holds for a year."""
    merged = links.merge_profiles(spark_sql(spark, sf_dir, OLD_PROFILES), spark_sql(spark, sf_dir, NEW_PROFILES))
    entries = F.array_sort(F.transform(F.map_entries("historical_pdfs"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])))
    asked = merged.select("slug", F.lit(2019).alias("fiscal_year"))
    flat = merged.select("slug", "domain", "strategy", F.col("pdf_url_pattern").alias("pattern"), F.array_join("nav_path", ",").alias("path"),
                         F.array_join("failed_ddgs_queries", ",").alias("failed"), F.array_join(entries, ",").alias("known"))
    return flat.join(links.report_url(merged, asked).select("slug", F.col("url").alias("report")), "slug")


NATIONS = "CASE c_nationkey WHEN 0 THEN 'CO' WHEN 1 THEN 'PE' WHEN 2 THEN 'CL' WHEN 3 THEN 'BR' WHEN 4 THEN 'MX' WHEN 5 THEN 'AR' WHEN 6 THEN 'Test' ELSE 'US' END"
COMPANIES = f"""SELECT CAST(c_custkey AS STRING) AS slug, {NATIONS} AS country, CASE WHEN c_acctbal > 0 THEN 'https://' || CAST(c_custkey AS STRING) || '.co' ELSE '' END AS url FROM {{customer}}"""


@query(f"""SELECT slug, country, CASE country WHEN 'CO' THEN 'COP' WHEN 'PE' THEN 'PEN' WHEN 'CL' THEN 'CLP' WHEN 'BR' THEN 'BRL' WHEN 'MX' THEN 'MXN' WHEN 'AR' THEN 'ARS' ELSE 'USD' END AS currency,
  CASE WHEN url <> '' THEN url WHEN CAST(slug AS INT) % 3 = 0 THEN 'd' || slug ELSE '' END AS url
FROM ({duck(COMPANIES)}) WHERE country <> 'Test' AND slug IN (SELECT ticker FROM ({FIN}))""")
def available_companies(spark, sf_dir):
    """Companies with ratios, their currency, and their address or their profile's domain."""
    meta = spark_sql(spark, sf_dir, COMPANIES)
    known = views.available_companies(meta, kpi_table(spark, sf_dir))
    profiles = meta.select("slug", F.when(F.col("slug").cast("int") % 3 == 0, F.concat(F.lit("d"), "slug")).alias("domain"))
    return links.with_domain(known, profiles).select("slug", "country", fx.currency_of(F.col("country")).alias("currency"), "url")


# --- findings, cards and candidates as a reader sees them ----------------------------------------------

@query(FLAGS_SQL + """, o AS (SELECT *, CASE severity WHEN 'Alta' THEN 0 WHEN 'Media' THEN 1 ELSE 2 END AS rank FROM flags)
SELECT ticker, flag_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY rank, flag_id LIKE '%S0%', flag_id) AS INT) AS place FROM o""")
def flags_in_order(spark, sf_dir):
    """Findings of each company, severest first, with their place as listed."""
    listed = flags.in_order(flags.of_companies(company.of_financials(financials(spark, sf_dir))))
    numbered = listed.select("ticker", "flag_id", F.monotonically_increasing_id().alias("at"))
    first = numbered.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("at", "flag_id"))).alias("all"))
    return first.select("ticker", F.posexplode("all").alias("pos", "f")).select("ticker", "f.flag_id", (F.col("pos") + 1).alias("place"))


@query(f"""WITH {CANDIDATES_CTES}, q AS (SELECT label, seen_count FROM cand WHERE seen_count >= 3 AND key NOT IN (SELECT label FROM ({duck(DECIDED)})))
SELECT label, seen_count, CAST(row_number() OVER (ORDER BY seen_count DESC, label) AS BIGINT) AS place FROM q""")
def review_in_order(spark, sf_dir):
    """The labels to review as listed: the most seen first."""
    queue = label_ops.review_queue(label_ops.candidates(sightings(spark, sf_dir)), spark_sql(spark, sf_dir, DECIDED), 3)
    # Places of a sorted list: those before its part, then within it. Only the counts of the parts meet.
    numbered = queue.select("label", "seen_count", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(
        F.first("a.first").alias("first"), F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return numbered.join(before, "part").select("label", "seen_count", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place"))


def _delta(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN printf('%.1f', {value} * 100) LIKE '-%' THEN printf('%.1f%%', {value} * 100) ELSE '+' || printf('%.1f%%', {value} * 100) END"


@query(f"""WITH {KPI_CTES}, v AS (UNPIVOT (SELECT ticker, fiscal_year, working_capital, dso FROM k) ON working_capital, dso INTO NAME kpi VALUE value),
o AS (SELECT *, lag(value) OVER (PARTITION BY ticker, kpi ORDER BY fiscal_year) AS prior, row_number() OVER (PARTITION BY ticker, kpi ORDER BY fiscal_year DESC) AS back FROM v)
SELECT ticker, kpi, CASE kpi WHEN 'dso' THEN printf('%.0fd', value) ELSE printf('COP %.1f miles de mill.', value / 1e9) END AS latest_text,
  {_delta("(value - prior) / nullif(abs(prior), 0)")} AS delta_text FROM o WHERE back = 1""")
def local_card_texts(spark, sf_dir):
    """Cards in the company's own currency, with the change since the year before."""
    cards = views.kpi_cards(kpi_table(spark, sf_dir), ["working_capital", "dso"], currency=F.lit("COP"))
    return cards.select("ticker", "kpi", "latest_text", "delta_text")


@query(f"""WITH {CELL_VALUES_CTES}, fin AS ({FIN}), {KPI_STEPS}, vals AS (UNPIVOT (SELECT ticker, fiscal_year, {", ".join(CARDS)} FROM k) ON {", ".join(CARDS)} INTO NAME kpi VALUE value),
cards AS (SELECT DISTINCT ticker, kpi FROM vals), src AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in fixed.KPI_SOURCE_FIELD.items())}) t(kpi, source_field))
SELECT cards.ticker, cards.kpi, src.source_field, s.page AS source_page FROM cards LEFT JOIN src USING (kpi)
LEFT JOIN (SELECT doc, canonical, page FROM cell_values WHERE NOT comparative) s ON s.doc = cards.ticker AND s.canonical = src.source_field""")
def kpi_pages(spark, sf_dir):
    """The page of a supplier's report behind each card of the customer of that number."""
    found = statements.extract_cells(cells(spark, sf_dir), cell_pages(spark, sf_dir)).values.filter("NOT comparative")
    cards = views.kpi_cards(kpi_table(spark, sf_dir))
    return views.kpi_sources(cards, found.select(F.col("doc").alias("ticker"), "canonical", "page")).select("ticker", "kpi", "source_field", "source_page")


CRITICAL = "['operating_cash_flow', 'revenue', 'total_assets', 'total_equity', 'total_liabilities']"


@query(f"""WITH {CELL_VALUES_CTES} SELECT doc, fiscal_year, array_to_string(list_filter({CRITICAL}, lambda c: list_contains(list(canonical), c)), ',') AS critical_found FROM cell_values GROUP BY 1, 2""")
def critical_found(spark, sf_dir):
    values = statements.extract_cells(cells(spark, sf_dir)).values
    return label_ops.score_extractions(values).select("doc", "fiscal_year", F.array_join("critical_found", ",").alias("critical_found"))


# --- whole jobs --------------------------------------------------------------------------------------

@query(FLAGS_SQL + """, n AS (SELECT ticker, count(*) AS n_flags FROM flags GROUP BY 1)
SELECT k.ticker, CAST(count(*) AS INT) AS n_years, coalesce(any_value(n_flags), 0) AS n_flags FROM k LEFT JOIN n USING (ticker) GROUP BY 1""")
def recomputed(spark, sf_dir):
    """Ratios and findings of companies that need no new data."""
    ratios, found = jobs.recompute(financials(spark, sf_dir))
    years = ratios.groupBy("ticker").agg(F.count(F.lit(1)).cast("int").alias("n_years"))
    counts = found.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_flags"))
    return years.join(counts, "ticker", "left").fillna(0, ["n_flags"])


CORRECTED_FIELDS = {"ingresos": "revenue", "cogs": "cogs", "utilidad_neta": "net_income", "total_activos": "total_assets", "patrimonio": "total_equity", "efectivo": "cash", "cartera": "receivables"}


@query(f"""WITH c AS ({duck(CORRECTIONS)}), b AS (SELECT DISTINCT slug, fiscal_year FROM ({BLOCKED})),
new AS (SELECT slug AS ticker, fiscal_year, {", ".join(f"max(CASE WHEN field = '{d}' THEN corrected_bn * 1e9 END) AS {f}" for d, f in CORRECTED_FIELDS.items())}
  FROM c ANTI JOIN b USING (slug, fiscal_year) GROUP BY 1, 2),
all_fin AS ({FIN}),
fin AS (SELECT * FROM (SELECT * FROM all_fin WHERE false) UNION ALL BY NAME SELECT * FROM new UNION ALL BY NAME SELECT * FROM all_fin WHERE (ticker, fiscal_year) NOT IN (SELECT (ticker, fiscal_year) FROM new))
{REPAIRED}""")
def confirmed_financials(spark, sf_dir):
    """Confirmed corrections of all reports into the stored financials."""
    return jobs.confirm_corrections(financials(spark, sf_dir), spark_sql(spark, sf_dir, CORRECTIONS)).financials


@query(f"""WITH c AS ({duck(CORRECTIONS)}), r AS (SELECT slug, fiscal_year, string_agg(field || '=' || field_confidence, ',' ORDER BY field) AS scores, count(*) AS n_pages,
  bool_or(abs(corrected_bn - original / 1e9) > 0.0005) AS human_validated FROM c GROUP BY 1, 2)
SELECT slug, fiscal_year, scores, n_pages, human_validated FROM r QUALIFY row_number() OVER (PARTITION BY slug ORDER BY fiscal_year DESC) = 1""")
def confirmation_records(spark, sf_dir):
    """What confirmations add to the records of companies."""
    rows = spark_sql(spark, sf_dir, CORRECTIONS).withColumn("page", F.length("field"))
    found = state.merge_company_meta(spark.createDataFrame([], "slug string, fiscal_year int"), state.confirmation_record(rows, NOW))
    scores = F.array_sort(F.transform(F.map_entries("confidence_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("slug", "fiscal_year", F.array_join(scores, ",").alias("scores"), F.size(F.map_values("source_pages")).cast("bigint").alias("n_pages"), "human_validated")
