"""Label mapping, number reading and label review over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import dimensions, fixed
from ledgerline.functions.numbers import magnitude_text, parse_number
from ledgerline.functions.text import is_noise_label, slug
from ledgerline.operators import labels as ops
from workload.inputs import duck, load, spark_sql
from workload.registry import query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- the check's number reader -------------------------------------------------------------------

def number_sql(text: str) -> str:
    """The reading rules as one SQL expression over a text expression."""
    bare = f"replace(replace(trim({text}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), ' ', ''), chr(160), '')"
    core = f"trim({bare}, '()')"
    tail = f"split_part({core}, '.', -1)"
    plain = f"""CASE
      WHEN contains({core}, ',') AND contains({core}, '.') AND strpos({core}, '.') < strpos({core}, ',') THEN replace(replace({core}, '.', ''), ',', '.')
      WHEN contains({core}, ',') AND contains({core}, '.') AND regexp_full_match({tail}, '[0-9][0-9][0-9]') THEN replace(replace({core}, '.', ''), ',', '')
      WHEN contains({core}, ',') AND contains({core}, '.') THEN replace({core}, ',', '')
      WHEN contains({core}, ',') THEN replace({core}, ',', '.')
      WHEN contains({core}, '.') AND length({tail}) = 3 THEN replace({core}, '.', '')
      ELSE {core} END"""
    return f"""(CASE WHEN regexp_full_match({plain}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
      THEN try_cast({plain} AS DOUBLE) * CASE WHEN {bare} LIKE '(%' AND {bare} LIKE '%)' THEN -1 ELSE 1 END END)"""


# --- the check's label mapping: every label against every synonym ---------------------------------

SYNONYM_ROWS = ", ".join(
    f"({i}, {quoted(w)}, {quoted(f)})" for i, (w, f) in enumerate(dimensions.ranked_synonyms()))
LEARNED_ROWS = ", ".join(f"({quoted(label)}, {quoted(f)})" for label, f, _, _ in fixed.LEARNED_SYNONYMS)


def mapping_ctes(labels: str) -> str:
    """CTE ``mapped(label, canonical)`` for a query giving ``label``."""
    return f"""
labels_in AS (SELECT DISTINCT label FROM ({labels})),
syn AS (SELECT * FROM (VALUES {SYNONYM_ROWS}) t(rk, syn, field)),
pl AS (SELECT label, translate(trim(trim(regexp_replace(lower(label), '\\(.*?\\)', '', 'g'))), {quoted(fixed.FOLD_FROM)}, {quoted(fixed.FOLD_TO)}) AS plain FROM labels_in),
w AS (SELECT label, arg_min(field, rk) AS field FROM pl JOIN syn ON contains(plain, syn)
   AND regexp_matches(plain, '(^|[^a-z])' || regexp_escape(syn) || '([^a-z]|$)') GROUP BY 1),
x AS (SELECT label, arg_min(field, rk) AS field FROM pl JOIN syn ON starts_with(syn, plain)
   AND length(plain) >= 8 AND length(plain) / length(syn) >= 0.30 GROUP BY 1),
mapped AS (SELECT pl.label, coalesce(w.field, x.field, l.field) AS canonical FROM pl LEFT JOIN w USING (label) LEFT JOIN x USING (label)
   LEFT JOIN (VALUES {LEARNED_ROWS}) l(label, field) ON l.label = lower(trim(pl.label)))"""


# Labels: every line of every document, and every part, customer segment and order status in statement words.
LABELS = """
SELECT trim(line) AS label FROM (SELECT {explode}(split(text, chr(10))) AS line FROM {documents}) lines
UNION ALL
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Ingresos operacionales (nota ' || CAST(year(o_orderdate) AS STRING) || ')'
  WHEN '2-HIGH' THEN 'Costo de ventas de servicios' WHEN '3-MEDIUM' THEN 'Período de cobro'
  WHEN '4-NOT SPECIFIED' THEN 'Reingresos y otros' ELSE 'Ganancia o' END ||
  CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN ' - total activos' ELSE ' del año' END AS label FROM {orders}
UNION ALL
SELECT CASE p_type WHEN 'ECONOMY' THEN 'Amortizaciones' WHEN 'SMALL' THEN 'EFECTIVO Y EQUIVALENTES AL EFECTIVO' WHEN 'MEDIUM' THEN 'Pasivos no corrientes'
  WHEN 'PROMO' THEN 'Depreciación de activos' WHEN 'STANDARD' THEN 'Cuentas comerciales - por' ELSE p_name END AS label FROM {part}
"""
LABELS_SPARK = LABELS.replace("{explode}", "explode").replace("chr(10)", "'\\n'")
LABELS_DUCK = duck(LABELS.replace("{explode}", "unnest"))


@query(f"""WITH {mapping_ctes(LABELS_DUCK)}, n AS (SELECT label, count(*) AS n FROM ({LABELS_DUCK}) GROUP BY 1)
SELECT coalesce(canonical, '-') AS canonical, sum(n)::BIGINT AS n, count(*) AS n_labels FROM mapped JOIN n USING (label) GROUP BY 1""")
def label_fields(spark, sf_dir):
    mapped = ops.map_labels(spark_sql(spark, sf_dir, LABELS_SPARK))
    per_label = mapped.groupBy("label", "canonical").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy(F.coalesce("canonical", F.lit("-")).alias("canonical")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels"))


@query(f"WITH {mapping_ctes(LABELS_DUCK)} SELECT label, canonical FROM mapped WHERE canonical IS NOT NULL")
def label_mapping(spark, sf_dir):
    return ops.map_labels(spark_sql(spark, sf_dir, LABELS_SPARK)).filter("canonical IS NOT NULL").distinct()




@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents),
v AS (SELECT doc_id, {number_sql("token")} AS value FROM t)
SELECT doc_id, count(value) AS n_numbers, max(value) AS largest, min(value) AS smallest FROM v GROUP BY 1""")
def text_numbers(spark, sf_dir):
    tokens = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("token"))
    return tokens.select("doc_id", parse_number(F.col("token")).alias("value")).groupBy("doc_id").agg(
        F.count("value").alias("n_numbers"), F.max("value").alias("largest"), F.min("value").alias("smallest"))


# One amount per order in each of the printed forms.
PRINTED = """
SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN {latin} WHEN '2-HIGH' THEN '(' || {latin} || ')' WHEN '3-MEDIUM' THEN {us}
  WHEN '4-NOT SPECIFIED' THEN replace({latin}, ',', '') ELSE '$ ' || {latin} END AS printed FROM {orders}
"""


def printed_text(us: str) -> str:
    latin = f"translate({us}, ',.', '.,')"
    return PRINTED.replace("{latin}", latin).replace("{us}", us)


PRINTED_DUCK = duck(printed_text("format('{{:,.2f}}', o_totalprice)"))


@query(f"SELECT o_orderkey, printed, {number_sql('printed')} AS value FROM ({PRINTED_DUCK})")
def printed_numbers(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, printed_text("format_number(o_totalprice, 2)"))
    return rows.withColumn("value", parse_number(F.col("printed")))


@query("""SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name || ' (Clínica Ñandú) ' || p_brand || ' S.A.')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def company_slugs(spark, sf_dir):
    name = F.concat("p_name", F.lit(" (Clínica Ñandú) "), "p_brand", F.lit(" S.A."))
    return load(spark, sf_dir, "part").select("p_partkey", slug(name).alias("slug"))


@query(f"""WITH l AS ({LABELS_DUCK}) SELECT coalesce(length(trim(label)) < 4 OR regexp_full_match(trim(label), '[0-9]{{4}}')
   OR lower(trim(label)) IN ('total', 'subtotal', 'suma', 'neto'), false) AS noise, count(*) AS n FROM l GROUP BY 1""")
def noise_labels(spark, sf_dir):
    rows = spark_sql(spark, sf_dir, LABELS_SPARK)
    return rows.groupBy(F.coalesce(is_noise_label(F.col("label")), F.lit(False)).alias("noise")).agg(
        F.count(F.lit(1)).alias("n"))


# Unknown labels met by a company: the customer of each order, page and value from the order.
SEEN = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Partidas por aplicar' WHEN '2-HIGH' THEN 'partidas por APLICAR '
  WHEN '3-MEDIUM' THEN 'Total' WHEN '4-NOT SPECIFIED' THEN CAST(year(o_orderdate) AS STRING)
  ELSE 'Fondo ' || CAST(o_custkey AS STRING) END AS label,
  o_totalprice AS value, month(o_orderdate) AS page, 'unknown' AS section, CAST(o_custkey AS STRING) AS company,
  'CO' AS country, CAST(o_orderkey AS STRING) AS pdf, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}
"""
SEEN_DUCK = duck(SEEN)
CANDIDATES_CTES = f"""seen AS (SELECT *, lower(trim(label)) AS key FROM ({SEEN_DUCK}) WHERE length(trim(label)) >= 4
  AND NOT regexp_full_match(trim(label), '[0-9]{{4}}') AND lower(trim(label)) NOT IN ('total', 'subtotal', 'suma', 'neto')),
cand AS (SELECT key, trim(arg_min(label, o_orderkey)) AS label, arg_min(value, o_orderkey) AS value, arg_min(company, o_orderkey) AS company,
  count(*) AS seen_count, count(DISTINCT company) AS n_companies, CAST(max(day) AS STRING) AS timestamp FROM seen GROUP BY 1)"""


def sightings(spark, sf_dir):
    return ops.sightings(spark_sql(spark, sf_dir, SEEN), ["o_orderkey"], F.col("day"))


@query(f"WITH {CANDIDATES_CTES} SELECT * FROM cand")
def label_candidates(spark, sf_dir):
    return ops.candidates(sightings(spark, sf_dir)).select(
        "key", "label", "value", "company", "seen_count", "n_companies", F.col("timestamp").cast("string").alias("timestamp"))


@query(f"WITH {CANDIDATES_CTES} SELECT DISTINCT key, company FROM seen")
def label_companies(spark, sf_dir):
    return sightings(spark, sf_dir).select("key", "company")


# Two runs: finished orders, then the others.
STORE_CTES = CANDIDATES_CTES.replace("o_orderkey", "placed").replace(f"FROM ({SEEN_DUCK})".replace("o_orderkey", "placed"), f"FROM (SELECT s.*, (o_orderstatus <> 'F', s.o_orderkey) AS placed FROM ({SEEN_DUCK}) s JOIN orders USING (o_orderkey))")


def candidate_store(spark, sf_dir):
    seen = spark_sql(spark, sf_dir, SEEN).join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    first, second = (ops.sightings(seen.filter(condition), ["o_orderkey"], F.col("day")) for condition in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    return ops.merge_sightings(ops.in_batch(first, 0), ops.in_batch(second, 1))


@query(f"""WITH {STORE_CTES} SELECT key, company, count(*) AS seen, arg_min(pdf, placed) AS first_pdf, CAST(max(day) AS STRING) AS day FROM seen GROUP BY 1, 2""")
def label_store(spark, sf_dir):
    """Every unknown label and company after two runs, with the first sighting."""
    return candidate_store(spark, sf_dir).select("key", "company", "seen", F.col("first.pdf").alias("first_pdf"), F.col("day").cast("string").alias("day"))


@query(f"WITH {STORE_CTES} SELECT * FROM cand")
def merged_candidates(spark, sf_dir):
    return ops.candidates(candidate_store(spark, sf_dir)).select(
        "key", "label", "value", "company", "seen_count", "n_companies", F.col("timestamp").cast("string").alias("timestamp"))


DECIDED = """SELECT CASE WHEN c_acctbal < 3000 THEN 'fondo ' ELSE 'otra partida ' END || CAST(c_custkey AS STRING) AS label,
  CASE WHEN c_acctbal < 0 THEN '__rejected__' ELSE 'cash' END AS canonical, c_mktsegment AS approved_by, '2026-01-01' AS date
  FROM {customer}"""


@query(f"""WITH {CANDIDATES_CTES} SELECT key, label, seen_count FROM cand WHERE (seen_count >= 3 OR key = 'fondo 7')
  AND key NOT IN (SELECT label FROM ({duck(DECIDED)}))""")
def label_review(spark, sf_dir):
    queue = ops.review_queue(
        ops.candidates(sightings(spark, sf_dir)), spark_sql(spark, sf_dir, DECIDED), 3, ["Fondo 7"], ordered=False)
    return queue.select("key", "label", "seen_count")


@query(f"""WITH d AS ({duck(DECIDED)}), new AS (SELECT DISTINCT lower(trim(label)) AS label FROM ({SEEN_DUCK}))
SELECT label, canonical, approved_by FROM d UNION ALL SELECT label, '__rejected__', 'user' FROM new WHERE label NOT IN (SELECT label FROM d)""")
def label_decisions(spark, sf_dir):
    labels = spark_sql(spark, sf_dir, SEEN).select("label")
    return ops.reject(spark_sql(spark, sf_dir, DECIDED), labels, "user", "2026-02-01").select(
        "label", "canonical", "approved_by")


@query(f"SELECT label, canonical FROM ({duck(DECIDED)}) WHERE contains(label, '12')")
def synonym_search(spark, sf_dir):
    return ops.find_synonyms(spark_sql(spark, sf_dir, DECIDED), "12").select("label", "canonical")


@query("""SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6)
  WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) END AS size_text FROM (SELECT o_orderkey, o_totalprice * 3001 AS v FROM orders)""")
def amount_texts(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", magnitude_text(F.col("o_totalprice") * 3001).alias("size_text"))
