"""Report links and narrative sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import links as L
from ledgerline import fixed
from ledgerline.operators import links as ops, narrative
from workload.inputs import duck, load, spark_sql
from workload.registry import query


# The pages' links in the forms that sites use: quoted either way or not at all, beside other attributes, with character
# references, and never closed.
ODD_PAGES = """SELECT page_id, url, CASE page_id % 5
  WHEN 0 THEN html
  WHEN 1 THEN replace(replace(html, '<a href="', '<A class=nav HREF='), '">', '>')
  WHEN 2 THEN replace(replace(html, '<a href="', '<a title="more > less" data-x="1" href=\\''), '">', '\\'>')
  WHEN 3 THEN replace(html, '<a href="/', '<a href="/p?a=1&amp;b=&#x2F;&#50;')
  ELSE replace(html, '</a>', '') END AS html FROM {pages}"""


# The check cuts the stored pages at their one form of link and writes out what each odd form adds to it.
@query("""WITH a AS (SELECT page_id, unnest(string_split(html, '<a href="')[2:]) AS piece FROM pages),
l AS (SELECT page_id, split_part(piece, '"', 1) AS href, split_part(substr(piece, strpos(piece, '>') + 1), '</a>', 1) AS text FROM a)
SELECT page_id, CASE WHEN page_id % 5 = 3 THEN '/p?a=1&b=/2' || substr(href, 2) ELSE href END AS href, trim(text) AS text, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def page_links(spark, sf_dir):
    found = ops.anchors(spark_sql(spark, sf_dir, ODD_PAGES))
    return found.groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("n"))


# One report link per order on the customer's site; names, texts and years from the order.
LINKS = """SELECT CAST(o_custkey AS STRING) AS page_id, 'https://www.site' || CAST(o_custkey AS STRING) || '.com/informes' AS url, o_orderkey AS ord,
  CASE o_orderpriority WHEN '1-URGENT' THEN '/docs/Estados-Financieros-' || y || '.pdf'
    WHEN '2-HIGH' THEN '/informes/informe-anual_' || y || '.pdf?v=1'
    WHEN '3-MEDIUM' THEN '/wp/' || y || '/03/ReporteFinanciero' || y1 || '.PDF'
    WHEN '4-NOT SPECIFIED' THEN '/q1/trimestral-' || y || '.pdf#p'
    ELSE 'https://x.example/archivo' || y || '.pdf' END AS href,
  CASE o_orderstatus WHEN 'F' THEN 'Balance General' WHEN 'O' THEN 'Informe de Gestión ' || y ELSE 'Descargar' END AS text
FROM (SELECT *, CAST(year(o_orderdate) + 18 AS STRING) AS y, CAST(year(o_orderdate) + 17 AS STRING) AS y1 FROM {orders}) dated"""

# The links have five forms, so the check writes their tiers, points and years out.
SCORED = f"""
s AS (SELECT l.*, o_orderpriority AS pr, o_orderstatus AS st, year(o_orderdate) + 18 AS y,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 10 WHEN o_orderstatus = 'F' THEN 8 WHEN o_orderpriority = '2-HIGH' THEN 5 WHEN o_orderstatus = 'O' THEN 4
       WHEN o_orderpriority = '3-MEDIUM' THEN 2 ELSE 0 END AS points
  FROM ({duck(LINKS)}) l JOIN orders ON o_orderkey = l.ord)
"""


@query(f"""WITH {SCORED}, g AS (SELECT *, points + CASE WHEN contains(href, '2016') OR contains(href, '2015') OR contains(text, '2016') THEN 3 ELSE 0 END AS score,
   CASE pr WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS tier FROM s WHERE pr <> '4-NOT SPECIFIED' AND points > 0)
SELECT page_id, href, score, tier FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier <> 1, score DESC, ord) = 1""")
def best_page_link(spark, sf_dir):
    return ops.best_link_on_page(spark_sql(spark, sf_dir, LINKS), F.lit(2016))


@query(f"""WITH {SCORED}, g AS (SELECT *, CASE WHEN pr = '3-MEDIUM' THEN CASE WHEN y - 1 >= 2015 THEN y - 1 ELSE y END ELSE y END AS yr FROM s WHERE pr <> '4-NOT SPECIFIED'),
h AS (SELECT *, points + CASE WHEN points > 0 THEN 3 ELSE 0 END AS score FROM g WHERE yr BETWEEN 2015 AND 2024)
SELECT page_id, CAST(yr AS INT) AS year, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://www.site' || page_id || '.com' || href END AS link, score
FROM h QUALIFY row_number() OVER (PARTITION BY page_id, yr ORDER BY score DESC, ord) = 1""")
def best_yearly_link(spark, sf_dir):
    return ops.best_link_per_year(spark_sql(spark, sf_dir, LINKS), "2024-06-30").select("page_id", "year", "link", "score")


@query(f"""WITH {SCORED} SELECT ord, (CASE WHEN pr IN ('1-URGENT', '2-HIGH', '5-LOW', '3-MEDIUM') THEN 1 ELSE 0 END + CASE WHEN pr IN ('2-HIGH', '3-MEDIUM') OR pr = '1-URGENT' THEN 2 ELSE 0 END
  + CASE WHEN contains(href, '2016') OR contains(href, '2015') THEN 1 ELSE 0 END
  + CASE pr WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN CASE WHEN contains(href, '2016') OR contains(href, '2015') THEN 5 ELSE 2 END ELSE 5 END
  + CASE WHEN st = 'F' THEN 1 ELSE 0 END) / 10e0 AS relevance FROM s""")
def link_relevance(spark, sf_dir):
    links = spark_sql(spark, sf_dir, LINKS)
    full = L.absolute(F.col("href"), L.origin_of(F.col("url")))
    domain = F.concat(F.lit("https://site"), "page_id", F.lit(".com/"))
    size = F.when(F.col("text") == "Balance General", 250000).otherwise(F.lit(None))
    return links.select("ord", L.relevance(full, domain, F.lit(2016), size).alias("relevance"))


@query(f"""WITH {SCORED} SELECT ord, CASE pr WHEN '1-URGENT' THEN 'Estados-Financieros-' || y || '.pdf' WHEN '2-HIGH' THEN 'informe-anual_' || y || '.pdf'
  WHEN '3-MEDIUM' THEN 'ReporteFinanciero' || (y - 1) || '.PDF' WHEN '4-NOT SPECIFIED' THEN 'trimestral-' || y || '.pdf_p.pdf' ELSE 'archivo' || y || '.pdf' END AS file_name,
  replace(href, CAST(y AS STRING), '*') AS pattern, pr = '4-NOT SPECIFIED' AS partial, CASE pr WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS tier FROM s""")
def link_names(spark, sf_dir):
    links = spark_sql(spark, sf_dir, LINKS).join(
        load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.year("o_orderdate") + 18).alias("y")), "ord")
    href = F.col("href")
    return links.select("ord", L.safe_file_name(href).alias("file_name"), L.url_pattern(href, F.col("y")).alias("pattern"),
                        L.is_partial_year(href).alias("partial"), L.tier(href).alias("tier"))


OLD_LINKS = "SELECT CAST(o_custkey AS STRING) AS slug, CAST(year(o_orderdate) AS INT) AS year, CAST(min(o_orderkey) AS STRING) AS url FROM {orders} WHERE o_orderstatus <> 'O' GROUP BY 1, 2"
NEW_LINKS = "SELECT CAST(o_custkey AS STRING) AS slug, CAST(year(o_orderdate) AS INT) AS year, CAST(min(o_orderkey) AS STRING) AS url FROM {orders} WHERE o_orderstatus = 'O' GROUP BY 1, 2"


@query(f"""SELECT coalesce(a.slug, b.slug) AS slug, coalesce(a.year, b.year) AS year, coalesce(a.url, b.url) AS kept, coalesce(b.url, a.url) AS replaced
FROM ({duck(OLD_LINKS)}) a FULL JOIN ({duck(NEW_LINKS)}) b ON a.slug = b.slug AND a.year = b.year""")
def yearly_link_merge(spark, sf_dir):
    old, new = spark_sql(spark, sf_dir, OLD_LINKS), spark_sql(spark, sf_dir, NEW_LINKS)
    kept = ops.merge_year_links(old, new, newer_wins=False).withColumnRenamed("url", "kept")
    return kept.join(ops.merge_year_links(old, new, newer_wins=True).withColumnRenamed("url", "replaced"), ["slug", "year"])


# Relative addresses with steps in every place, and what they lead to.
STEPS = [("1-URGENT", "../a/./b/../{n}.pdf", "/a/{n}.pdf"), ("2-HIGH", "x/../../{n}//y/..?q=1#top", "/{n}/?q=1#top"), ("3-MEDIUM", "./docs/20{n}/..", "/docs/"),
         ("4-NOT SPECIFIED", "/as/../is/{n}", "/as/../is/{n}"), ("5-LOW", "?p={n}", "/?p={n}")]


def _steps(number: str, at: int) -> str:
    whens = " ".join(f"WHEN '{s[0]}' THEN '" + s[at].replace("{n}", f"' || {number} || '") + "'" for s in STEPS)
    return f"CASE o_orderpriority {whens} END"


STEP_LINKS = f"""SELECT o_orderkey AS ord, 'https://www.site' || CAST(o_custkey AS STRING) || '.com/in/formes?x=1' AS url,
  {_steps("CAST(o_orderkey AS STRING)", 1)} AS href, CAST(o_orderdate AS STRING) AS day FROM {{orders}}"""


@query(f"""SELECT o_orderkey AS ord, 'https://www.site' || o_custkey || '.com' || {_steps("o_orderkey", 2)} AS address,
  o_custkey = 7 AS own, 'r/' || year(o_orderdate) || '/f-' || year(o_orderdate) || '.pdf' AS dated,
  substr(sha256('https://h/' || o_orderkey || '/download?x'), 1, 8) || '_download.pdf' AS file_name FROM orders""")
def link_addresses(spark, sf_dir):
    """Full addresses, whether they are of one site, stored patterns with a year put in, and names of nameless files."""
    links = spark_sql(spark, sf_dir, STEP_LINKS)
    full = L.absolute(F.col("href"), L.origin_of(F.col("url")))
    nameless = F.concat(F.lit("https://h/"), F.col("ord").cast("string"), F.lit("/download?x"))
    year = F.substring("day", 1, 4).cast("int")
    return links.select("ord", full.alias("address"), L.on_domain(full, F.lit("site7.com")).alias("own"),
                        L.url_for_year(F.lit("r/*/f-2001.pdf"), year).alias("dated"), L.safe_file_name(nameless).alias("file_name"))


# Search results: a search per customer, a result per order.
HITS = """SELECT CAST(o_custkey AS STRING) AS query, o_orderkey AS rank, o_orderpriority AS title, CAST(o_totalprice AS STRING) AS body,
  'http://h/' || CAST(o_orderkey AS STRING) || CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.html' ELSE '.PDF?d=1' END AS href FROM {orders}"""


@query(f"SELECT query, arg_min(href, rank) AS href FROM ({duck(HITS)}) WHERE NOT contains(href, '.html') GROUP BY 1")
def first_pdf_hit(spark, sf_dir):
    return ops.first_hit(spark_sql(spark, sf_dir, HITS))


TEXTS = HITS.replace("o_orderpriority AS title", "CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderpriority END AS title").replace(
    "CAST(o_totalprice AS STRING) AS body", "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN '' ELSE CAST(o_custkey AS STRING) END AS body")


@query(f"""SELECT query, CAST(place AS INT) AS place, snippet FROM (SELECT query, CASE WHEN title = '' THEN coalesce(body, '') WHEN coalesce(body, '') = '' THEN title ELSE title || ': ' || body END AS snippet,
  row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM ({duck(TEXTS)})) WHERE place <= 3 AND snippet <> ''""")
def search_snippets(spark, sf_dir):
    return ops.snippets(spark_sql(spark, sf_dir, TEXTS))


# Narrative: a report per source, a page per document; the words are ones the texts hold.
WORDS = {"intro": ["the", "le"], "conclusions": ["that", "der"], "objections": ["token", "password"], "portfolio": ["www", "@"]}


def _hit(name: str, anywhere: bool) -> str:
    words = "|".join(WORDS[name])
    head = f"len(list_filter(split(lower(text), chr(10))[1:8], lambda l: regexp_matches(ltrim(trim(l), '0123456789. '), '^({words})'))) > 0"
    return f"({head} OR regexp_matches(lower(text), '{words}'))" if anywhere else f"({head})"


def _pages_of(name: str, fallback: str | None) -> str:
    first = f"min(CASE WHEN {name} THEN rn END)"
    return f"CASE WHEN {first} IS NOT NULL THEN [{first}, least({first} + 1, max(rn))]" + (f" ELSE {fallback}" if fallback else "") + f" END AS {name}"


SECTIONS = f"""c AS (SELECT source AS doc, doc_id AS page, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
  {_hit("intro", False)} AS intro, {_hit("conclusions", False)} AS conclusions, {_hit("objections", True)} AS objections, {_hit("portfolio", True)} AS portfolio
  FROM documents WHERE trim(text) <> '' AND NOT (length(text) - length(replace(text, '.', ''))) / length(text) > 0.12),
p AS (SELECT doc, {_pages_of("intro", "[1, least(2, max(rn))]")}, {_pages_of("conclusions", "[greatest(max(rn) - 1, 1), max(rn)]")},
  {_pages_of("objections", None)}, {_pages_of("portfolio", None)} FROM c GROUP BY 1),
k AS (SELECT doc, 0 AS place, 'intro' AS section, intro AS rns FROM p UNION ALL SELECT doc, 1, 'conclusions', conclusions FROM p WHERE conclusions <> intro
  UNION ALL SELECT doc, 2, 'objections', objections FROM p WHERE objections IS NOT NULL
  UNION ALL SELECT doc, 3, 'portfolio', portfolio FROM p WHERE portfolio IS NOT NULL AND portfolio <> intro AND portfolio <> conclusions)"""


@query(f"""WITH {SECTIONS}
SELECT k.doc, k.section, string_agg(CAST(c.page AS STRING), ',' ORDER BY c.page) AS pages FROM k JOIN c ON c.doc = k.doc AND list_contains(rns, rn) GROUP BY 1, 2""")
def narrative_pages(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    found = narrative.section_pages(docs, WORDS)
    return found.select("doc", "section", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NARRATIVE_TITLES.items())


@query(f"""WITH {SECTIONS}, t AS (SELECT k.doc, place, section, trim(string_agg(text, chr(10) || chr(10) ORDER BY page), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM k JOIN c ON c.doc = k.doc AND list_contains(rns, rn) GROUP BY 1, 2, 3)
SELECT doc, string_agg((CASE section {TITLES} END) || chr(10) || body, chr(10) || chr(10) ORDER BY place) AS narrative FROM t GROUP BY 1""")
def narratives(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return narrative.narrative(docs, WORDS)
