import json

import pytest
from pyspark.sql import functions as F

from ledgerline import dimensions, schema
from ledgerline.operators import cleaning, facts, flags, fx, kpis, links, state, views
from ledgerline.plans import jobs
from ledgerline.sources import readers, writers


def entry(end, val, filed, start=None, form="10-K", fp="FY", fy=2024):
    return {k: v for k, v in {"form": form, "fp": fp, "fy": fy, "start": start, "end": end, "filed": filed, "val": val}.items() if v is not None}


@pytest.fixture
def facts_dir(tmp_path):
    revenue = [
        entry("2022-12-31", 10, "2023-02-01", "2022-01-01"), entry("2022-12-31", 11, "2024-02-01", "2022-01-01"),
        entry("2022-12-31", 12, "2024-02-01", "2022-01-01"), entry("2023-12-31", 5, "2024-02-01", "2023-09-30"),
        entry("2023-12-31", 20, "2024-02-01", "2023-01-01"), entry("2024-12-31", 30, "2025-02-01", "2024-01-01", form="10-Q"),
        entry("2024-12-31", 30, "2025-02-01"), entry("bad", 30, "2025-02-01", "2024-01-01"),
    ]
    assets = [entry("2023-01-01", 1, "2023-02-01"), entry("2023-12-31", 2, "2024-02-01"), entry("2023-01-01", 3, "2024-02-01")]
    a = {"entityName": "A", "facts": {"us-gaap": {
        "Revenues": {"units": {"USD": revenue}}, "SalesRevenueNet": {"units": {"USD": [entry("2021-12-31", 99, "2022-01-01", "2021-01-01")]}},
        "Assets": {"units": {"USD": assets}}, "CommonStockSharesOutstanding": {"units": {"shares": [entry("2023-12-31", 7, "2024-01-01")]}}}}}
    for name, body in (("aa", a), ("bb", {"facts": {"us-gaap": {}}}), ("cc", {"facts": {"dei": {}}})):
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "raw" / name / "facts.json").write_text(json.dumps(body, indent=2))
    return str(tmp_path / "raw")


def test_facts_from_json(spark, facts_dir):
    raw = readers.read_facts(spark, facts_dir)
    companies = readers.read_companies(spark, facts_dir)
    done = jobs.from_facts(raw, companies)
    rows = {r["fiscal_year"]: r for r in facts.raw_financials(raw).collect()}
    assert set(rows) == {2022, 2023} and rows[2022]["ticker"] == "AA"
    # Latest filing, first listed on ties; the preferred tag supplies the whole series; two ends in 2023: listed later wins.
    assert rows[2022]["revenue"] == 11.0 and rows[2023]["revenue"] == 20.0 and rows[2023]["total_assets"] == 2.0
    assert rows[2023]["shares_outstanding"] is None
    assert {r["ticker"] for r in done.errors.collect()} == {"BB", "CC"}
    assert done.financials.filter("fiscal_year = 2022").first()["total_assets"] == 2.0
    got = {r["ticker"]: r for r in facts.profile(raw, companies).collect()}
    assert got["AA"]["ok"] and got["AA"]["fy_count"] == 1 and not got["BB"]["ok"] and got["BB"]["reason"] == "no facts found"
    log = {r["ticker"]: r for r in jobs.run_log(done.financials, done.errors, True).collect()}
    assert log["AA"]["status"] == "success" and log["BB"]["status"] == "error"


def test_hot_company_is_reduced_before_it_moves(spark, facts_dir):
    plan = facts.raw_financials(readers.read_facts(spark, facts_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_min_by" in plan and "BatchEvalPython" not in plan


def test_ticker_ids(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "x"}, "1": {"cik_str": 1, "ticker": "brk-b"}}))
    ids = readers.read_ticker_ids(spark, str(tmp_path / "t.json"))
    asked = spark.createDataFrame([("aapl",), ("BRK.B",), ("none",)], "ticker string")
    got = {r["ticker"]: (r["cik"], r["error"]) for r in facts.resolve_ids(asked, ids).collect()}
    assert got == {"aapl": ("0000320193", None), "BRK.B": ("0000000001", None), "none": (None, "unknown ticker NONE")}


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"label": "Fondo", "company": "a"}\nbroken{\n{"label": "Otro", "seen_count": 3, "companies_seen": ["x"]}\n')
    got = {r["label"]: r for r in readers.read_candidates(spark, str(tmp_path / "c.jsonl")).collect() if r["label"]}
    assert got["Fondo"]["seen_count"] == 1 and got["Fondo"]["companies_seen"] == ["a"] and got["Otro"]["seen_count"] == 3
    assert readers.read_candidates(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "fx.json").write_text('{"BRL_2023": 0.2, "ARS_2023": 0.001}')
    assert {(r["currency"], r["year"], r["approximated"]) for r in readers.read_fx(spark, str(tmp_path / "fx.json")).collect()} == {
        ("BRL", 2023, False), ("ARS", 2023, True)}
    assert readers.read_fx(spark, str(tmp_path / "nofx.json")).count() == 0
    (tmp_path / "l.json").write_text('[{"label": "x", "canonical": "cash"}, {"label": "", "canonical": "cash"}]')
    assert readers.read_learned(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"_note": "x", "acme": {"domain": "https://a", "doc_tier": 1, "historical_pdfs": {"2022": "u"}}}))
    p = readers.read_profiles(spark, str(tmp_path / "p.json")).collect()
    assert len(p) == 1 and p[0]["slug"] == "acme" and p[0]["historical_pdfs"] == {2022: "u"}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"<html>")
    assert {(r["path"][-5:], r["is_pdf"]) for r in readers.read_reports(spark, str(tmp_path / "pdf")).collect()} == {("a.pdf", True), ("b.pdf", False)}
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"sectors": {"s": {"flags": [{"id": "R", "name": "n", "kpi": "roe", "description": "d", "thresholds": {"Alta": {"lt": 0}}}]}}}))
    assert readers.read_rules(str(rules))["sectors"]["s"][0]["Alta"] == {"lt": 0} and readers.read_rules("/nowhere.json") == {}


def test_tables_round_trip_and_schema_growth(spark, tmp_path):
    path = str(tmp_path / "fin")
    df = spark.createDataFrame([("a", 2023, 1.0, "co"), ("b", 2023, 2.0, "pe")], "ticker string, fiscal_year int, revenue double, country string")
    writers.write_partitions(df, path, ["country"])
    writers.write_partitions(df.filter("country = 'co'").withColumn("revenue", F.lit(5.0)), path, ["country"])
    back = readers.read_table(spark, path, schema.FINANCIALS)
    assert back.columns == schema.FINANCIALS.fieldNames() and {r["ticker"]: r["revenue"] for r in back.collect()} == {"a": 5.0, "b": 2.0}
    assert readers.read_table(spark, path, schema.FINANCIALS, ["fiscal_year"]).distinct().count() == 1
    assert readers.read_table(spark, str(tmp_path / "no"), schema.FINANCIALS).count() == 0
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    learned = dimensions.learned_synonyms(spark)
    writers.export_learned(learned, str(tmp_path / "l"))
    assert readers.read_learned(spark, str(tmp_path / "l")).count() >= 1


def test_upsert_and_years(spark):
    old = spark.createDataFrame([("a", 2022, 1.0, 1.0), ("a", 2023, 2.0, 2.0)], "ticker string, fiscal_year int, x double, y double")
    new = spark.createDataFrame([("a", 2023, 8.0, None, 1), ("a", 2023, None, 9.0, 2), ("b", 2024, 1.0, 1.0, 1)], "ticker string, fiscal_year int, x double, y double, o int")
    got = {(r["ticker"], r["fiscal_year"]): (r["x"], r["y"]) for r in state.upsert(old, new, ["ticker", "fiscal_year"], ["o"]).collect()}
    assert got == {("a", 2022): (1.0, 1.0), ("a", 2023): (None, 9.0), ("b", 2024): (1.0, 1.0)}
    companies = spark.createDataFrame([("a",), ("c",)], "ticker string")
    missing = state.missing_years(companies, old, "2026-05-01")
    assert {(r["ticker"], r["fiscal_year"]) for r in missing.collect()} == {("a", y) for y in (2025, 2024, 2021, 2020)} | {("c", y) for y in range(2020, 2026)}
    assert state.missing_years(companies, old, "2026-05-01", 2, 6).filter("ticker = 'a'").count() == 3
    assert [r["ascending"] for r in views.fiscal_years(old).collect()] == [[2022, 2023]]


def test_run_metadata(spark):
    old = spark.sql("SELECT 'a' ticker, timestamp_ntz'2025-01-01' last_downloaded, timestamp_ntz'2025-01-01' last_processed, 3 fy_count, 'success' status, "
                    "CAST(NULL AS STRING) error_message, '' fields_missing UNION ALL SELECT 'k', timestamp_ntz'2025-02-01', NULL, 1, 'success', NULL, NULL")
    runs = spark.createDataFrame([("a", False, "success", 4, None, ["x", "y"]), ("b", False, "success", 1, None, []), ("c", True, "error", 9, "e" * 900, None)],
                                 "ticker string, scraped boolean, status string, fy_count int, error_message string, fields_missing array<string>")
    got = {r["ticker"]: r for r in state.merge_run_metadata(old, runs, "2026-03-01", message_length=500).collect()}
    whole = {r["ticker"]: r["error_message"] for r in state.merge_run_metadata(old, runs, "2026-03-01").collect()}
    assert whole["c"] == "e" * 900
    assert got["a"]["last_downloaded"].year == 2025 and got["a"]["fields_missing"] == "x,y" and got["b"]["last_downloaded"].year == 2026
    assert got["c"]["last_downloaded"] is None and len(got["c"]["error_message"]) == 500 and got["c"]["fy_count"] == 0 and got["k"]["fy_count"] == 1
    companies = spark.createDataFrame([("a",), ("k",), ("z",)], "ticker string")
    stale = {r["ticker"]: r["needs_update"] for r in state.staleness(companies, old, "2025-03-31", outputs=companies.filter("ticker <> 'k'")).collect()}
    assert stale == {"a": False, "k": True, "z": True}
    assert state.staleness(companies, old, "2025-03-31", force=True).filter("needs_update").count() == 3
    assert {r["status"]: r["n"] for r in state.batch_summary(runs).collect()} == {"success": 2, "error": 1}


def test_corrections(spark):
    rows = [("s", 2024, "ingresos", 5.2e9, 5.5, "Alta"), ("s", 2024, "cogs", 1e9, 1.0, "Alta"), ("t", 2024, "efectivo", 2e9, 2.0, "Baja"),
            ("u", 2024, "efectivo", 0.0, 0.0, "Baja"), ("u", 2024, "cartera", None, 1.0, "Baja")]
    df = spark.createDataFrame(rows, "slug string, fiscal_year int, field string, original double, corrected_bn double, field_confidence string")
    assert [(r["slug"], r["field"]) for r in state.unedited_low_confidence(df).collect()] == [("t", "efectivo")]
    audit = {r["slug"]: r for r in state.correction_audit(df, "now").collect()}
    assert audit["s"]["human_validated"] and set(audit["s"]["human_validated_fields"]) == {"ingresos"} and not audit["t"]["human_validated"]
    values = {(r["ticker"], r["canonical"]): r["value"] for r in state.corrected_values(state.confirmable(df)).collect()}
    assert values[("s", "revenue")] == 5.5e9 and values[("u", "receivables")] == 1e9 and ("t", "cash") not in values
    done = jobs.confirm_corrections(schema.empty(spark, schema.FINANCIALS), df, spark.createDataFrame(
        [("s", 2024, "capex", 3.0), ("t", 2024, "capex", 3.0)], "ticker string, fiscal_year int, canonical string, value double"))
    assert {r["ticker"]: r["capex"] for r in done.financials.collect()} == {"s": 3.0, "u": None}


def test_fx(spark):
    rates = dimensions.stored_fx(spark)
    df = spark.createDataFrame([(500.0, "USD", 2023), (1000.0, "BRL", 2023), (1.0, "XXX", 2023)], "amount double, currency string, fiscal_year int")
    got = {r["currency"]: r["usd"] for r in fx.to_usd(df, rates).collect()}
    assert got["USD"] == 500.0 and 0 < got["BRL"] < 1000 and got["XXX"] is None
    merged = fx.merge_rates(rates, spark.createDataFrame([("BRL", 2023, 9.0, False), ("BRL", 2024, 9.0, False)], schema.FX_RATES))
    assert merged.count() == rates.count() + 1


def test_profiles_and_links(spark):
    old = spark.createDataFrame([("a", "d1", "2025", "s", "pat*", ["x"], 1, ["q1", "q2"], {2022: "o", 2021: "p"}, None, None)], schema.PROFILES)
    new = spark.createDataFrame([("a", "d2", None, None, "", [], None, ["q2", "q3"], {2022: "n"}, None, None),
                                 ("b", "d3", None, None, None, None, None, None, None, None, None)], schema.PROFILES)
    got = {r["slug"]: r for r in links.merge_profiles(old, new).collect()}
    a = got["a"]
    assert (a["domain"], a["pdf_url_pattern"], a["nav_path"], a["failed_ddgs_queries"], a["historical_pdfs"]) == (
        "d2", "pat*", ["x"], ["q1", "q2", "q3"], {2022: "n", 2021: "p"})
    assert got["b"]["domain"] == "d3" and got["b"]["historical_pdfs"] is None
    wanted = spark.createDataFrame([("a", 2022), ("a", 1999)], "slug string, fiscal_year int")
    meta = old.withColumn("t2_pdfs", F.col("historical_pdfs"))
    assert {r["fiscal_year"]: r["url"] for r in links.report_url(meta, wanted).collect()} == {2022: "o", 1999: None}
    companies = spark.createDataFrame([("a", ""), ("z", "u")], "slug string, url string")
    assert {r["slug"]: r["url"] for r in links.with_domain(companies, old).collect()} == {"a": "d1", "z": "u"}
    html = ('<a href="/q1/ef-2023.pdf">Estados</a><a class="x" href=\'/Informe-Anual-2023.pdf\'><b>Informe</b></a>'
            '<A HREF="/estados-financieros-2022.pdf">EF</A><a href="/otro.html">x</a>')
    page = spark.createDataFrame([(1, "https://a.com/p", html)], "page_id int, url string, html string")
    found = links.anchors(page)
    assert found.count() == 4 and links.best_link_on_page(found, F.lit(2023)).first()["href"] == "/estados-financieros-2022.pdf"
    yearly = {r["year"]: r["link"] for r in links.best_link_per_year(found, "2026-01-01").collect()}
    assert yearly == {2022: "https://a.com/estados-financieros-2022.pdf", 2023: "https://a.com/Informe-Anual-2023.pdf"}


def test_company_meta(spark):
    f = schema.conform_financials(spark.createDataFrame([("a", 2023, 10.0, -1.0), ("a", 2024, 20.0, -2.0)], "ticker string, fiscal_year int, revenue double, net_income double"))
    k = kpis.calculate_kpis(f)
    companies = spark.createDataFrame([("a", "A", "AR", "u", 2023, "2026", "p")], "slug string, name string, country string, url string, fiscal_year int, last_downloaded string, source_pdf_path string")
    conf = spark.createDataFrame([("a", "Alta", "cell_table")], "slug string, confidence string, extraction_method string")
    m = writers.company_meta(companies, cleaning.field_completeness(f), views.fiscal_years(f), conf, flags.evaluate_flags(k, f), dimensions.stored_fx(spark), "now").first()
    assert m["fiscal_years"] == [2023, 2024] and m["fy_count"] == 2 and m["ars_warning"] and m["approximated_fx"] and m["currency_original"] == "ARS"
    assert m["red_flags_count"] == 2 and m["fx_rate_usd"] == 0.000689 and "revenue" not in m["fields_missing"]


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    assert e.entry(spark).columns[:2] == ["ticker", "fiscal_year"]


RULE_TEXT = """# thresholds
version: "1.0"
default_sector: "health # care"

sectors:
  "health # care":
    flags:
      # first
      - id: F1
        name: "Deuda: alta"     # a remark
        kpi: debt_to_ebitda
        description: 'más de #4'
        thresholds:
          Alta: { gt: 4.0 }
          Media: { gt: 2.5, lte: 4.0 }
      -
        id: F2
        name: Caja
        kpi: "cash_ratio"
        description: ""
        thresholds:
          Baja:
            lt: -1
            gte: 2e0
  empty:
    flags:
  listed:
  - {id: F3, name: n, kpi: roe, description: d}
"""


def test_rules_from_any_store(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULE_TEXT)
    rules = readers.read_rules(f"file://{tmp_path}/rules.yaml", spark)
    assert rules == {"default_sector": "health # care", "sectors": {
        "health # care": [
            {"id": "F1", "name": "Deuda: alta", "kpi": "debt_to_ebitda", "description": "más de #4", "Alta": {"gt": 4.0}, "Media": {"gt": 2.5, "lte": 4.0}},
            {"id": "F2", "name": "Caja", "kpi": "cash_ratio", "description": "", "Baja": {"lt": -1, "gte": 2.0}}],
        "empty": [], "listed": [{"id": "F3", "name": "n", "kpi": "roe", "description": "d"}]}}
    assert readers.read_rules(f"{tmp_path}/none.yaml", spark) == {} and readers.parse_rules("# nothing\n") == {}
    (tmp_path / "empty.yaml").write_text("")
    assert readers.read_rules(f"{tmp_path}/empty.yaml", spark) in ({}, {"default_sector": "healthcare", "sectors": {}})
    for broken in ("a:\n  b: 1\n    c: 2", "- x\n- y", "plain"):
        with pytest.raises(ValueError):
            if readers.parse_rules(broken) == {"plain": None}:
                raise ValueError


def test_first_bytes_only(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.pdf").write_bytes(b"%PDF" + b"x" * 3_000_000)
    (tmp_path / "in" / "b.pdf").write_bytes(b"<ht")
    (tmp_path / "in" / "c.pdf").write_bytes(b"")
    found = readers.read_reports(spark, str(tmp_path / "in"))
    assert {(r["path"].rsplit("/", 1)[-1], r["length"], r["is_pdf"]) for r in found.collect()} == {("a b.pdf", 3_000_004, True), ("b.pdf", 3, False)}
    assert readers.read_reports(spark, str(tmp_path / "none")).count() == 0
    # What is read of each file, counted where it is opened.
    import pandas as pd

    reads = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            reads.append(n)
            return self.file.read_at(n, at)

    class Store:
        def open_input_file(self, path):
            return Counted(local.open_input_file(path))

    local = readers.fs.LocalFileSystem()
    monkeypatch.setattr(readers.fs, "LocalFileSystem", Store)
    paths = sorted(str(p) for p in (tmp_path / "in").iterdir())
    starts = pd.concat(readers._starts(iter([pd.DataFrame({"path": [f"file:{p}" for p in paths], "length": 1})])))
    assert starts["start"].tolist() == [b"%PDF", b"<ht", b""] and reads == [4, 3, 0]


def test_rates_are_added_once(spark, tmp_path):
    path = str(tmp_path / "fx")
    rates = spark.createDataFrame([("BRL", 2023, 0.2, False), ("BRL", 2023, 0.3, False), ("COP", 2023, 0.1, True)], schema.FX_RATES)
    for _ in range(2):
        writers.append_fx(rates, path)
    writers.append_fx(spark.createDataFrame([("BRL", 2023, 9.0, False), ("BRL", 2024, 0.4, False)], "currency string, year int, rate double, approximated boolean"), path)
    stored = readers.read_table(spark, path, schema.FX_RATES)
    assert sorted(map(tuple, stored.collect())) == [("BRL", 2023, 0.2, False), ("BRL", 2024, 0.4, False), ("COP", 2023, 0.1, True)]
    amounts = spark.createDataFrame([(1.0, "BRL", 2023), (1.0, "USD", 2023), (1.0, None, 2023)], "amount double, currency string, fiscal_year int")
    doubled = stored.unionByName(stored)
    assert sorted((r["usd"] is None, r["usd"]) for r in fx.to_usd(amounts, doubled).collect()) == [(False, 0.2), (False, 1.0), (True, None)]


def test_printed_json_maps_are_read_whole(spark, tmp_path):
    (tmp_path / "fx.json").write_text(json.dumps({"BRL_2023": 0.2, "ARS_2024": 0.001}, indent=2))
    (tmp_path / "ids.json").write_text(json.dumps({"0": {"cik_str": 12, "ticker": "ab", "title": "t"}}, indent=2))
    (tmp_path / "profiles.json").write_text(json.dumps({"_note": "x", "one": {"domain": "a.co", "historical_pdfs": {"2020": "u"}}}, indent=2))
    assert {(r["currency"], r["year"], r["rate"]) for r in readers.read_fx(spark, str(tmp_path / "fx.json")).collect()} == {("BRL", 2023, 0.2), ("ARS", 2024, 0.001)}
    assert [tuple(r) for r in readers.read_ticker_ids(spark, str(tmp_path / "ids.json")).collect()] == [("AB", "0000000012")]
    assert [(r["slug"], r["domain"], r["historical_pdfs"]) for r in readers.read_profiles(spark, str(tmp_path / "profiles.json")).collect()] == [("one", "a.co", {2020: "u"})]


def test_confirmations_reach_the_record(spark):
    rows = [("s", 2023, "ingresos", 5.2e9, 5.5, "Alta", 3), ("s", 2024, "ingresos", 5.2e9, 5.5, "Alta", 4), ("s", 2024, "ingresos", 5.2e9, 5.4, "Media", 4),
            ("s", 2024, "cogs", 1e9, 1.0, None, None), ("t", 2024, "efectivo", 2e9, 2.0, "Baja", 1)]
    df = spark.createDataFrame(rows, "slug string, fiscal_year int, field string, original double, corrected_bn double, field_confidence string, page int")
    old = spark.createDataFrame([("s", "CO", 2022), ("u", "PE", 2020)], "slug string, country string, fiscal_year int")
    got = {r["slug"]: r for r in state.merge_company_meta(old, state.confirmation_record(df, "now")).collect()}
    s = got["s"]
    assert (s["country"], s["fiscal_year"], s["human_validated"], s["confirmed_at"]) == ("CO", 2024, True, "now")
    assert s["confidence_scores"] == {"ingresos": "Alta", "cogs": None} and s["source_pages"] == {"ingresos": 4, "cogs": None}
    assert s["human_validated_fields"]["ingresos"]["corrected_mmm"] == 5.5 and set(s["human_validated_fields"]) == {"ingresos"}
    assert got["t"]["human_validated"] is False and got["u"]["confirmed_at"] is None and got["u"]["fiscal_year"] == 2020
    without = state.confirmation_record(df.drop("page"), "now").where("slug = 't'").first()
    assert without["source_pages"] == {"efectivo": None}


def test_contents_apart_from_files(spark):
    texts = spark.createDataFrame([("a", '{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "val": 5}, {"val": 6}]}}}}}'),
                                   ("b", "broken"), ("c", None), ("d", '{"facts": {"dei": {}}}')], "ticker string, json string")
    assert [(r["ticker"], r["pos"], str(r["end"]), r["val"]) for r in readers.parse_facts(texts).collect()] == [("A", 0, "2023-12-31", 5.0), ("A", 1, "None", 6.0)]
    profiles = spark.createDataFrame([('{"one": {"historical_pdfs": {"2020": "u", "x": "y"}}, "_n": 1}',), (None,), ("broken",)], "value string")
    assert [(r["slug"], r["historical_pdfs"]) for r in readers.parse_profiles(profiles).collect()] == [("one", {2020: "u"})]
