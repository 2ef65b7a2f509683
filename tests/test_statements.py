import random

from pyspark.sql import functions as F

from ledgerline import fixed, schema
from ledgerline.operators import narrative, statements
from ledgerline.operators.carry import carry_forward
from ledgerline.plans import jobs


def test_carry_forward_across_blocks(spark):
    rng = random.Random(5)
    rows = [(g, p, i, rng.choice([None] * 6 + [1, 2, 3]), rng.choice([None] * 9 + ["a", "b"]))
            for g in "xyz" for p in range(60) for i in range(rng.randint(0, 4))]
    df = spark.createDataFrame(rows, "g string, page int, row int, v int, s string")
    out = carry_forward(df, ["g"], ["page", "row"], {"cv": F.col("v"), "cs": F.col("s")}, F.floor(F.col("page") / 7))
    last = {}
    want = []
    for g, p, i, v, s in rows:
        keep = last.setdefault(g, [None, None])
        keep[0] = v if v is not None else keep[0]
        keep[1] = s if s is not None else keep[1]
        want.append((g, p, i, v, s, *keep))
    assert sorted(map(str, map(tuple, out.select("g", "page", "row", "v", "s", "cv", "cs").collect()))) == sorted(map(str, want))


def cells(spark, rows, year=2024, country="CO"):
    return spark.createDataFrame(
        [("d", country, year, page, t, r, c) for page, t, r, c in rows], schema.CELLS)


def found(extraction):
    return {(r["fiscal_year"], r["canonical"]): r["value"] for r in extraction.values.collect()}


def test_cells_follow_the_year_columns(spark):
    ex = statements.extract_cells(cells(spark, [
        (1, 0, 0, ["Concepto", "Nota", "2023", "2024"]),
        (1, 0, 1, ["Ingresos operacionales", "3", "900", "1.000 *"]),
        (1, 0, 2, ["Costo de ventas", "4", "(500)", ""]),
        (2, 0, 0, ["", "Total activos", "7.000", "8.000"]),
        (2, 0, 1, ["Ingresos netos", "3", "1", "2"]),
        (2, 0, 2, ["abc", "3", "1", "2"]),
        (2, 0, 3, ["Sin valor", None, "", "x"]),
        (40, 0, 0, ["Concepto", "dic-24", "dic 23"]),
        (40, 0, 1, ["Cuentas por pagar", "55", "44"]),
        (40, 0, 2, ["Algo raro aqui", "55", "44"]),
    ]), spark.createDataFrame([("d", "CO", 2024, 1, "Estado de Resultados", 0), ("d", "CO", 2024, 2, "nada", 0),
                               ("d", "CO", 2024, 40, "BALANCE GENERAL", 0)], schema.PAGES))
    assert found(ex) == {
        (2024, "revenue"): 1000.0, (2023, "revenue"): 900.0, (2024, "cogs"): -500.0, (2023, "cogs"): -500.0,
        (2024, "total_assets"): 8000.0, (2023, "total_assets"): 7000.0, (2024, "accounts_payable"): 55.0, (2023, "accounts_payable"): 44.0}
    sections = {(r["canonical"], r["section"]) for r in ex.values.filter("not comparative").collect()}
    assert sections == {("revenue", "income"), ("cogs", "income"), ("total_assets", "income"), ("accounts_payable", "balance")}
    assert [(r["label"], r["section"]) for r in ex.unmatched.collect()] == [("Algo raro aqui", "balance")]


def test_cells_without_header_or_year(spark):
    ex = statements.extract_cells(cells(spark, [(1, 0, 0, ["Efectivo", "1", "2", None]), (1, 0, 1, ["2024", None])], year=None))
    assert {k[1]: v for k, v in found(ex).items()} == {"cash": 2.0}
    zero_row = statements.extract_cells(cells(spark, [(1, 0, 0, ["Efectivo", "0", "0"]), (1, 0, 1, ["Inventarios", "5"])]))
    assert found(zero_row) == {(2024, "inventory"): 5.0}


def pages(spark, texts, images=0, country="CO", doc="d"):
    return spark.createDataFrame([(doc, country, 2024, i + 1, t, images) for i, t in enumerate(texts)], schema.PAGES)


def test_lines(spark):
    ex = statements.extract_lines(pages(spark, [
        "Balance General\nTotal activos   1.000  n.d.\n  Efectivo\t(20)\nInventarios 30\nabc   4\n", "Total activos   9.999\nCosa nueva   1"]))
    assert found(ex) == {(2024, "total_assets"): 1000.0, (2024, "cash"): -20.0}
    assert [(r["label"], r["page"], r["section"]) for r in ex.unmatched.collect()] == [("Cosa nueva", 2, "balance")]


def test_scans(spark):
    texts = ["ESTADO DE RESULTADOS 2024\nDIC 2023   DIC 2024\nVentas netas [Nota 2] $1.000.000 2.000.000 55.000\n"
             "Total activos no corrientes 9.000.000 8.000.000\nEfectivo 5.000 5.000\n",
             "Ventas de servicios 3.000.000,50 1.500.000\n1.234.567 Rubro"]
    ex = statements.extract_scans(pages(spark, texts, 1), "2026-01-01")
    assert found(ex) == {(2024, "revenue"): 2000000.0, (2023, "revenue"): 3000000.5, (2024, "cash"): 5000.0}
    many = pages(spark, texts + [""] * 19 + ["Ventas netas 9.000.000"], 1)
    assert found(statements.extract_scans(many, "2026-01-01", max_pages=20)) == found(ex)
    assert found(statements.extract_scans(many, "2026-01-01"))[(2024, "revenue")] == 9000000.0


def test_choice_of_reading(spark):
    cell_rows = cells(spark, [(1, 0, 0, ["Efectivo", "5"])])
    text = pages(spark, ["Total activos   1.000\nEfectivo   6\n" + "palabra " * 20])
    digital = jobs.statements.read_reports(cell_rows, text, "2026-01-01")
    assert found(digital) == {(2024, "total_assets"): 1000.0, (2024, "cash"): 6.0}
    scan = jobs.statements.read_reports(cell_rows, pages(spark, ["Efectivo 7.000"], 2), "2026-01-01")
    assert found(scan) == {(2025, "cash"): 7000.0}
    result, _ = jobs.reports_to_financials(schema.empty(spark, schema.FINANCIALS), cell_rows, text, "2026-01-01")
    assert result.financials.first()["total_assets"] == 1000.0


def test_report_values_replace_repair_and_fill(spark):
    old = schema.conform_financials(spark.createDataFrame(
        [("a", 2022, 1.0, 5.0), ("a", 2023, 2.0, 7.0)], "ticker string, fiscal_year int, revenue double, cash double"))
    new = spark.createDataFrame([("a", 2023, "revenue", 3.0), ("a", 2023, "total_assets", 100.0), ("a", 2023, "total_liabilities", 100.0),
                                 ("a", 2023, "total_equity", 40.0), ("a", 2023, "current_ratio", 1.7), ("a", 2023, "dpo", 9.0)],
                                "ticker string, fiscal_year int, canonical string, value double")
    done = jobs.from_reports(old, new)
    rows = {r["fiscal_year"]: r for r in done.financials.collect()}
    assert rows[2022]["cash"] == 5.0 and rows[2023]["revenue"] == 3.0 and rows[2023]["cash"] is None and rows[2023]["total_liabilities"] == 60.0
    kpi = {r["fiscal_year"]: r for r in done.kpis.collect()}
    assert kpi[2023]["current_ratio"] == 1.7 and kpi[2023]["revenue_growth_yoy"] == 2.0 and kpi[2022]["current_ratio"] is None


def test_narrative(spark):
    filler = "texto corrido de la empresa"
    texts = ["Indice ........ 1 ........ 2", "1. Presentacion\n" + filler, "", filler + " A", "La cartera vencida", filler + " B", "4.1 Conclusiones\nfin"]
    df = pages(spark, texts)
    got = {r["section"]: r["pages"] for r in narrative.section_pages(df).collect()}
    assert got == {"intro": [2, 4], "conclusions": [7], "portfolio": [5, 6]}
    text = narrative.narrative(df).first()["narrative"]
    assert text.startswith("[INTRODUCCION]\n1. Presentacion\n" + filler + "\n\n" + filler + " A\n\n[CONCLUSIONES/CIERRE]\n4.1")
    plain = narrative.section_pages(pages(spark, ["uno", "dos", "tres"])).collect()
    assert {r["section"]: r["pages"] for r in plain} == {"intro": [1, 2], "conclusions": [2, 3]}
    one = narrative.section_pages(pages(spark, ["uno"])).collect()
    assert {r["section"]: r["pages"] for r in one} == {"intro": [1]}
    long = pages(spark, ["a" * 3000])
    assert len(narrative.narrative_sections(long).first()["text"]) == 3000
    assert len(narrative.narrative_sections(long, lengths=fixed.NARRATIVE_LENGTHS).first()["text"]) == fixed.NARRATIVE_LENGTHS["intro"]


def test_scanned_and_unmatched(spark):
    df = pages(spark, ["x", "y", "z" * 60], 1)
    assert statements.scanned_docs(df).first()["is_scanned"] is True
    ex = statements.extract_lines(pages(spark, ["Cosa nueva   1\nCosa nueva   2\nOtra cosa   3"]))
    assert tuple(statements.unmatched_counts(ex.unmatched).first())[1:] == (3, 2)


def test_a_report_on_one_page_is_many_tasks(spark):
    # One table on one page: blocks are cut by rows, and the year columns reach rows far below their header.
    rows = [(1, 0, 0, ["Concepto", "2023", "2024"])] + [(1, 0, i, [f"Partida rara {i}", str(10000 + i), str(20000 + i)]) for i in range(1, 5000)]
    rows += [(1, 0, 5000, ["Efectivo", "7", "8"]), (1, 1, 0, ["Concepto", "2024", "2023"]), (1, 1, 1, ["Inventarios", "5", "6"])]
    found_rows = {r["label"]: (r["value"], r["value_before"]) for r in statements.cell_rows(cells(spark, rows)).collect()}
    assert found_rows["Efectivo"] == (8.0, 7.0) and found_rows["Inventarios"] == (5.0, 6.0)
    assert all(found_rows[f"Partida rara {i}"] == (20000 + i, 10000 + i) for i in range(1, 5000, 7))


def test_sections_across_blocks_of_pages(spark):
    texts = ["nada"] * 70 + ["Balance General"] + ["nada"] * 200 + ["Efectivo   5", "Estado de Resultados\nVentas netas   9"]
    ex = statements.extract_lines(pages(spark, texts))
    assert {r["canonical"]: (r["page"], r["section"]) for r in ex.values.collect()} == {"cash": (272, "balance"), "revenue": (273, "income")}


def test_scans_move_no_text_and_read_their_years_later(spark):
    # The order of columns stands on the first page, the amounts on others.
    texts = ["Informe\n2023   2024", "Ventas netas 1.000.000 2.000.000", "Ventas netas 3.000.000\nEfectivo 4.000 5.000"]
    df = pages(spark, texts, 1)
    scans = statements.extract_scans(df, "2026-01-01")
    # Two amounts: the right one is of 2024, the left one of 2023. One amount is of the latest year.
    assert found(scans) == {(2024, "revenue"): 3000000.0, (2023, "revenue"): 1000000.0, (2024, "cash"): 5000.0, (2023, "cash"): 4000.0}
    plan = scans.values._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[1:]
    assert below and all("text" not in part.split("\n")[0] for part in below)


def test_reports_of_both_kinds_in_one_reading(spark):
    schema_ = "doc string, country string, fiscal_year int, page int, text string, recognised string, n_images int"
    mixed = spark.createDataFrame([
        ("scan", "CO", 2024, 1, "", "Estado de Resultados 2022\nVentas netas 5.000.000 4.000.000", 1),
        ("text", "CO", 2024, 1, "Balance General\nEfectivo   1.000\nInventarios   2.000\n" + "palabra " * 10, None, 0),
        ("both", "CO", 2024, 1, "Efectivo   3\n" + "palabra " * 10, None, 0), ("none", "CO", 2024, 1, "palabra " * 10, None, 0)], schema_)
    table = spark.createDataFrame([("both", "CO", 2024, 1, 0, 0, ["Efectivo", "4"]), ("both", "CO", 2024, 1, 0, 1, ["Rubro nuevo", "4"]),
                                   ("bare", "CO", 2024, 1, 0, 0, ["Efectivo", "6"])], schema.CELLS)
    ex = statements.read_reports(table, mixed, "2026-01-01")
    got = {(r["doc"], r["fiscal_year"], r["canonical"]): (r["value"], r["section"]) for r in ex.values.collect()}
    assert got == {("scan", 2022, "revenue"): (4000000.0, "income"), ("scan", 2021, "revenue"): (5000000.0, "income"),
                   ("text", 2024, "cash"): (1000.0, "balance"), ("text", 2024, "inventory"): (2000.0, "balance"),
                   ("both", 2024, "cash"): (4.0, "unknown"), ("bare", 2024, "cash"): (6.0, "unknown")}
    assert {(r["doc"], r["fiscal_year"]) for r in ex.readings.filter("canonical IS NULL").collect()} == {
        ("scan", 2022), ("text", 2024), ("both", 2024), ("none", 2024)}
    assert [(r["doc"], r["label"]) for r in ex.unmatched.collect()] == [("both", "Rubro nuevo")]


def test_the_last_report_gives_the_whole_row(spark):
    old = schema.conform_financials(spark.createDataFrame([("a", 2022, 1.0, 5.0)], "ticker string, fiscal_year int, revenue double, cash double"))
    new = spark.createDataFrame([
        ("a", "x", 1, 2023, "revenue", 9.0), ("a", "x", 1, 2023, "cash", 9.0), ("a", "x", 1, 2023, "current_ratio", 1.5),
        ("a", "y", 2, 2023, "revenue", 3.0), ("a", "y", 2, 2023, "current_ratio", 2.5), ("a", "z", 2, 2023, "cash", 4.0),
        ("a", "w", 3, 2022, None, None), ("b", "v", 1, 2022, "cash", None)],
        "ticker string, doc string, report_order int, fiscal_year int, canonical string, value double")
    done = jobs.from_reports(old, new)
    rows = {(r["ticker"], r["fiscal_year"]): (r["revenue"], r["cash"]) for r in done.financials.collect()}
    # Of reports of one order the one with the larger name is the later; a report without values empties its year.
    assert rows == {("a", 2023): (None, 4.0), ("a", 2022): (None, None), ("b", 2022): (None, None)}
    kpi = {(r["ticker"], r["fiscal_year"]): r["current_ratio"] for r in done.kpis.collect()}
    assert kpi["a", 2023] == 1.5


def test_reports_of_several_companies(spark):
    table = spark.createDataFrame([(d, "CO", y, 1, 0, i, c) for d, y, v in [("r1", 2023, "5"), ("r2", 2024, "6"), ("r3", 2024, "7")]
                                   for i, c in enumerate([["Concepto", str(y), str(y - 1)], ["Efectivo", v, "1"]])], schema.CELLS)
    whose = spark.createDataFrame([("r1", "a", 2), ("r2", "a", 1), ("r3", "b", 1)], "doc string, ticker string, report_order int")
    result, _ = jobs.reports_to_financials(schema.empty(spark, schema.FINANCIALS), table, schema.empty(spark, schema.PAGES), "2026-01-01", reports=whose)
    assert {(r["ticker"], r["fiscal_year"]): r["cash"] for r in result.financials.collect()} == {
        ("a", 2023): 5.0, ("a", 2022): 1.0, ("a", 2024): 6.0, ("b", 2024): 7.0, ("b", 2023): 1.0}


def test_cells_are_parsed_once_and_no_text_moves(spark):
    table = cells(spark, [(1, 0, 0, ["Concepto", "2024", "2023"]), (2, 0, 1, ["Efectivo", "5 *", "4"])]).repartition(2, "row_no")
    # Fewer columns than the rows hold: the two readers of the exchange must still ask for the same ones.
    rows = statements.cell_rows(table).drop("country", "fiscal_year")
    assert [(r["label"], r["value"]) for r in rows.collect()] == [("Efectivo", 5.0)]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert all("cells" not in part.split("\n")[0] for part in plan.split("Exchange hashpartitioning(_key")[1:])


def test_costly_columns_are_compiled(spark):
    # An explode that held a higher-order function had every column beside it interpreted.
    for made in (statements.cell_rows(cells(spark, [(1, 0, 0, ["Efectivo", "5"])])), statements.extract_scans(pages(spark, ["Efectivo 7.000"], 1), "2026-01-01").values):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        steps = [line for line in plan.split("\n") if "Generate explode" in line and "_computed" in line]
        assert steps and all("_made" in line and "transform(" not in line and "rlike" not in line.lower() for line in steps)


def test_lines_without_digits_are_left_early(spark):
    texts = ["Estado de Resultados 2024\nsin valor\nEfectivo   x\nVentas netas   1.000\nInventarios\t(٣)"]
    assert found(statements.extract_lines(pages(spark, texts))) == {(2024, "revenue"): 1000.0}
    assert found(statements.extract_scans(pages(spark, texts, 1), "2026-01-01")) == {(2024, "revenue"): 1000.0}
    rows = statements._kind_rows(pages(spark, texts), "2026-01-01", ("text_lines",), None, None)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(raw" in plan


def moved(df):
    """Rows written by all exchanges of a finished plan."""
    def total(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return total(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return total(node.plan())
        if name == "ReusedExchangeExec":
            return 0
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(total(node.children().apply(i)) for i in range(node.children().size()))

    df.collect()
    return total(df._jdf.queryExecution().executedPlan())


def many_tables(n):
    """A report with a header every hundred tables, each table of one row."""
    return [(t // 50, t, t % 7, ["Concepto", "2024", "2023"] if t % 100 == 0 else ["", "dic 23", "dic 24"] if t % 250 == 0 else [f"Efectivo {t}", str(t), str(-t)])
            for t in range(n)]


def test_rows_of_a_short_report_move_once(spark):
    # Summaries of blocks, one for nearly every row, went to the report and back before.
    rows = statements.cell_rows(cells(spark, many_tables(2000)))
    assert 1980 <= moved(rows) <= 2010
    got = {r["label"]: (r["value"], r["value_before"]) for r in rows.collect()}
    turned = lambda t: t % 500 >= 250 and t // 100 == (t // 250 * 250) // 100
    assert all(got[f"Efectivo {t}"] == ((-t, t) if turned(t) else (t, -t)) for t in range(1, 2000) if t % 100 and t % 250)
    # A filter on a column of the key would have kept the two readers of the exchange from sharing it.
    assert moved(statements.cell_rows(cells(spark, many_tables(2000))).filter("doc = 'd' AND page >= 0")) <= 2010


def test_long_reports_are_cut(spark, monkeypatch):
    table = cells(spark, many_tables(700)).unionByName(
        spark.createDataFrame([(None, "CO", 2024, 1, 0, i, c) for i, c in enumerate([["Concepto", "2023", "2024"]] + [["Efectivo", "5", "6"]] * 300)], schema.CELLS))
    short = sorted(map(str, statements.cell_rows(table).collect()))
    monkeypatch.setattr("ledgerline.operators.carry.SHORT", 200)
    long = statements.cell_rows(table)
    assert sorted(map(str, long.collect())) == short and len(short) == 692 + 300
    plan = long._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin [coalesce(doc" in plan and "ReusedExchange" in plan


def test_lines_and_pages_of_reports_move_once(spark):
    # Two aggregations, a window, the headings and a join moved them up to five times before.
    scans = [(f"s{i}", "CO", 2024, p, "", "Estado de Resultados 2022\nVentas netas 5.000 4.000\nCosa nueva 9.000", 1) for i in range(100) for p in (1, 2)]
    texts = [(f"t{i}", "CO", 2024, p, "Balance General\nEfectivo   1.000\n" + "palabra " * 10, None, 0) for i in range(50) for p in (1, 70)]
    df = spark.createDataFrame(scans + texts, "doc string, country string, fiscal_year int, page int, text string, recognised string, n_images int")
    found_values = statements.read_reports(cells(spark, []), df, "2026-01-01").values
    assert moved(found_values) <= 2 * (200 + 100) + 20  # a row for each page and each line of a known field
    assert {(r["method"], r["section"]) for r in found_values.collect()} == {("scan_lines", "income"), ("text_lines", "balance")} and found_values.count() == 250


def test_sections_found_beside_the_values(spark):
    # Against the look-up by block of pages, on pages at the ends of blocks, with two headings, gaps, two countries and no number.
    rng = random.Random(11)
    heads = ["Balance General", "Estado de Resultados", "Flujos de caja", "nada"]
    numbers = [0, 1, 5, 62, 63, 64, 65, 127, 128, 191, 192, 400, 1000, -1, -64, -65, None]
    text = lambda: rng.choice(heads) + "\n" + rng.choice(["Efectivo   5\nInventarios   6", "Ventas netas   9", "Total activos   4", "x"]) + "\n" + "palabra " * 10
    rows = [(f"d{d}", rng.choice(["CO", "CO", "PE"]), 2024, p, text(), 0) for d in range(40) for p in rng.sample(numbers, rng.randint(1, 8)) * rng.choice([1, 1, 2])]
    df = spark.createDataFrame(rows, schema.PAGES).localCheckpoint()
    table = spark.createDataFrame([(f"d{d}", "CO", 2024, rng.choice(numbers), 0, 0, [rng.choice(["Efectivo", "Total pasivos"]), "7"]) for d in range(0, 60, 2)], schema.CELLS)
    values = statements.read_reports(table, df, "2026-01-01").values
    by_blocks = statements._with_sections(values.drop("section"), df).select(*values.columns)
    assert values.count() > 60 and {r["section"] for r in values.collect()} == {"balance", "income", "cashflow", "unknown"}
    # A field on two rows of one page is read from either, so sections are compared by place.
    places = lambda x: sorted(set(map(str, x.select("doc", "page", "section").collect())))
    assert places(values) == places(by_blocks)
    scans = df.withColumn("n_images", F.lit(1))
    cut = statements.extract_scans(scans.withColumn("text", F.regexp_replace("text", "   ([0-9])", " $1.000")), "2026-01-01", max_pages=127).values
    kept = statements._with_sections(cut.drop("section"), df.filter("page <= 127")).select(*cut.columns)
    assert cut.count() > 30 and places(cut) == places(kept)


def test_first_line_of_a_text_counts_whatever_its_amount(spark):
    df = pages(spark, ["Efectivo   1e999\n" + "palabra " * 10, "Efectivo   5"])
    assert found(statements.read_reports(cells(spark, []), df, "2026-01-01")) == {(2024, "cash"): float("inf")}
