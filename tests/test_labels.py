import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline import dimensions, fixed, schema
from ledgerline.operators import labels


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "label string")


def mapped(spark, texts, **kw):
    return {r["label"]: r["canonical"] for r in labels.map_labels(frame(spark, texts), **kw).collect()}


def test_known_surprises(spark):
    want = {
        "costo de ventas de servicios": "revenue", "otros ingresos": "revenue", "EBITDA": "operating_income",
        "total pasivos y patrimonio": "total_assets", "pasivos no corrientes": None, "Reingresos": None,
        "Ganancia o": "net_income", "Total activos": "total_assets", "Total activos no corrientes": "total_assets",
        "Período de cobro (días)": "dso", "INGRESOS (nota 12)": "revenue", "  Amortizaciones ": "depreciation_amortization",
        "efectivo": "cash", "flujo de efectivo de operaciones": "operating_cash_flow", "(nota)": None, "": None, "   ": None,
    }
    assert mapped(spark, list(want)) == want


def brute_force(label):
    plain = re.sub(r"\(.*?\)", "", label.lower().strip()).strip().translate(str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO))
    ranked = dimensions.ranked_synonyms()
    for word, field in ranked:
        if re.search(r"(?<![a-z])" + re.escape(word) + r"(?![a-z])", plain):
            return field
    for word, field in ranked:
        if len(plain) >= 8 and word.startswith(plain) and len(plain) / len(word) >= 0.30:
            return field
    return {a: b for a, b, _, _ in fixed.LEARNED_SYNONYMS}.get(label.strip().lower())


def test_mapping_against_all_synonyms(spark):
    rng = random.Random(11)
    words = [w for v in fixed.SYNONYMS.values() for w in v]
    texts = set(words) | {a for a, *_ in fixed.LEARNED_SYNONYMS}
    glue = [" ", " y ", "-", "", "x", " de ", ". ", " (nota) "]
    for _ in range(2500):
        a, b = rng.choice(words), rng.choice(words)
        cut = a[: rng.randint(3, len(a))]
        texts.add(rng.choice([cut, cut + rng.choice(glue) + b, b + rng.choice(glue) + cut, a.upper() + rng.choice(glue) + b[rng.randint(0, 5):]]))
    got = mapped(spark, sorted(texts))
    assert {t for t in texts if got[t] != brute_force(t)} == set()


def test_table_sizes():
    assert len(fixed.SYNONYMS) == 26 and sum(map(len, fixed.FIELD_TAGS.values())) == 60 and len(schema.STATEMENT_FIELDS) == 22
    assert set(fixed.FIELD_TAGS) == set(schema.STATEMENT_FIELDS) and len(schema.BALANCE_FIELDS) == 13


def test_own_synonyms_and_learned(spark):
    learned = spark.createDataFrame(
        [("Fondo Ñ (x)", "cash", "u", "2026"), ("ruido", fixed.REJECTED, "u", "2026")], schema.LEARNED)
    assert mapped(spark, ["fondo ñ (X)", "ruido", "ventas"], learned=learned) == {
        "fondo ñ (X)": "cash", "ruido": None, "ventas": "revenue"}
    own = mapped(spark, ["net sales total", "sales"], synonyms={"revenue": ["net sales", "sales"], "cash": ["total"]})
    assert own == {"net sales total": "revenue", "sales": "revenue"}


def test_label_join_is_broadcast_only(spark):
    plan = labels.map_labels(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


def test_candidates(spark):
    rows = [
        ("Fondo X", 1.0, 1, "balance", "b", "CO", "f1", 1, "2026-01-01"), ("fondo x ", 2.0, 2, "income", "a", "PE", "f2", 2, "2026-01-05"),
        ("FONDO X", 3.0, 3, "income", "b", "CO", "f3", 3, "2026-01-03"), ("Total", 3.0, 3, "income", "b", "CO", "f3", 4, "2026-01-03"),
        ("2020", 3.0, 3, "income", "b", "CO", "f3", 5, "2026-01-03"), ("Otro", 4.0, 1, "u", "c", "CO", "f", 6, "2026-01-03"),
    ]
    df = spark.createDataFrame(rows, "label string, value double, page int, section string, company string, country string, pdf string, ord int, day string")
    seen = labels.sightings(df, ["ord"], F.col("day"))
    got = {r["key"]: r for r in labels.candidates(seen).join(labels.companies_seen(seen), "key").collect()}
    assert set(got) == {"fondo x", "otro"}
    x = got["fondo x"]
    assert (x["label"], x["value"], x["seen_count"], x["n_companies"], x["companies_seen"], x["timestamp"]) == (
        "Fondo X", 1.0, 3, 2, ["b", "a"], "2026-01-05")
    stored = spark.createDataFrame([("fondo X", 9.0, 9, "s", "z", "CL", "p", 4, ["z", "a"], "2025-01-01")], schema.CANDIDATES)
    new = labels.candidates(seen).drop("n_companies").join(labels.companies_seen(seen), "key").select("key", *schema.CANDIDATES.fieldNames())
    merged = {r["label"]: r for r in labels.merge_candidates(stored, new).collect()}
    assert merged["fondo X"]["seen_count"] == 7 and merged["fondo X"]["companies_seen"] == ["z", "a", "b"] and merged["fondo X"]["value"] == 9.0
    learned = spark.createDataFrame([("OTRO", "cash", "u", "2026")], schema.LEARNED)
    assert [r["label"] for r in labels.review_queue(labels.candidates(seen), learned, 1).collect()] == ["Fondo X"]
    assert [r["label"] for r in labels.review_queue(labels.candidates(seen), schema.empty(spark, schema.LEARNED), 5, ["otro "]).collect()] == ["Otro"]


def test_decisions_are_kept(spark):
    learned = spark.createDataFrame([("a", "cash", "u", "1")], schema.LEARNED)
    more = spark.createDataFrame([("A ", "cogs", "u", "2"), ("b", "cogs", "u", "2")], schema.LEARNED)
    after = labels.reject(labels.approve(learned, more), frame(spark, ["b", "c"]), "u", "3")
    assert {(r["label"], r["canonical"]) for r in after.collect()} == {("a", "cash"), ("b", "cogs"), ("c", fixed.REJECTED)}


@pytest.mark.parametrize("found,country,level", [
    (schema.STATEMENT_FIELDS[:10] + ["operating_cash_flow", "inventory", "cash", "capex", "receivables"], "CO", "Alta"),
    (["revenue", "total_assets", "total_liabilities", "total_equity", "operating_cash_flow"], "CO", "Media"),
    (["revenue", "total_assets", "total_liabilities", "total_equity", "operating_cash_flow"], "PE", "Baja"),
    (["cash", "capex", "cogs", "inventory", "gross_profit", "receivables", "dso", "dpo"], "XX", "Media"), (["cash"], "CL", "Baja"),
])
def test_confidence(spark, found, country, level):
    df = spark.createDataFrame([("d", country, 2024, c, "m") for c in found], "doc string, country string, fiscal_year int, canonical string, method string")
    row = labels.score_extractions(df).first()
    assert row["confidence"] == level and row["n_fields"] == len(found) and row["coverage"] == pytest.approx(len(found) / 22)


def test_the_store_grows_run_by_run(spark):
    import random

    rng = random.Random(4)
    columns = "label string, value double, page int, section string, company string, country string, pdf string, ord int, day string"
    runs = [[(rng.choice(["Fondo X", "fondo x ", "Otro", "Cosa"]), float(i), 1, "s", rng.choice("abc"), "CO", f"f{run}-{i}", i, f"2026-0{run + 1}-{i:02d}")
             for i in range(1, 13)] for run in range(3)]
    store = None
    for number, rows in enumerate(runs):
        seen = labels.in_batch(labels.sightings(spark.createDataFrame(rows, columns), ["ord"], F.col("day")), number)
        store = seen if store is None else labels.merge_sightings(store, seen)
    want = {}
    for rows in runs:
        for label, value, *_, company, _, pdf, _, day in [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows]:
            entry = want.setdefault(label.strip().lower(), {"value": value, "n": 0, "companies": [], "day": ""})
            entry["n"] += 1
            entry["day"] = max(entry["day"], day)
            if company not in entry["companies"]:
                entry["companies"].append(company)
    got = {r["label"].lower(): (r["value"], r["seen_count"], r["companies_seen"], r["timestamp"]) for r in labels.export_candidates(store).collect()}
    assert got == {k: (v["value"], v["n"], v["companies"], v["day"]) for k, v in want.items()}
    again = labels.export_candidates(labels.store_of(labels.export_candidates(store)))
    assert sorted(map(str, again.collect())) == sorted(map(str, labels.export_candidates(store).collect()))
