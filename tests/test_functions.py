import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import links as L
from ledgerline.functions.numbers import (
    delta_text, kpi_text, local_kpi_text, magnitude_text, money_text, parse_number, ratio, strip_footnote,
)
from ledgerline.functions.text import (
    fold, is_contents_page, is_noise_label, is_pdf, is_scanned_page, opens_with, section_of, slug,
)
from ledgerline.functions.years import (
    default_report_year, header_years, is_stale, same_quarter, year_in_cell, year_in_text, year_of_file, year_of_link,
)

X = F.col("x")


@pytest.mark.parametrize("text,expected", [
    ("1.234.567,89", 1234567.89), ("(500.000)", -500000.0), ("1,234", 1.234), ("1.234", 1234.0), ("1.23", 1.23),
    ("119,056,418.774", 119056418774.0), ("1,234,567.89", 1234567.89), ("1,234,567", None), ("12.345.67", None),
    ("1.5d", None), ("", None), ("abc", None), ("  7 ", 7.0), ("1 000", 1000.0), ("-5,5", -5.5), ("()", None),
    ("nan", None), ("inf", None), ("1e3", 1000.0), (" 12 ", 12.0), (".5", 0.5), ("0", 0.0),
])
def test_parse_number(value, text, expected):
    assert value(parse_number(X), x=text) == expected


def read_number(text):
    """The rules restated for single texts."""
    s = text.strip().replace(" ", "")
    negative = s[:1] == "(" and s[-1:] == ")"
    s = s.strip("()")
    commas, dots = s.count(","), s.count(".")
    last = s.split(".")[-1]
    if commas and dots:
        if s.find(".") < s.find(","):
            s = s.replace(".", "").replace(",", ".")
        else:
            s = s.replace(",", "")
            if len(last) == 3 and last.isdigit():
                s = s.replace(".", "")
    elif commas:
        s = s.replace(",", ".")
    elif dots and len(last) == 3:
        s = s.replace(".", "")
    if "_" in s or any(c not in "0123456789.+-eE" for c in s):
        return None
    try:
        v = float(s)
    except ValueError:
        return None
    return -v if negative else v


def test_parse_number_random(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123456789.,() -e") for _ in range(rng.randint(1, 10))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", parse_number(X).alias("v")).collect()
    for r in rows:
        assert r["v"] == read_number(r["x"]), r["x"]


def test_ratio(value):
    assert value(ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(ratio(F.lit(1.0), F.lit(None).cast("double"))) is None
    assert value(ratio(F.lit(1.0), F.lit(4.0))) == 0.25


def test_texts(value):
    assert value(fold(X), x="  PERÍODO Ñandú ") == "periodo nandu"
    assert value(slug(X), x="Clínica Las Américas") == "clinica-las-americas"
    assert value(slug(X), x="EPS Sánitas (NUEVA)") == "eps-sanitas-nueva"
    assert value(slug(X), x="Organización Sanitas S.A.") == "organizacion-sanitas-s-a"
    for label, noise in (("Total", True), ("abc", True), ("2020", True), ("Suma ", True), ("Caja y bancos", False)):
        assert value(is_noise_label(X), x=label) is noise
    assert value(strip_footnote(X), x="1.234 *#") == "1.234"
    assert value(section_of(X), x="... BALANCE GENERAL y Estado de Resultados") == "balance"
    assert value(section_of(X), x="Estado de Flujo de Efectivo") == "cashflow"
    assert value(section_of(X), x="Notas") is None
    assert value(is_contents_page(X), x="Intro ........ 3") is True
    assert value(is_contents_page(X), x="Texto corrido. Fin.") is False
    assert value(opens_with(X, ["cierre"]), x="hola\n 4.2 Cierre del año") is True
    assert value(opens_with(X, ["cierre"]), x="\n" * 8 + "cierre") is False
    assert value(is_scanned_page(X, F.lit(1)), x="corto") is True
    assert value(is_scanned_page(X, F.lit(0)), x="corto") is False
    assert value(is_pdf(X), x=bytearray(b"%PDF-1.4 x")) is True
    assert value(is_pdf(X), x=bytearray(b"<html>")) is False


def test_number_texts(value):
    style = F.col("s")
    assert value(kpi_text(X, style), x=-0.1234, s="percentage") == "-12.3%"
    assert value(kpi_text(X, style), x=1.239, s="ratio_x") == "1.24x"
    assert value(kpi_text(X, style), x=2.5e9, s="dollar_B") == "$2.5B"
    assert value(kpi_text(X, style), x=45.2, s="days") == "45d"
    assert value(kpi_text(F.lit(None).cast("double"), F.lit("days"))) == "N/A"
    assert value(delta_text(X), x=0.05) == "+5.0%"
    assert value(local_kpi_text(X, style, F.lit("COP")), x=2.5e9, s="dollar_B") == "COP 2.5 miles de mill."
    assert value(money_text(X, F.lit("USD")), x=2.5e9) == "USD 2.50 B"
    assert value(money_text(X, F.lit("COP")), x=-3.21e6) == "COP -3.2M"
    assert value(money_text(X, F.lit("COP")), x=12345.0) == "COP 12,345"
    assert value(magnitude_text(X), x=4200.0) == "4.2K"


def test_years(value):
    now = F.lit(2026)
    for text, year in (("estados-financieros-2022.pdf", 2022), ("informe_gestion.pdf", None), ("x-2014.pdf", None),
                       ("x 2015", 2015), ("ESTADOSFINANCIEROSAO2020CROC.pdf", 2020), ("2028 2026", 2026), ("2018x 2019", 2019)):
        assert value(year_in_text(X, now), x=text) == year
    assert value(year_of_link(X, F.lit("2020"), now), x="/2025/03/EF-2024.pdf") == 2024
    assert value(year_of_link(X, F.lit("Informe 2020"), now), x="/2025/03/EF.pdf") == 2020
    for cell, hit in (("2024", True), ("dic-24", True), ("dic 24", True), ("dic-2024", True), ("2023", False), ("1024", False), (None, False)):
        assert value(year_in_cell(F.lit(2024), F.lit(cell).cast("string"))) is hit
    for a, b, same in (("2026-01-01", "2026-03-31", True), ("2026-03-31", "2026-04-01", False), ("2026-12-31", "2027-01-01", False)):
        assert value(same_quarter(F.lit(a).cast("date"), F.lit(b).cast("date"))) is same
    assert value(is_stale(F.lit(None).cast("string"), "2026-01-01")) is True
    assert value(is_stale(F.lit("nonsense"), "2026-01-01")) is True
    assert value(is_stale(F.lit("2026-02-01 10:00:00"), "2026-01-01")) is False
    assert value(default_report_year("2026-06-30")) == 2024
    assert value(default_report_year("2026-07-01")) == 2025
    assert value(year_of_file(X, "2026-03-01"), x="inf2019-2020.pdf") == 2019
    assert value(year_of_file(X, "2026-03-01"), x="inf2012.pdf") == 2024


@pytest.mark.parametrize("text,expected", [
    ("DEL 2024\nDIC 2023 DIC 2024", (2024, 2023, False)), ("2024 Y 2023", (2024, 2023, True)),
    ("solo 2022", (2022, 2021, False)), ("nada", (2025, 2024, False)), ("2023\n2024", (2024, 2023, False)),
    ("x" * 900 + " 2024 2023", (2024, 2023, True)),
])
def test_header_years(value, text, expected):
    assert tuple(value(header_years(X, "2026-02-02"), x=text)) == expected
    short = expected if len(text) < 800 else (2025, 2024, False)
    assert tuple(value(header_years(X, "2026-02-02", span=800), x=text)) == short


def test_links(value):
    year = F.lit(2023)
    text = F.col("t")
    cases = [
        ("/a/Estados-Financieros-2023.pdf", "", 13), ("/a/x.pdf", "Balance General", 8), ("/balance-general/x.pdf", "", 5),
        ("/a/informe-anual.pdf", "", 5), ("/a/x.pdf", "Informe de Gestión 2023", 7), ("/memoria-anual/x.pdf", "", 2),
        ("/a/financiero-2022.pdf", "", 5), ("/a/x.pdf", "reporte", 1), ("/a/manual-2023.pdf", "", 0),
    ]
    for href, said, points in cases:
        assert value(L.score(X, text, year), x=href, t=said) == points, href
    assert value(L.tier(X), x="http://a/estados_financieros.pdf") == 1
    assert value(L.tier(X), x="http://a/rendición-de-cuentas.pdf") == 2
    assert value(L.tier(X), x="http://a/b.pdf") == 3
    assert value(L.is_partial_year(X), x="Infgestion-1-2025") is True
    assert value(L.is_partial_year(X), x="Primer informe") is True
    assert value(L.is_partial_year(X), x="informe-2025") is False
    full = L.relevance(X, F.lit("https://www.web.co/"), year, F.lit(200000))
    assert value(full, x="https://web.co/informe-2023.pdf") == 1.0
    assert value(L.relevance(X, F.lit("web.co"), year, F.lit(None).cast("int")), x="https://docs.web.co/manual.pdf") == pytest.approx(0.3)
    assert value(L.relevance(X, F.lit("web.co"), year, F.lit(None).cast("int")), x="https://other.org/reporte.pdf") == pytest.approx(0.3)
    assert value(L.on_domain(X, F.lit("a.com")), x="https://www.a.com/x") is True
    assert value(L.on_domain(X, F.lit("a.com")), x="https://ba.com/x") is False
    assert value(L.absolute(X, F.lit("https://a.com")), x="../x.pdf") == "https://a.com/x.pdf"
    assert value(L.absolute(X, F.lit("https://a.com")), x="/x.pdf") == "https://a.com/x.pdf"
    assert value(L.absolute(X, F.lit("https://a.com")), x="http://b/x") == "http://b/x"
    name = value(L.safe_file_name(X), x="https://a/download.php?id=3")
    assert name.endswith("_download.php.pdf") and len(name.split("_")[0]) == 8
    assert value(L.safe_file_name(X), x="https://a/Informe 2024.pdf/") == "Informe_2024.pdf"
    assert value(L.url_for_year(X, F.lit(2025)), x="https://a/*/ef-2024.pdf") == "https://a/2025/ef-2025.pdf"
    assert value(L.url_pattern(X, F.lit(2024)), x="https://a/ef2024.pdf") == "https://a/ef*.pdf"
    assert value(L.ends_as(X), x="/a.PDF#p") is True
    assert value(L.ends_as(X, fragment=False), x="/a.pdf#p") is False


def test_dates_are_arguments(value):
    assert value(default_report_year(F.lit(datetime.date(2020, 8, 1)))) == 2019


def test_relative_addresses_against_the_standard_library(spark):
    import random
    from urllib.parse import urljoin

    rng = random.Random(8)
    hrefs = ["/".join(rng.choice(["..", ".", "a", "b", "", "c.pdf"]) for _ in range(rng.randint(1, 6))) + rng.choice(["", "?x=1", "#t", "?x=/../y#z", "?", "#"])
             for _ in range(600)]
    hrefs = [h for h in hrefs if h and not h.startswith("/")]
    df = spark.createDataFrame([(h,) for h in hrefs], "href string")
    for r in df.select("href", L.absolute(F.col("href"), F.lit("https://h.co")).alias("full")).collect():
        assert r["full"] == urljoin("https://h.co/", r["href"]), r["href"]


def test_link_tags_in_every_form(spark):
    from ledgerline.operators import links as ops

    html = """<!-- <a href="/no">x</a> --><script>var a = '<a href="/no">';</script>
    <A HREF=/one.pdf class=x>One</A><a title='a "quoted" > b' href = "/two.pdf?a=1&amp;b=2#&#x74;">Two <b>bold</b> &lt;&amp;lt;&gt;</a>
    <a name=here>anchor</a><a\thref='/it"s' href="/second">three</a><li><a href="/four">four</li><li>after</li>
    <abbr href="/no">no</abbr><a data-href="/no">no</a><a href>empty</a><a href="/five>broken</a><p><a href="/six/">six
    <a href=/seven/>seven<p>text"""
    rows = ops.anchors(spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", ""), (4, "u", "<a href=x" * 3)], "page_id int, url string, html string")).orderBy("page_id", "ord").collect()
    assert [(r["page_id"], r["href"], r["text"]) for r in rows] == [
        (1, "/one.pdf", "One"), (1, "/two.pdf?a=1&b=2#t", "Two bold <&lt;>"), (1, '/it"s', "three"), (1, "/four", "four"), (1, "", "empty"),
        (1, "/five", "broken"), (1, "/six/", "six"), (1, "/seven/", "seven")]


def test_character_references(spark, value):
    from ledgerline.operators.links import plain_text

    for text, plain in [("&#225;&#xE1;&#x1F600;", "áá😀"), ("&amp;#39;&amp;amp;", "&#39;&amp;"), ("&#0;&#xD800;&#9999999;", "�" * 3), ("a & b &copy;", "a & b &copy;")]:
        assert value(plain_text(F.col("t")), t=text) == plain


def test_numbers_of_a_list_are_read_as_one_by_one(spark):
    from ledgerline.functions.numbers import parse_number, parse_numbers

    texts = ["1.234,5", "(1.000)", "(-5)", "1,5", "1.234.567", "12.5", "1,234.567", "1,234.56", "x", "", None, "()", "(7", "7)", "-(3)", " 4 5 ", "1e3", ".5", "(.500)", "1.2.3", "(1,5", "((2))", ".(01"]
    want = [1234.5, -1000.0, 5.0, 1.5, 1234567.0, 12.5, 1234567.0, 1234.56, None, None, None, None, 7.0, 7.0, None, 45.0, 1000.0, 0.5, -500.0, None, 1.5, -2.0, None]
    df = spark.createDataFrame([(texts,)], "t array<string>").select("t", parse_numbers(F.col("t")).alias("v"))
    assert df.first()["v"] == want
    assert [r["v"] for r in df.select(F.explode("t").alias("t")).select(parse_number(F.col("t")).alias("v")).collect()] == want


def test_header_years_where_years_stand_in_longer_words(value):
    text = "Informe 2024\n20245 2023\n2023-A2024 2023\n2023 y 2024\n2024 2023"
    assert tuple(value(header_years(X, "2026-02-02"), x=text)) == (2024, 2023, False)
    assert tuple(value(header_years(X, "2026-02-02"), x="al 2024\nal 2023")) == (2024, 2023, True)
