"""Column names and Spark types shared by every job.

All companies live in one table keyed by ``(ticker, fiscal_year)``; a statement field that a company
does not report is a null, never a missing column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The statement fields in output order.
STATEMENT_FIELDS = [
    "revenue", "gross_profit", "cogs", "operating_income", "net_income",
    "interest_expense", "depreciation_amortization",
    "total_assets", "total_liabilities", "total_equity",
    "current_assets", "current_liabilities",
    "cash", "short_term_investments", "receivables", "inventory",
    "long_term_debt", "short_term_debt", "accounts_payable", "shares_outstanding",
    "operating_cash_flow", "capex",
]

# Fields measured over a period; the others are balances at a date.
PERIOD_FIELDS = [
    "revenue", "gross_profit", "cogs", "operating_income", "net_income",
    "interest_expense", "depreciation_amortization", "operating_cash_flow", "capex",
]

BALANCE_FIELDS = [f for f in STATEMENT_FIELDS if f not in PERIOD_FIELDS]

KEYS = ["ticker", "fiscal_year"]


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
    "map<int,string>": T.MapType(T.IntegerType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``name type, name type``; unlike Spark's own reader this needs no session."""
    pairs = (c.split() for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FINANCIALS = struct(
    "ticker string, fiscal_year int, " + ", ".join(f"{f} double" for f in STATEMENT_FIELDS)
)

# One reported fact: a tag's value for one period in one filing. ``pos`` is its place in the filing's list.
FACTS = struct(
    "ticker string, tag string, unit string, pos int, form string, fp string, fy int, "
    "start date, end date, filed date, val double"
)

CELLS = struct(
    "doc string, country string, fiscal_year int, page int, table_no int, row_no int, cells array<string>"
)

PAGES = struct(
    "doc string, country string, fiscal_year int, page int, text string, n_images int"
)

# Values read off a report, one row per field.
EXTRACTED = struct(
    "doc string, country string, fiscal_year int, canonical string, value double, page int, "
    "section string, method string, comparative boolean"
)

CANDIDATES = struct(
    "label string, value double, page int, section string, company string, country string, pdf string, "
    "seen_count bigint, companies_seen array<string>, timestamp string"
)

LEARNED = struct("label string, canonical string, approved_by string, date string")

RUN_METADATA = struct(
    "ticker string, last_downloaded timestamp_ntz, last_processed timestamp_ntz, fy_count int, "
    "status string, error_message string, fields_missing string"
)

FX_RATES = struct("currency string, year int, rate double, approximated boolean")

COMPANY_META = struct(
    "slug string, name string, country string, url string, last_downloaded string, last_processed string, "
    "fiscal_years array<int>, fy_count int, status string, error_message string, extraction_method string, "
    "confidence string, approximated_fx boolean, ars_warning boolean, fields_missing array<string>, "
    "source_pdf_path string, red_flags_evaluated_at string, red_flags_count int, "
    "currency_original string, fx_rate_usd double"
)

PROFILES = struct(
    "slug string, domain string, last_success string, strategy string, pdf_url_pattern string, "
    "nav_path array<string>, doc_tier int, failed_ddgs_queries array<string>, "
    "historical_pdfs map<int,string>, t2_pdfs map<int,string>, notes string"
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``: absent ones null, order and types fixed.

    NaN becomes null on the way in: Spark sorts NaN above every number, so a NaN would satisfy any
    "greater than" rule.
    """
    have = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name not in have:
            c = F.lit(None).cast(field.dataType)
        else:
            c = F.col(field.name).cast(field.dataType)
            if isinstance(field.dataType, T.DoubleType):
                c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    return df.select(*out)


def conform_financials(df: DataFrame) -> DataFrame:
    return conform(df, FINANCIALS)


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
