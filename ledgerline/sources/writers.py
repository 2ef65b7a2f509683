"""Writers. Spark's commit protocol makes each replacement atomic per table or partition."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.fx import currency_of, is_approximated
from ledgerline.schema import FX_RATES, conform
from ledgerline.sources import readers


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in ``df``. Write all companies of a country that is touched.

    Rows of a partition meet in files of even size, however many it has. Never write to a path the same plan reads.
    """
    df.hint("rebalance", *by).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task; nulls are left out as by Spark's default."""
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str], expected: StructType) -> None:
    """Add the rows whose key is not stored yet; running it again adds nothing.

    The stored keys are read by the same job that appends, and Spark commits its files together, so a job that fails
    leaves the table as it was. Rows of ``df`` that share a key are one, the smallest.
    """
    stored = readers.read_table(df.sparkSession, path, expected, keys)
    rest = [c for c in expected.fieldNames() if c not in keys]
    once = conform(df, expected).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    once.alias("a").join(stored.alias("b"), reduce(and_, same), "left_anti").select(*expected.fieldNames()).write.mode("append").parquet(path)


def append_fx(new: DataFrame, path: str) -> None:
    """Add rates of currencies and years not stored yet."""
    append_new(new, path, ["currency", "year"], FX_RATES)


def company_meta(companies: DataFrame, completeness: DataFrame, years: DataFrame, confidence: DataFrame,
                 flags: DataFrame, rates: DataFrame, now: str) -> DataFrame:
    """Company records after a run.

    ``companies``: ``slug, name, country, url, fiscal_year, last_downloaded, source_pdf_path``;
    ``completeness`` and ``years`` by ticker; ``confidence``: ``slug, confidence, extraction_method``.
    """
    n_flags = flags.groupBy(F.col("ticker").alias("slug")).agg(F.count(F.lit(1)).cast("int").alias("red_flags_count"))
    missing = completeness.select(F.col("ticker").alias("slug"), "fields_missing")
    stored = years.select(F.col("ticker").alias("slug"), F.col("ascending").alias("fiscal_years"))
    currency = currency_of(F.col("country"))
    rate = rates.select(F.col("currency").alias("currency_original"), F.col("year").alias("fiscal_year"),
                        F.col("rate").alias("fx_rate_usd"), F.col("approximated").alias("_spot"))
    out = companies.withColumn("currency_original", currency)
    for part, on in ((stored, "slug"), (missing, "slug"), (n_flags, "slug"), (confidence, "slug"),
                     (rate, ["currency_original", "fiscal_year"])):
        out = out.join(part, on, "left")
    return out.select(
        "slug", "name", "country", "url", "last_downloaded", F.lit(now).alias("last_processed"),
        "fiscal_years", F.coalesce(F.size("fiscal_years"), F.lit(0)).alias("fy_count"),
        F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"),
        "extraction_method", "confidence",
        is_approximated(F.col("currency_original"), F.col("_spot")).alias("approximated_fx"),
        (F.col("country") == "AR").alias("ars_warning"), "fields_missing", "source_pdf_path",
        F.lit(now).alias("red_flags_evaluated_at"),
        F.coalesce("red_flags_count", F.lit(0)).alias("red_flags_count"), "currency_original",
        F.when(F.col("currency_original") == "USD", F.lit(1.0)).otherwise(F.col("fx_rate_usd")).alias("fx_rate_usd"))


def export_learned(learned: DataFrame, path: str) -> None:
    """Approved and rejected labels, in the form ``readers.read_learned`` reads."""
    write_json(learned.select("label", "canonical", "approved_by", "date"), path)


