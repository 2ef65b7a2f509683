"""State between runs: upserts, staleness, missing years, run metadata, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import fixed
from ledgerline.functions.numbers import billions
from ledgerline.functions.years import as_date, is_stale

CENT = 0.0005


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Replace whole rows by key: rows of ``new`` win, and among them the last by ``order``.

    An aggregation picks the winner, so many versions of one key are reduced before they move.
    """
    rest = [c for c in existing.columns if c not in keys]
    order = order or []
    rank_old = F.struct(F.lit(0).alias("batch"), *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in order])
    rank_new = F.struct(F.lit(1).alias("batch"), *[F.col(c) for c in order])
    a = existing.select(*keys, F.struct(*rest).alias("row"), rank_old.alias("rank"))
    b = new.select(*keys, F.struct(*rest).alias("row"), rank_new.alias("rank"))
    return a.unionByName(b).groupBy(*keys).agg(F.max_by("row", "rank").alias("row")).select(*keys, "row.*").select(
        *existing.columns)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- years -------------------------------------------------------------------------------------------

def target_years(as_of, first: int = 1, last: int = 6) -> Column:
    """Array of completed years, newest first: ``first`` to ``last`` years back."""
    now = F.year(as_date(as_of))
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda n: (now - n).cast("int"))


def stored_years(financials: DataFrame) -> DataFrame:
    return financials.select("ticker", "fiscal_year").distinct()


def missing_years(companies: DataFrame, financials: DataFrame, as_of, first: int = 1, last: int = 6) -> DataFrame:
    """Target years a company has no row for."""
    wanted = companies.select("ticker", F.explode(target_years(as_of, first, last)).alias("fiscal_year"))
    return wanted.join(financials.select("ticker", "fiscal_year"), ["ticker", "fiscal_year"], "left_anti")


def backfill_plan(companies: DataFrame, financials: DataFrame, as_of, first: int = 1, last: int = 5) -> DataFrame:
    """Each target year: ``pending`` when absent or incomplete (then forced), else ``skipped``."""
    lacking = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fixed.BACKFILL_FIELDS])
    have = financials.groupBy("ticker", "fiscal_year").agg(F.bool_or(lacking).alias("incomplete"))
    wanted = companies.select("ticker", F.explode(target_years(as_of, first, last)).alias("fiscal_year"))
    plan = wanted.join(have, ["ticker", "fiscal_year"], "left")
    return plan.select(
        "ticker", "fiscal_year",
        F.when(F.col("incomplete").isNull() | F.col("incomplete"), "pending").otherwise("skipped").alias("status"),
        F.coalesce("incomplete", F.lit(False)).alias("forced"))


def backfill_progress(plan: DataFrame) -> DataFrame:
    """Per company: years done, total, and how many stand in each state."""
    states = ["ok", "low_conf", "skipped", "not_found", "error", "pending"]
    return plan.groupBy("ticker").agg(
        F.count_if(F.col("status") != "pending").alias("done"), F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in states])


def lacks_key_field(revenue: Column, total_assets: Column) -> Column:
    """Neither reading is trusted without revenue and total assets."""
    return (F.coalesce(revenue, F.lit(0.0)) == 0) | (F.coalesce(total_assets, F.lit(0.0)) == 0)


def backfill_outcome(requests: DataFrame, results: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of reading each requested year.

    ``requests``: ``ticker, year, forced, downloaded, error``; ``results``: ``ticker, year, ord, fiscal_year,
    confidence, revenue, total_assets`` (readings of the report fetched for that year). A reading of the
    year is preferred; another one is taken with low confidence. Without revenue or total assets the
    confidence is low.
    """
    wrong_year = (F.col("fiscal_year") != F.col("year")) | F.col("fiscal_year").isNull()
    picked = results.groupBy("ticker", "year").agg(F.min_by(
        F.struct(F.col("confidence"), wrong_year.alias("wrong_year"), "revenue", "total_assets"),
        F.struct(wrong_year.alias("w"), F.col("ord"))).alias("r"))
    have = stored.select("ticker", F.col("fiscal_year").alias("year")).distinct().withColumn("have", F.lit(True))
    joined = requests.join(have, ["ticker", "year"], "left").join(picked, ["ticker", "year"], "left")
    no_key = lacks_key_field(F.col("r.revenue"), F.col("r.total_assets"))
    sure = F.when(F.col("r").isNotNull(), F.when(F.col("r.wrong_year") | no_key, "Baja").otherwise(F.col("r.confidence")))
    skipped = F.coalesce("have", F.lit(False)) & ~F.col("forced")
    status = (
        F.when(skipped, "skipped").when(F.col("error").isNotNull(), "error").when(~F.col("downloaded"), "not_found")
        .when(F.col("r").isNull(), "error").when(sure == "Baja", "low_conf").otherwise("ok")
    )
    return joined.select(
        "ticker", "year", status.alias("status"),
        F.when(status.isin("ok", "low_conf"), sure).alias("confidence"),
        F.when(status == "error", F.coalesce("error", F.lit("no reading"))).alias("error_msg"))


# --- run metadata ------------------------------------------------------------------------------------

def staleness(companies: DataFrame, metadata: DataFrame, as_of, force: bool = False,
              outputs: DataFrame | None = None) -> DataFrame:
    """Whether each company must be loaded again: never loaded, loaded in another quarter, or forced.

    With ``outputs`` (companies whose results exist) a company without results is loaded too.
    """
    out = companies.select("ticker").join(metadata.select("ticker", "last_downloaded"), "ticker", "left")
    stale = is_stale(F.col("last_downloaded"), as_of) | F.lit(force)
    if outputs is not None:
        done = outputs.select("ticker").distinct().withColumn("_done", F.lit(True))
        out = out.join(done, "ticker", "left")
        stale = stale | F.col("_done").isNull()
    return out.select("ticker", "last_downloaded", stale.alias("needs_update"))


def merge_run_metadata(old: DataFrame, runs: DataFrame, now, message_length: int | None = None) -> DataFrame:
    """Run metadata after a batch; ``message_length`` cuts stored error messages.

    ``runs``: ``ticker, scraped, status, fy_count, error_message, fields_missing array``. A run that did not
    fetch, or failed, keeps the time of the last fetch.
    """
    stamp = now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")
    before = old.select("ticker", F.col("last_downloaded").alias("_before"), F.lit(True).alias("_known"))
    failed = F.col("status") == "error"
    keep = failed | (~F.col("scraped") & F.col("_known").isNotNull())
    new = runs.join(before, "ticker", "left").select(
        "ticker",
        F.when(keep, F.col("_before")).otherwise(stamp).alias("last_downloaded"),
        stamp.alias("last_processed"),
        F.when(failed, 0).otherwise(F.col("fy_count")).cast("int").alias("fy_count"),
        "status",
        (F.col("error_message") if message_length is None else F.substring("error_message", 1, message_length)).alias("error_message"),
        F.when(~failed, F.concat_ws(",", "fields_missing")).alias("fields_missing"))
    kept = old.join(runs.select("ticker"), "ticker", "left_anti")
    return stack([kept, new])


def batch_summary(runs: DataFrame) -> DataFrame:
    """Companies per status. The names themselves are the rows of ``runs``."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def merge_company_meta(old: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """New non-empty values over old ones, column by column; companies of either side are kept."""
    def filled(c: Column, type_name: str) -> Column:
        if type_name == "string":
            return F.nullif(c, F.lit(""))
        if type_name in ("int", "bigint", "double"):
            return F.nullif(c, F.lit(0).cast(type_name))
        if type_name.startswith(("array", "map")):
            return F.when(F.size(c) > 0, c)
        return c

    types = dict(old.dtypes)
    a, b = old.alias("a"), new.alias("b")
    out = []
    for c in old.columns:
        if c == key:
            continue
        value = F.coalesce(filled(F.col(f"b.{c}"), types[c]), F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
        out.append(value.alias(c))
    # What only the new record knows is taken as it is.
    out += [F.col(f"b.{c}") for c in new.columns if c not in old.columns and c != key]
    return a.join(b, key, "full").select(key, *out)


# --- corrections -------------------------------------------------------------------------------------
# A correction row is ``slug, fiscal_year, field, original, corrected_bn, field_confidence``, with the report's ``page`` where
# known: one form field, the value read (in units) and the value confirmed (in billions).

def original_billions() -> Column:
    return F.coalesce("original", F.lit(0.0)) / F.lit(1e9)


def unedited_low_confidence(corrections: DataFrame) -> DataFrame:
    """Fields of low confidence read as non-zero and left as they were: they block a confirmation."""
    o = original_billions()
    return corrections.filter(
        (F.col("field_confidence") == "Baja") & (o != 0) & (F.abs(F.col("corrected_bn") - o) < CENT))


def confirmable(corrections: DataFrame) -> DataFrame:
    """Corrections of the reports no field of which is blocked."""
    blocked = unedited_low_confidence(corrections).select("slug", "fiscal_year").distinct()
    return corrections.join(blocked, ["slug", "fiscal_year"], "left_anti")


def changed_fields(corrections: DataFrame) -> DataFrame:
    """Audit rows: fields whose confirmed value differs from the one read."""
    o = original_billions()
    c = F.coalesce("corrected_bn", F.lit(0.0))
    return corrections.filter(F.abs(c - o) > CENT).select(
        "slug", "fiscal_year", "field", o.alias("original_mmm"), F.col("corrected_bn").alias("corrected_mmm"))


def _each_field(corrections: DataFrame) -> DataFrame:
    """One row for each field of a report; of several the largest counts."""
    known = [c for c in ("original", "corrected_bn", "field_confidence", "page") if c in corrections.columns]
    return corrections.groupBy("slug", "fiscal_year", "field").agg(F.max(F.struct(*known)).alias("c")).select("slug", "fiscal_year", "field", "c.*")


def correction_audit(corrections: DataFrame, now: str) -> DataFrame:
    """Per report: whether anything was changed, and the changes by field (at most 16 fields exist)."""
    o = original_billions()
    changed = F.abs(F.coalesce("corrected_bn", F.lit(0.0)) - o) > CENT
    entry = F.struct(F.col("field"), F.struct(
        o.alias("original_mmm"), F.col("corrected_bn").alias("corrected_mmm"), F.lit(now).alias("validated_at")))
    return _each_field(corrections).groupBy("slug", "fiscal_year").agg(
        F.bool_or(changed).alias("human_validated"),
        F.map_from_entries(F.collect_list(F.when(changed, entry))).alias("human_validated_fields"))


def confirmation_record(corrections: DataFrame, now: str) -> DataFrame:
    """What a confirmation adds to a company's record: the audit, and each field's confidence and page as read.

    Merge it with :func:`merge_company_meta`; a later report of a company replaces an earlier one's entries.
    """
    page = F.col("page") if "page" in corrections.columns else F.lit(None).cast("int")
    fields = _each_field(corrections)
    if "page" not in fields.columns:
        fields = fields.withColumn("page", page)
    read = fields.groupBy("slug", "fiscal_year").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "field_confidence"))).alias("confidence_scores"),
        F.map_from_entries(F.collect_list(F.struct("field", "page"))).alias("source_pages"))
    both = read.join(correction_audit(corrections, now), ["slug", "fiscal_year"])
    rest = [c for c in both.columns if c != "slug"]
    latest = both.groupBy("slug").agg(F.max_by(F.struct(*rest), "fiscal_year").alias("r")).select("slug", "r.*")
    return latest.withColumn("confirmed_at", F.lit(now))


def corrected_values(corrections: DataFrame) -> DataFrame:
    """Confirmed values in units as extracted rows ``ticker, fiscal_year, canonical, value``."""
    canonical = F.create_map(*[F.lit(x) for k, v in fixed.DISPLAY_NAMES.items() for x in (v, k)])
    return corrections.select(
        F.col("slug").alias("ticker"), "fiscal_year", canonical[F.col("field")].alias("canonical"),
        (F.col("corrected_bn") * F.lit(1e9)).alias("value"))


def form_defaults(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """Form values in billions: the value read, or the stored one where nothing (or zero) was read.

    Both are long: ``ticker, fiscal_year, canonical, value``.
    """
    kept = stored.select("ticker", "fiscal_year", "canonical", F.col("value").alias("_stored"))
    read = F.coalesce("value", F.lit(0.0))
    raw = F.when((read == 0) & F.col("_stored").isNotNull(), F.col("_stored")).otherwise(read)
    return extracted.join(kept, ["ticker", "fiscal_year", "canonical"], "left").select(
        "ticker", "fiscal_year", "canonical", billions(raw).alias("value_bn"))


def edit_view(financials: DataFrame) -> DataFrame:
    """Stored rows as the correction form shows them: display names, sizes only, nulls as zero."""
    return financials.select("ticker", "fiscal_year", *[
        F.abs(F.coalesce(F.col(c), F.lit(0.0))).alias(d) for c, d in fixed.DISPLAY_NAMES.items()])
