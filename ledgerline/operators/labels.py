"""Statement labels to field names, and the review of labels nobody knows yet.

A label is matched where it stands: one regular expression finds, at every word start, the longest
synonym that begins there, and the best of those decides. No label is paired with every synonym, and no
exchange is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline import dimensions, fixed
from ledgerline.computed import computed
from ledgerline.functions.numbers import strip
from ledgerline.functions.text import fold, is_noise_label, regex_quote


def _key(synonyms: dict[str, list[str]] | None) -> tuple | None:
    return None if synonyms is None else tuple((k, tuple(v)) for k, v in synonyms.items())


def plain_label(label: Column) -> Column:
    """Lower case, no parenthesised parts, no accents."""
    return fold(F.regexp_replace(strip(F.lower(label)), r"\(.*?\)", ""))


def _word_pattern(key: tuple | None) -> str:
    by_first: dict[str, list[str]] = {}
    for word, _ in dimensions.ranked_synonyms(key):
        by_first.setdefault(word[0], []).append(word[1:])
    groups = (regex_quote(c) + "(?:" + "|".join(map(regex_quote, rest)) + ")" for c, rest in by_first.items())
    return "(?<![a-z])(?=((?:" + "|".join(groups) + ")(?![a-z])))"


def words_in(plain: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """For each word start of the label the longest synonym that stands there as whole words."""
    return F.regexp_extract_all(plain, F.lit(_word_pattern(_key(synonyms))), F.lit(1))


def _best_word(found: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The longest of the synonyms found, the first of the table among equals. Most labels hold one, which needs no rank."""
    words = F.array(*[F.lit(w) for w, _ in dimensions.ranked_synonyms(_key(synonyms))])
    rank = F.array_min(F.transform(found, lambda w: F.array_position(words, w)))
    return F.when(F.size(found) > 1, F.try_element_at(words, rank.cast("int"))).otherwise(F.get(found, F.lit(0)))


def field_by_words(plain: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Field of the longest synonym that stands in the label as whole words; null when none does."""
    ranked = dimensions.ranked_synonyms(_key(synonyms))
    words, fields = F.array(*[F.lit(w) for w, _ in ranked]), F.array(*[F.lit(f) for _, f in ranked])
    best = F.array_min(F.transform(words_in(plain, synonyms), lambda w: F.array_position(words, w)))
    return F.try_element_at(fields, best.cast("int"))


def map_labels(
    df: DataFrame, label: str = "label", learned: DataFrame | None = None,
    synonyms: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add ``canonical``: by whole words, else as a truncated synonym, else by an approved label.

    Approved labels are joined without a broadcast hint: Spark checks their size. Rejected ones map to
    nothing.
    """
    spark = df.sparkSession
    staged = computed(df, {"_plain": plain_label(F.col(label))})
    staged = computed(staged, {"_found": words_in(F.col("_plain"), synonyms)})
    word = _best_word(F.col("_found"), synonyms)
    cut = F.when(F.length("_plain") >= 8, F.concat(F.lit("cut "), "_plain"))
    staged = computed(staged, {"_key": F.when(F.size("_found") > 0, F.concat(F.lit("word "), word)).otherwise(cut)}, [c for c in staged.columns if c not in ("_plain", "_found")])
    staged = staged.join(F.broadcast(dimensions.synonym_keys(spark, _key(synonyms))), F.col("_key") == F.col("key"), "left")
    known = F.col("key_field")
    learned = dimensions.learned_synonyms(spark) if learned is None else learned
    approved = (
        learned.filter(F.col("canonical") != fixed.REJECTED)
        .groupBy(F.lower(strip(F.col("label"))).alias("_approved")).agg(F.max_by("canonical", "date").alias("_learned"))
    )
    # Rows that need no look-up get keys that match nothing and differ, so that they do not meet on null.
    nothing = F.concat(F.lit("\0"), F.xxhash64(*[c for c, kind in staged.dtypes if "map<" not in kind]).cast("string"))
    raw = F.coalesce(F.when(known.isNull(), F.lower(strip(F.col(label)))), nothing)
    return (
        staged.join(approved, raw == F.col("_approved"), "left")
        .withColumn("canonical", F.coalesce(known, F.col("_learned")))
        .drop("_key", "key", "key_field", "_approved", "_learned")
    )


def find_synonyms(learned: DataFrame, term: str) -> DataFrame:
    """Approved labels that contain a search term."""
    return learned.filter(F.lower("label").contains(term.lower()))


# --- labels to review -------------------------------------------------------------------------------

SIGHTING = ["label", "value", "page", "section", "company", "country", "pdf"]


def label_key(label: Column) -> Column:
    return F.lower(strip(label))


def sightings(unmatched: DataFrame, order: list[str], day: Column) -> DataFrame:
    """One row per unknown label and company: how often, first seen where, last seen when.

    ``order`` names the columns giving the order of sightings.
    """
    place = F.struct(*order)
    first = F.struct(*[F.col(c) for c in SIGHTING])
    return (
        unmatched.filter(~F.coalesce(is_noise_label(F.col("label")), F.lit(True)))
        .groupBy(label_key(F.col("label")).alias("key"), "company")
        .agg(F.count(F.lit(1)).alias("seen"), F.min_by(first, place).alias("first"), F.min(place).alias("at"),
             F.max(day).alias("day"))
    )


def candidates(seen: DataFrame) -> DataFrame:
    """One row per unknown label: total sightings, number of companies, the first sighting's details."""
    return (
        seen.groupBy("key").agg(
            F.sum("seen").alias("seen_count"), F.count(F.lit(1)).alias("n_companies"),
            F.min_by("first", "at").alias("first"), F.max("day").alias("timestamp"))
        .select("key", strip(F.col("first.label")).alias("label"), "first.value", "first.page", "first.section",
                "first.company", "first.country", "first.pdf", "seen_count", "n_companies", "timestamp")
    )


def companies_seen(seen: DataFrame) -> DataFrame:
    """Per label the distinct companies in order of first sighting, as an array for export.

    The array is as long as the label has companies; the store itself (:func:`merge_sightings`) holds them as rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "company")))
    return seen.groupBy("key").agg(F.transform(ordered, lambda x: x["company"]).alias("companies_seen"))


# The store of candidates has one row per label and company: ``key, company, seen, first, at, day`` as ``sightings`` gives
# them, with the batch before the place in it. It grows by partial aggregation; no label's companies ever meet.

def in_batch(seen: DataFrame, batch: int) -> DataFrame:
    """Sightings of one run, placed after those of all runs with a smaller number."""
    return seen.withColumn("at", F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("at").alias("at")))


def merge_sightings(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with the sightings of another run: counts add up, the first sighting stays, the last day counts."""
    return store.unionByName(fresh).groupBy("key", "company").agg(
        F.sum("seen").alias("seen"), F.min_by("first", "at").alias("first"), F.min("at").alias("at"), F.max("day").alias("day"))


def store_of(exported: DataFrame, batch: int = 0) -> DataFrame:
    """Exported candidates (``schema.CANDIDATES``) as rows of a store; a label's count goes to its first company."""
    first = F.struct(*[F.col(c) for c in SIGHTING])
    rows = exported.select(label_key(F.col("label")).alias("key"), first.alias("first"), F.col("seen_count"), F.col("timestamp").alias("day"),
                           F.posexplode(F.coalesce("companies_seen", F.array("company"))).alias("pos", "one"))
    found = rows.select("key", F.col("one").alias("company"), F.when(F.col("pos") == 0, F.col("seen_count")).otherwise(0).cast("bigint").alias("seen"), "first",
                        F.struct(F.col("pos").cast("bigint").alias("pos")).alias("at"), "day")
    return in_batch(found, batch)


def export_candidates(store: DataFrame) -> DataFrame:
    """Candidates as they are written to a file, companies as an array in order of first sighting."""
    listed = candidates(store).drop("n_companies").join(companies_seen(store), "key")
    return listed.select(*SIGHTING, "seen_count", "companies_seen", "timestamp")


def merge_candidates(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Exported candidates with those of another run. Details of the stored row stay; counts and companies add up."""
    return export_candidates(merge_sightings(store_of(stored), store_of(new, 1)))


def review_queue(cands: DataFrame, learned: DataFrame, min_seen: int = 2, force: list[str] | None = None,
                 ordered: bool = True) -> DataFrame:
    """Candidates worth a decision: seen often enough or asked for, not decided before, not noise."""
    decided = learned.select(label_key(F.col("label")).alias("_decided")).distinct()
    wanted = F.col("seen_count") >= min_seen
    if force:
        wanted = wanted | label_key(F.col("label")).isin([s.strip().lower() for s in force])
    out = (
        cands.filter(~is_noise_label(F.col("label")) & wanted)
        .join(decided, label_key(F.col("label")) == F.col("_decided"), "left_anti")
    )
    return out.orderBy(F.desc("seen_count"), "label") if ordered else out


def approve(learned: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add decided labels; a label already present keeps its first decision.

    ``decisions`` holds ``label, canonical, approved_by, date``.
    """
    new = (
        decisions.withColumn("label", label_key(F.col("label")))
        .groupBy("label").agg(F.min_by(F.struct("canonical", "approved_by", "date"), F.struct("date", "canonical")).alias("d"))
        .select("label", "d.*")
    )
    known = learned.select(label_key(F.col("label")).alias("label"))
    return learned.unionByName(new.join(known, "label", "left_anti").select(*learned.columns))


def reject(learned: DataFrame, labels: DataFrame, by: str, day: str) -> DataFrame:
    """Mark labels as decided without a field, so that they are not proposed again."""
    return approve(learned, labels.select(
        "label", F.lit(fixed.REJECTED).alias("canonical"), F.lit(by).alias("approved_by"), F.lit(day).alias("date")))


# --- confidence --------------------------------------------------------------------------------------

def critical_fields(country: Column) -> Column:
    """Array of the fields required in a country."""
    out = F.array(*map(F.lit, fixed.DEFAULT_CRITICAL_FIELDS))
    for code, fields in fixed.CRITICAL_FIELDS.items():
        out = F.when(country == code, F.array(*map(F.lit, fields))).otherwise(out)
    return out


def confidence(n_fields: Column, found: Column, country: Column) -> Column:
    """Alta / Media / Baja from the number of fields and whether all required ones are there."""
    complete = F.size(F.array_except(critical_fields(country), found)) == 0
    return F.when((n_fields >= 15) & complete, "Alta").when((n_fields >= 8) | complete, "Media").otherwise("Baja")


def score_extractions(extracted: DataFrame) -> DataFrame:
    """Per report and year: fields found, coverage of the 22 statement fields, required ones missing, confidence.

    At most 26 fields exist, so the collected set is small whatever the number of rows.
    """
    found = F.collect_set("canonical")
    return (
        extracted.groupBy("doc", "country", "fiscal_year", "method").agg(found.alias("found"))
        .select("doc", "country", "fiscal_year", "method",
                F.size("found").alias("n_fields"),
                (F.size("found") / F.lit(22.0)).alias("coverage"),
                F.array_sort(F.array_intersect(critical_fields(F.col("country")), "found")).alias("critical_found"),
                F.array_sort(F.array_except(critical_fields(F.col("country")), F.col("found"))).alias("critical_missing"),
                confidence(F.size("found"), F.col("found"), F.col("country")).alias("confidence"))
    )


