"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of neighbouring words are hashed to ``BUCKETS``. Counts over all documents give the raw multinomial, counts
over trusted documents the target. A bucket's ratio is the log of its trusted count over the count expected at the raw share,
both raised by ``SHRINK``, so a bucket seen rarely says little. A document's score is the mean ratio of its n-grams, and it
is kept if no base rule fails and the score is ``THRESHOLD`` or more. Everything is a DataFrame operation.

The raw counts cover every document, the target every trusted one; the ratios, one a bucket, reach the tasks as one array that a document's
n-grams look up in place. Counts of buckets cross the network, and the texts whose id falls on a spot of the map of trusted ids, which
has a fixed size: trusted texts and few others meet their labels, in the same way at every size.

Edge cases: null and empty texts have no words and fail the base rules. Documents without n-grams score zero. Without trusted
documents all ratios are zero. Rows are scored one by one, so repeated rows and null ids keep their places. Labels that
contradict each other for an id are not trusted. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.computed import computed
from ledgerline.llm.durable import stored

BUCKETS = 1 << 18
#: Counts added to both sides of a ratio, and the least mean ratio that is kept.
SHRINK, THRESHOLD = 10.0, -0.11
#: Size of the map of trusted ids (1 MB of bits).
MAP_BITS = 23
#: Fixed values of the base rules.
WORD, SYMBOL, WINDOW = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]", 5
LEAST_WORDS, REPEATED_PERCENT = 10, 20


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``words`` and ``hashes`` (one for each word) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = computed(rows, {"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0))})
    return computed(words, {"hashes": F.transform("words", lambda w: F.xxhash64(w))})


def ngrams(hashes: Column) -> Column:
    """Buckets of the words and the pairs of neighbours."""
    n = F.size(hashes)
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.when(n > 1, F.concat(one, two)).otherwise(one)


def base_counts(words: DataFrame) -> DataFrame:
    """The rows of ``with_words`` as id, hashes and the base counts. Equal windows are recognised by a 64-bit hash."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    n = F.size("hashes")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)]))
    counted = computed(words, {
        "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"), "lines": lines,
        "windows": F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")),
    }, keep=["id", "hashes"])
    # Windows in order of their hash; only a text that repeats one is sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = computed(counted, {"placed": F.when(repeats, placed), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")},
                       keep=["id", "hashes", "n_words", "word_chars", "n_symbols"])
    last = F.size("placed") - 1
    twin = lambda x, i: ((i > 0) & (F.get("placed", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("placed", i + 1)["h"] == x["h"]))
    found = computed(sorted_, {"starts": F.sort_array(F.transform(F.filter("placed", twin), lambda x: x["i"]))},
                     keep=[c for c in sorted_.columns if c != "placed"])
    reach = F.transform("starts", lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - at, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    return found.select("id", "hashes", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def _spot(id_: Column) -> tuple[Column, Column]:
    """Page and bit of an id in a map of ids; bits beyond a page of 32768 are Spark's own pages."""
    at = F.pmod(F.xxhash64(id_.cast("string")), F.lit(1 << MAP_BITS))
    return F.shiftright(at, 15).cast("int"), at.bitwiseAND(32767)


def ids_map(ids: DataFrame) -> Column:
    """Which of 2 ** MAP_BITS spots hold an id: pages of bits, of fixed size whatever the number of ids."""
    page, bit = _spot(F.col("id"))
    pages = ids.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return pages.agg(F.map_from_entries(F.collect_list(F.struct("page", "bits"))).alias("pages")).scalar()


def may_hold(pages: Column, id_: Column) -> Column:
    """The id's spot is set: true for every id of the map, and for few others while the map is mostly empty."""
    page, bit = _spot(id_)
    byte = F.conv(F.hex(F.substr(F.try_element_at(pages, page), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           shrink: float = SHRINK) -> DataFrame:
    """``bucket`` and ``ratio`` of every bucket that occurs."""
    good = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
            .groupBy("id").agg(F.min("label").alias("label")).where("label = 1").select("id", F.lit(1).alias("good")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Only texts whose id may be trusted meet the labels; the same join at every size. Null ids are never trusted.
    marked = rows.where(F.col("id").isNotNull() & may_hold(ids_map(good), F.col("id")))
    trusted = marked.join(good.withColumn("id", F.col("id").cast(dict(rows.dtypes)["id"])).hint("merge"), "id", "left_semi")
    buckets = lambda texts, own: with_words(texts, "id", "text").select(
        F.lit(own).alias("own"), F.explode(ngrams(F.col("hashes"))).alias("bucket"))
    each = buckets(rows, 0).unionAll(buckets(trusted, 1))
    counts = stored(each.groupBy("bucket").agg(F.count_if(F.col("own") == 0).alias("raw"), F.count_if(F.col("own") == 1).alias("target")))
    whole = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = (whole["target"] or 0) / (whole["raw"] or 1)
    return counts.select("bucket", F.log((F.col("target") + shrink) / (F.col("raw") * share + shrink)).alias("ratio"))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           threshold: float = THRESHOLD) -> DataFrame:
    """``id``, the base counts, ``base_failed``, ``score`` and ``kept`` of every document."""
    # Whole numbers, so that a score does not depend on the order of its summands; one a bucket, in their order.
    known = ratios(docs, labels, id_col, text_col, label_col).select("bucket", F.round(F.col("ratio") * 1e9).cast("long").alias("ratio"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    model = every.join(known, "bucket", "left").agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0)).alias("ratio")))).alias("model"))
    model = model.select(F.col("model")["ratio"].alias("model"))
    counts = base_counts(with_words(docs, id_col, text_col)).withColumn("ngrams", ngrams(F.col("hashes"))).drop("hashes")
    whole = F.aggregate("ngrams", F.lit(0).cast("long"), lambda total, bucket: total + F.get("model", bucket))
    scored = counts.withColumn("model", model.scalar()).withColumn("score", F.when(F.col("n_words") > 0, whole / 1e9 / (2 * F.col("n_words") - 1)).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return scored.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
                         (~failed & (F.col("score") >= threshold)).alias("kept"))
