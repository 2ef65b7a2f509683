"""Mixing sources to target weights: iterative proportional fitting, then sampling by the calibrated probabilities.

The documents' tokens are summed for each combination of the dimensions (source, language, topic). Rounds of raking scale
these sums until each dimension's totals have the target shares; the tokens after raking over those before are a
combination's factor. A document stays with a probability proportional to its factor, the largest being one, so the
expected tokens of the sample have the target shares. The draw is a hash of the id: it is the same in every run.

Only sums for combinations go through the rounds, as tables; partial sums precede every exchange. The factors meet the
documents in a join whose plan follows from the stored table's size: broadcast while it is small, else by exchange.

Edge cases: null is a value of its own in each dimension. A value without target keeps its tokens; a target without documents
is ignored, the others share what is left in proportion. Texts without words have no tokens but share their combination's
fate; where a combination has none at all its factor is one. Without id the draw is by the text. Repeated rows stay or go
together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.durable import stored

#: Rounds at most, and the largest deviation (as a ratio less one) at which raking ends.
ROUNDS, TOLERANCE = 25, 1e-5
#: Values of a dimension up to which its totals are broadcast in a round; beyond, they meet by exchange.
BROADCAST = 100_000
SEED = 20240917
MARKS = ("_topic", "_tokens", "_probability", "_kept", "_doc")


def word_tokens(text: Column) -> Column:
    """Number of words as the measure of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def lexical_topic(text: Column) -> Column:
    """A coarse topic read off the whole text: kind of content, then length."""
    return (F.when(text.contains(" | "), "listing").when(text.contains("icensed under"), "licensed")
            .when(text.contains("@") | text.contains("token =") | text.contains("password="), "records")
            .when(F.length(text) < 1000, "short").when(F.length(text) < 10000, "prose").otherwise("long"))


def cells_of(docs: DataFrame, dimensions: list[str], tokens: str) -> DataFrame:
    return docs.groupBy(*dimensions).agg(F.sum(tokens).cast("double").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (``value``, ``share``): the present shares to a power below one, which lifts what is rare."""
    totals = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
    return totals.where("share > 0")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``factor``: raked tokens over tokens. ``targets``: for each dimension a table (value, share)."""
    names = list(targets)
    now, small = cells.withColumn("weight", F.col("tokens")), {}
    for i, name in enumerate(names):
        # The shares that meet a value, scaled to the tokens that have a target; what has none stays out of it.
        totals = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("total"))
        met = stored(totals.alias("t").join(targets[name].alias("s"), F.col("t.value").eqNullSafe(F.col("s.value")))
                           .where("total > 0").select("t.value", "total", "share"))
        whole = met.agg(F.sum("total").alias("total"), F.sum("share").alias("share"), F.count(F.lit(1)).alias("n")).first()
        small[name] = whole["n"] <= BROADCAST
        want = met.select("value", (F.col("share") / (whole["share"] or 1.0) * (whole["total"] or 0.0)).alias(f"want_{i}"))
        now = now.join(F.broadcast(want) if small[name] else want, F.col(name).eqNullSafe(F.col("value")), "left").drop("value")
    now = stored(now)
    for _ in range(rounds):
        off: list[Column] = []
        for i, name in enumerate(names):
            totals = now.where(f"want_{i} is not null").groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("have"))
            met = now.join(F.broadcast(totals) if small[name] else totals, F.col(name).eqNullSafe(F.col("value")), "left").drop("value")
            ratio = F.coalesce(F.when(F.col("have") > 0, F.col(f"want_{i}") / F.col("have")), F.lit(1.0))
            now = met.withColumn(f"ratio_{i}", ratio).withColumn("weight", F.col("weight") * F.col(f"ratio_{i}")).drop("have")
            off.append(F.abs(F.col(f"ratio_{i}") - 1))
        now = stored(now)
        worst = now.agg(F.max(F.greatest(*off, F.lit(0.0))).alias("off")).first()["off"] or 0.0
        now = now.drop(*[f"ratio_{i}" for i in range(len(names))])
        if worst <= tolerance:
            break
    return now.select(*cells.columns, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("factor"))


def probabilities(raked: DataFrame, dimensions: list[str]) -> DataFrame:
    """``dimensions`` and ``probability`` of staying, to twelve places."""
    largest = raked.agg(F.max(F.when(F.col("tokens") > 0, F.col("factor")))).first()[0] or 1.0
    return stored(raked.select(*dimensions, F.round(F.least(F.lit(1.0), F.col("factor") / largest), 12).alias("probability")))


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id alone, or on the text where there is none."""
    value = F.when(key.isNotNull(), F.xxhash64(F.lit(seed), key)).otherwise(F.xxhash64(F.lit(seed), text))
    return F.shiftrightunsigned(value, 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
          rounds: int = ROUNDS, with_doc: bool = False) -> DataFrame:
    """``docs`` with ``_topic``, ``_tokens``, ``_probability`` and ``_kept`` (which replace columns of these names).

    The target of a dimension (source, lang, topic) is its table in ``targets``, else its present shares to its power.
    """
    powers = {"source": 0.8, "lang": 0.8, "topic": 0.9} | (powers or {})
    dimensions = ["source", "lang", "topic"]
    # The document travels as one column, so its own column names clash with nothing here.
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), draw(F.col(id_col), F.col(text_col)).alias("draw"),
                         F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), word_tokens(F.col(text_col)).alias("tokens"),
                         (lexical_topic(F.col(text_col)) if topic is None else topic).alias("topic"))
    cells = stored(cells_of(marked, dimensions, "tokens"))
    wanted = {k: (targets or {}).get(k) for k in powers}
    wanted = {k: tempered(cells, k, powers[k]) if v is None else v for k, v in wanted.items()}
    chances = probabilities(rake(cells, wanted, rounds), dimensions).select(*[F.col(d).alias(f"cell_{d}") for d in dimensions], "probability")
    met = marked.join(chances, [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in dimensions])
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c not in MARKS]
    return met.select(*own, F.col("topic").alias("_topic"), F.col("tokens").alias("_tokens"), F.col("probability").alias("_probability"),
                      (F.col("draw") < F.col("probability")).alias("_kept"), *([F.col("doc").alias("_doc")] if with_doc else []))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    return mixed(docs, with_doc=True, **options).where("_kept").select("_doc.*")
