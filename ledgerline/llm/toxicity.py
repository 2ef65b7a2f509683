"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

A document's features are the character n-grams (3 to 5, word ends marked, hashed to ``BUCKETS``) of its distinct words;
a feature's value is the number of these words that hold it, times a log ratio: how many toxic and how many clean
documents hold it, each against how many would if labels were dealt out at random. Both counts get a few documents more, so
a rare n-gram says little, and ratios near zero are left out. A logistic regression in which both classes weigh alike is
fitted to the scaled values. As the sum runs over words, a word's score is found once and remembered, so a long text costs
a look-up a word.

The fit takes at most ``SAMPLE`` labelled documents of each class, those with the smallest hash of their id; that and the
number of buckets bound what its task reads. The driver gets the weights alone. Every document is scored over its whole text.

Edge cases: null and empty texts get the score of the intercept. Rows are scored one by one, so repeated rows and null ids
keep their places. Labels that contradict each other for an id, null labels and labels without document teach nothing. If
either class has no document, the score is the share of toxic labels (0 without any). Only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from ledgerline.llm.memory import memory

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Labelled documents of each class that the fit takes at most.
SAMPLE = 2000
#: Documents added to the found and to the expected number of each class; least log ratio of a feature; ridge, steps and rate of the fit.
SHRINK, TELLING, RIDGE, STEPS, RATE = 6.0, 0.5, 0.02, 60, 0.1
#: Pull of the intercept towards -1: without evidence a text counts as clean.
LEAN = 0.05
#: Words a worker remembers.
REMEMBERED = 150_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: np.ndarray  # log ratio times coefficient of each bucket


def grams(word: str) -> list[int]:
    """Buckets of the n-grams of a word between its marked ends."""
    marked = f"<{EDGE.sub('', word)}>".encode()
    return [crc32(marked[i:i + n]) % BUCKETS for n in SIZES for i in range(len(marked) - n + 1)]


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and in how many distinct words each occurs."""
    found = np.fromiter((g for w in words_of(text) for g in set(grams(w))), np.int32)
    return np.unique(found, return_counts=True)


def fit(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Log-count ratios and a class-balanced logistic regression on the values they scale, by Adam over all rows."""
    positive = labels == 1
    if not positive.any() or positive.all():
        share = float(np.clip(positive.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
        return Model(float(np.log(share / (1 - share))), np.zeros(BUCKETS))
    held = np.zeros((2, BUCKETS))
    for label, (at, _) in zip(labels, rows):
        held[int(label), at] += 1
    n = np.array([(~positive).sum(), positive.sum()], float)
    expected = n[:, None] * held.sum(0) / n.sum()
    clean, toxic = np.log((held + SHRINK) / (expected + SHRINK))
    ratio = np.where(np.abs(toxic - clean) >= TELLING, toxic - clean, 0.0)
    telling = [ratio[a] != 0 for a, _ in rows]
    at = np.concatenate([a[t] for (a, _), t in zip(rows, telling)])
    row = np.repeat(np.arange(len(rows)), [t.sum() for t in telling])
    value = np.concatenate([n[t] for (_, n), t in zip(rows, telling)]) * ratio[at]
    importance = np.where(positive, 0.5 / n[1], 0.5 / n[0])
    coefficients, intercept = np.full(BUCKETS, 0.05), -1.0
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, value * coefficients[at], len(rows)) + intercept
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - positive) * importance
        slope = np.bincount(at, error[row] * value, BUCKETS) + RIDGE / len(rows) * coefficients
        slope = np.append(slope, error.sum() + LEAN * (intercept + 1))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        move = RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        coefficients, intercept = coefficients - 0.1 * move[:-1], intercept - move[-1]
    return Model(float(intercept), ratio * coefficients)


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled documents of each class that are not held out."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("label = 1").orderBy(*order).limit(sample).unionAll(known.where("label = 0").orderBy(*order).limit(sample))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            found = [features(t) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "at": [a.astype("<i4").tobytes() for a, _ in found],
                                "n": [c.astype("<i4").tobytes() for _, c in found]})

    def model(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("id")
        fitted = fit(got["label"].to_numpy(), [(np.frombuffer(a, "<i4"), np.frombuffer(n, "<i4")) for a, n in zip(got["at"], got["n"])])
        return pd.DataFrame({"intercept": [fitted.intercept], "weights": [fitted.weights.astype("<f4").tobytes()]})

    # At most two samples of ids are broadcast; one task fits as many rows of at most BUCKETS features each.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id", "label")), "id")
    read = texts.mapInPandas(rows, "id long, label int, at binary, n binary").groupBy("id").agg(F.min(F.struct("label", "at", "n")).alias("r"))
    found = read.select("id", "r.*", F.lit(0).alias("all")).groupBy("all").applyInPandas(model, "intercept double, weights binary").first()
    return fit(np.zeros(0), []) if found is None else Model(found["intercept"], np.frombuffer(found["weights"], "<f4"))


def scored(model: Model, text: Column) -> Column:
    """Column of the scores of a text column, from 0 to 1."""
    intercept, weights = model.intercept, model.weights.astype(np.float32)
    sent = SparkSession.active().sparkContext.broadcast((intercept, weights))
    owner = f"toxicity {crc32(weights.tobytes())}"

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        held = memory(owner)
        plain = held.setdefault("weights", sent.value[1].tolist() if "weights" not in held else None)
        remembered = held.setdefault("words", {})
        out = np.empty(len(texts))
        for i, text_ in enumerate(texts):
            words = sorted(words_of(text_))  # the same order of summands in every run
            try:
                total = sum([remembered[w] for w in words])
            except KeyError:
                if len(remembered) > REMEMBERED:
                    remembered.clear()
                for w in words:
                    if w not in remembered:
                        remembered[w] = sum(plain[g] for g in set(grams(w)))
                total = sum([remembered[w] for w in words])
            out[i] = sent.value[0] + total
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    score_col: str = "score", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with the column ``score_col`` (replacing one of that name), from a model trained on ``labels``."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    return docs.withColumn(score_col, scored(model, F.col(text_col)))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``limit``, with their own columns."""
    return docs.where(scored(train(docs, labels, id_col, text_col), F.col(text_col)) < limit)
