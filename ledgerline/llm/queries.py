"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import (best_fit, chat, fill_in_middle, hard_negatives, line_dedup, mixing, nearest, personal_data, quality, secrets, simhash_dedup,
                            token_matrix, tokens, toxicity)
from ledgerline.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality(spark, sf_dir):
    """Base counts, likelihood ratio and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op2_best_fit(spark, sf_dir):
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return best_fit.packed(table(spark, sf_dir, "documents"), tokens.word_vocabulary())


@query
def op3_personal_data(spark, sf_dir):
    """Base counts, a digest of the base spans and all spans of every document."""
    found = personal_data.find(table(spark, sf_dir, "documents"), personal_data.examples_table(spark))
    base = F.filter("spans", lambda s: s["base"])
    counts = [personal_data.count_of(F.col("spans"), k).alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(personal_data.digest(base), 256).alias("base_sha256"),
                        personal_data.digest(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


@query
def op4_line_dedup(spark, sf_dir):
    """Every line with words of every document: the first occurrence of its group, and whether it is that one."""
    return line_dedup.occurrences(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "line", F.col("first.id").alias("first_doc_id"), F.col("first.line").alias("first_line"), "kept")


@query
def op5_nearest(spark, sf_dir):
    """The twenty nearest vectors of every vector whose id is divisible by 20."""
    found = nearest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op6_token_matrix(spark, sf_dir):
    """The packed id matrices of all documents with cumulative segment lengths and positions."""
    return token_matrix.packed_matrix(table(spark, sf_dir, "documents"), tokens.word_vocabulary())


@query
def op7_secrets(spark, sf_dir):
    """Every candidate secret of every document with the forest's probability."""
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.findings_table(spark)).withColumnRenamed("id", "doc_id")


@query
def op8_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op9_toxicity(spark, sf_dir):
    """Score of every document by a model trained on the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score_documents(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_mixing(spark, sf_dir):
    """Every document with its probability under the target mix of sources, languages and topics, and whether it stays."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


@query
def op11_fill_in_middle(spark, sf_dir):
    """Cuts, form and digests of the rearranged and of the restored text of every document."""
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")).drop("output").withColumnRenamed("id", "doc_id")


@query
def op12_chat(spark, sf_dir):
    """Every conversation formatted, and what its output says of turns and learned texts."""
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.conversations(chat.chain(every)).select("conv", "formatted", chat.turns_of(F.col("formatted")).alias("turns"),
                                                        chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op13_hard_negatives(spark, sf_dir):
    """For every anchor (an id divisible by 100) and each of its positives, the hardest negatives in the positive's window."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)
