"""Hard negatives by vertical scans: branch and bound on decomposed vectors.

Components become whole numbers, so scores are exact. Vectors are dealt once into blocks of bounded size and stored by column:
one array a dimension, with its least and largest value. An anchor reads a block's dimensions in descending order of its own
magnitudes; what is still unread adds at least and at most the products with those extremes, and after every few dimensions
the bitmap of candidates loses the rows that these bounds rule out. For positives the bound to beat is the k-th best lower
bound so far. For negatives a row stays while its bounds meet the window of some positive in which it can still be among
the first; after the last dimension bounds are scores, and windows are resolved exactly.

Anchors are a stated share of the rows. They are taken in chunks of bounded size that every task of a pass receives; the
vectors are shuffled once, when blocks are made, and read once a pass. Only winners leave a task.

Edge cases: rows with a null id, label or vector, an empty vector, a null or non-finite component or one of 2^18 or more take no
part (beyond that, sums could leave 64 bits). Rows that repeat id, label and vector are one row; an anchor never meets a row
with its own id, and rows that share an id with another label or vector are rows of their own. Vectors meet vectors of
their own length only. Ties go to the smaller id. A positive with a score below zero has an empty window. An anchor without
positives, and an empty table, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.llm.durable import stored

POSITIVES, NEGATIVES = 5, 10
#: Percentages of the positive's score between which a negative's score lies.
LEAST, MOST = 30, 90
SCALE, LARGEST = 256, 1 << 18
#: Vectors of a block, anchors of a pass, dimensions read between two looks at the bitmap.
BLOCK, ANCHORS, COLUMNS = 4096, 4096, 8

Judge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def whole_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``label`` and ``vector`` (whole numbers) of the rows that take part, each once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    taking = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fits))
    return taking.select("id", "label", F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")).alias("vector")).distinct()


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one length dealt into blocks of about ``size`` and turned: ids, labels, one array a dimension, and its extremes."""
    ways = {r["length"]: -(-r["count"] // size) for r in rows.groupBy(F.size("vector").alias("length")).count().collect()}  # a row for each length
    number = F.create_map(*[F.lit(x) for pair in ways.items() for x in pair])[F.size("vector")] if ways else F.lit(1)

    def turned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "label"])
        matrix = np.stack(frame["vector"].to_numpy()).astype("<i4").T
        return pd.DataFrame({"ids": [frame["id"].to_numpy("<i8").tobytes()], "labels": [frame["label"].to_numpy("<i8").tobytes()],
                             "columns": [[np.ascontiguousarray(c).tobytes() for c in matrix]], "low": [matrix.min(1).tolist()], "high": [matrix.max(1).tolist()]})

    dealt = rows.withColumn("length", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), number))
    made = dealt.groupBy("length", "block").applyInPandas(turned, "ids binary, labels binary, columns array<binary>, low array<long>, high array<long>")
    # A file for every few blocks, so that later passes are dealt to all cores.
    return stored(made.repartition(max(1, min(sum(ways.values()), 4096))))


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray


def read(frames: Iterator[pd.DataFrame]) -> Iterator[Block]:
    for frame in frames:
        for ids, labels, columns, low, high in zip(frame["ids"], frame["labels"], frame["columns"], frame["low"], frame["high"]):
            yield Block(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.stack([np.frombuffer(c, "<i4") for c in columns]),
                        np.asarray(low, np.int64), np.asarray(high, np.int64))


def scan(block: Block, anchor: np.ndarray, bitmap: np.ndarray, judge: Judge, step: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the candidates that ``judge`` (of lower and upper bounds) keeps to the end."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort([anchor * block.low, anchor * block.high], axis=0)[:, order]
    rest = ends.sum(1)[:, None] - np.cumsum(ends, axis=1)  # of the dimensions still unread, least and most
    at = np.flatnonzero(bitmap)
    score = np.zeros(len(at), np.int64)
    for start in range(0, len(order), step):
        if not len(at):
            break
        for d in order[start:start + step]:
            score += anchor[d] * block.columns[d][at]
        least, most = rest[:, min(start + step, len(order)) - 1]
        keep = judge(score + least, score + most)
        at, score = at[keep], score[keep]
    return at, score


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest of the values, None if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


@dataclass
class Best:
    """The first ``k`` rows within a window of scores among what was offered so far, and what a row has to reach to be one of them."""

    k: int
    low: int
    high: int
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def open(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which rows, by their bounds, can lie in the window and still be among the first."""
        reach = self.low
        if len(self.scores) == self.k:
            reach = max(reach, int(self.scores[-1]))
        sure = kth(least[(least >= self.low) & (most <= self.high)], self.k)
        return (most >= (reach if sure is None else max(reach, sure))) & (least <= self.high)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        ids, scores = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.scores, scores[inside]])
        first = np.lexsort([ids, -scores])[:self.k]
        self.ids, self.scores = ids[first], scores[first]


EVERY = (-(1 << 62), 1 << 62)


def search(ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], windows: list[list[tuple[int, int, int]]] | None, k: int):
    """A pass over blocks. Without ``windows``: the ``k`` best rows of each anchor's label; with them (name, low, high): the ``k``
    best rows of other labels in each window. Gives (anchor, name, id, score)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [[(0, Best(k, *EVERY))] if windows is None else [(name, Best(k, low, high)) for name, low, high in windows[i]] for i in range(len(ids))]
        for block in read(frames):
            for i in range(len(ids)):
                own = [best for _, best in held[i]]
                if not own or len(vectors[i]) != len(block.columns):
                    continue
                alike = block.labels == labels[i]
                bitmap = (alike if windows is None else ~alike) & (block.ids != ids[i])
                at, scores = scan(block, vectors[i], bitmap, lambda least, most: reduce(np.logical_or, [b.open(least, most) for b in own]))
                for best in own:
                    best.offer(block.ids[at], scores)
        found = [(i, name, best) for i in range(len(ids)) for name, best in held[i] if len(best.ids)]
        if found:
            times = [len(b.ids) for _, _, b in found]
            yield pd.DataFrame({"anchor": np.repeat([i for i, _, _ in found], times), "name": np.repeat([n for _, n, _ in found], times),
                                "id": np.concatenate([b.ids for _, _, b in found]), "score": np.concatenate([b.scores for _, _, b in found])})

    return run


FOUND = "anchor long, name long, id long, score long"


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and name, with their ``place``."""
    place = F.row_number().over(W.partitionBy("anchor", "name").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def window(score: int) -> tuple[int, int]:
    """Least and largest whole score of a negative beside a positive's."""
    return -(-LEAST * score // 100), MOST * score // 100


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, chunk: int = ANCHORS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on a column ``id``; ``label`` defaults to the column of that name.
    """
    rows = stored(whole_rows(vectors, F.col("label") if label is None else label, id_col, vector_col))
    table = blocks(rows, block)
    anchors = rows.where(is_anchor)
    passes = max(1, -(-anchors.count() // chunk))
    numbered = anchors.withColumn("pass", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(passes)))
    out = []
    for number in range(passes):
        # A chunk, whose size does not grow with the table, goes to every task.
        asked = numbered.where(F.col("pass") == number).orderBy("id", "label", "vector").collect()
        ids, labels = (np.array([r[c] for r in asked], np.int64) for c in ("id", "label"))
        own = [np.array(r["vector"], np.int64) for r in asked]
        near = first(table.mapInPandas(search(ids, labels, own, None, positives), FOUND), positives).collect()  # a few rows an anchor
        scores: list[set[int]] = [set() for _ in asked]
        for r in near:
            scores[r["anchor"]].add(r["score"])
        # Positives of one score share a window.
        windows = [[(s, *window(s)) for s in sorted(known) if s >= 0] for known in scores]
        hard = first(table.mapInPandas(search(ids, labels, own, windows, negatives), FOUND), negatives)
        pairs = rows.sparkSession.createDataFrame([(r["anchor"], int(ids[r["anchor"]]), r["id"], r["score"]) for r in near],
                                                  "anchor long, anchor_id long, positive_id long, name long")
        out.append(stored(pairs.join(hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"}), ["anchor", "name"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", F.col("name").alias("positive_score"), "negative_score")))
    return reduce(DataFrame.unionAll, out)
