"""Connected components of a link table by rounds of local contraction.

In each round tasks first replace the links they hold by a spanning forest of stars around the smallest node. Then every
node moves to the neighbour (or itself) that comes first: by its number in one round, which takes a star up at once, and in
an order drawn anew in the next, which takes a constant share of the nodes away whatever the shape of the graph. No
component and no node's links are ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.durable import checkpointed

#: Links a task holds at a time.
FOREST_ROWS = 500_000


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each one's component."""
    label = np.arange(n)  # of a node: one in its tree; of the tree's smallest node: itself
    while len(a):
        root_a, root_b = label[a], label[b]
        low = np.minimum(root_a, root_b)
        np.minimum.at(label, root_a, low)  # whole trees move under a smaller one, so no link made before is lost
        np.minimum.at(label, root_b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to one node of each component that connect what the links a-b connect, one fewer than it has nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(nodes), at[: len(a)], at[len(a):])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= FOREST_ROWS:
            part = pd.concat(held)
            yield pd.DataFrame(dict(zip("ab", forest(part["a"].to_numpy(), part["b"].to_numpy()))))
            held, rows = [], 0
    if rows:
        part = pd.concat(held)
        yield pd.DataFrame(dict(zip("ab", forest(part["a"].to_numpy(), part["b"].to_numpy()))))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the links between the integer columns ``a`` and ``b``.

    Links with a null end and links of a node to itself connect nothing and bring no node. Repeated links count once.
    """
    def thinned(df: DataFrame) -> DataFrame:
        return checkpointed(df.mapInPandas(_local, "a long, b long").distinct().mapInPandas(_local, "a long, b long"))

    open_links = thinned(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    moves: list[DataFrame] = []
    while not open_links.isEmpty():
        place = (lambda c: F.xxhash64(c, F.lit(len(moves)))) if len(moves) % 2 else F.col
        ends = open_links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(
            open_links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        first = ends.groupBy("node").agg(F.min(F.struct(place("to").alias("order"), "to")).alias("first"))
        own = F.struct(place("node").alias("order"), F.col("node").alias("to"))
        move = checkpointed(first.select("node", F.least("first", own)["to"].alias("to")))
        moves.append(move)
        open_links = thinned(
            open_links.join(move.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("b_to")), "b")
            .where("a_to <> b_to")
            .select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
    if not moves:
        return links.sparkSession.createDataFrame([], "node long, component long")
    # Nodes of a later round are the targets of the round before, so the chain of moves ends at the component's last node.
    reached = moves[-1]
    for move in reversed(moves[:-1]):
        later = reached.select(F.col("node").alias("to"), F.col("to").alias("end"))
        reached = move.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    smallest = reached.groupBy("to").agg(F.min("node").alias("component"))
    return reached.join(smallest, "to").select("node", "component")
