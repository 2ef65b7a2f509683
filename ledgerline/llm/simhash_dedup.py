"""Near duplicates by SimHash: a self-join of binary tries over the fingerprints.

A fingerprint has 64 bits; two link if they differ in at most ``budget`` (3). Cut into ``budget + 1`` blocks, two linked
fingerprints share a block, so each fingerprint enters one trie per block, turned so that this block comes first. Below
the shared block a trie is joined with itself: pairs of nodes are traversed together from level to level, the differing
bits of their paths are added up, and a pair is pruned when they exceed the budget. Node pairs with few fingerprints
below are finished inside a task; pairs with many are first traversed further as rows of a table, a byte of levels at a
time, so that a crowded part of the trie is dealt out over the cluster.

The nodes are distinct fingerprints: any number of equal texts is one node. Each task returns a spanning forest of the
links it found, not the links, which keeps what is connected and is never larger than what the task read.

Edge cases: null and empty texts have fingerprint zero and link like others. Repeated rows are all returned, each with
its component. A row without id gets the smallest id of its component (null if nobody there has one). An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh64_intdigest

from ledgerline.llm.components import components, forest
from ledgerline.llm.durable import checkpointed, stored
from ledgerline.llm.memory import memory

BITS, BUDGET = 64, 3
#: Fingerprints below a node pair that one task finishes; pairs with more are traversed further as rows.
LEAF = 512
#: Levels that a step over rows descends.
STEP = 8
#: Hash values that are counted at a time.
SLICE = 1 << 16
SEED = 42


def fingerprint_of(text: bytes | None, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` words: a bit is set if it is set in over half of their XXH64 values."""
    words = (text or b"").lower().split()  # both work on ASCII only: A-Z, and blanks 20, 09-0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, SLICE):
        part = words[start:min(n, start + SLICE) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        values = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.dtype("<u8"))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.dtype("<i8"))[0])


def fingerprint(text, width: int = 3):
    """Column of the fingerprints (as signed 64-bit numbers) of a text column."""
    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        memory("fingerprints")  # needs none: gives back what stages before remembered
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def turned(value, by: int):
    """A 64-bit column rotated left by ``by`` bits."""
    return value if by == 0 else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))


def prefix(value, depth: int):
    return F.shiftrightunsigned(value, BITS - depth) if depth < BITS else value


def trie_links(task: np.ndarray, side: np.ndarray, value: np.ndarray, depth: int, differing: np.ndarray, budget: int):
    """Positions of linked values: within each task, side 0 against side 1, or side 0 with itself if it is alone.

    ``value`` (unsigned) is distinct within a task's side; rows come sorted by task, side, value; all of a side share
    their first ``depth`` bits, which differ by ``differing`` between the sides.
    """
    starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[starts[1:], len(task)]
    one = side[starts] == 0
    # A side 0 is followed by its side 1 where there is one.
    paired = np.r_[(task[starts[1:]] == task[starts[:-1]]), False]
    lo_a, hi_a = starts[one], ends[one]
    follower = np.minimum(np.flatnonzero(one) + 1, len(starts) - 1)
    lo_b, hi_b = (np.where(paired[one], x[follower], y) for x, y in ((starts, lo_a), (ends, hi_a)))
    spent = differing[lo_a]
    for level in range(depth, BITS):
        same = lo_a == lo_b
        alive = ~(same & (hi_a - lo_a == 1))
        lo_a, hi_a, lo_b, hi_b, spent, same = (x[alive] for x in (lo_a, hi_a, lo_b, hi_b, spent, same))
        if not len(lo_a):
            break
        ones = np.r_[0, np.cumsum((value >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)]
        cut_a, cut_b = hi_a - (ones[hi_a] - ones[lo_a]), hi_b - (ones[hi_b] - ones[lo_b])
        children = (
            (lo_a, cut_a, lo_b, cut_b, spent, None), (cut_a, hi_a, cut_b, hi_b, spent, None),
            (lo_a, cut_a, cut_b, hi_b, spent + 1, None), (cut_a, hi_a, lo_b, cut_b, spent + 1, same))
        kept = []
        for a0, a1, b0, b1, d, twice in children:  # of a node with itself, zero-one and one-zero are the same pair
            ok = (a1 > a0) & (b1 > b0) & (d <= budget)
            if twice is not None:
                ok &= ~twice
            kept.append([x[ok] for x in (a0, a1, b0, b1, d)])
        lo_a, hi_a, lo_b, hi_b, spent = (np.concatenate(x) for x in zip(*kept))
    single = lo_a != lo_b
    return lo_a[single], lo_b[single]


def _finish(budget: int):
    """Turn rows (block, depth, task, side, value, spent) of whole tasks into forest links between fingerprints."""
    def batches(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole tasks, so many at a time that the pairs they could hold stay bounded."""
        sizes = rows.groupby("task", sort=False)["value"].size().to_numpy()
        weight = np.cumsum(sizes.astype(np.int64) ** 2) // (4 * LEAF * LEAF)
        edges = np.r_[0, np.cumsum(sizes)[np.flatnonzero(np.r_[weight[1:] != weight[:-1], True])]]
        for start, end in zip(edges[:-1], edges[1:]):
            yield rows.iloc[start:end]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        rows["value"] = rows["value"].to_numpy().view(np.uint64)
        for depth, same_depth in rows.groupby("depth"):
            for part in batches(same_depth.sort_values(["task", "side", "value"])):
                value = part["value"].to_numpy()
                a, b = trie_links(part["task"].to_numpy(), part["side"].to_numpy(), value, int(depth), part["spent"].to_numpy().astype(np.int64), budget)
                back = ((BITS - part["turn"].to_numpy()) % BITS).astype(np.uint64)
                own = (value << back) | np.where(back > 0, value >> ((np.uint64(BITS) - back) % np.uint64(BITS)), np.uint64(0))
                own = own.view(np.int64)
                if len(a):
                    yield pd.DataFrame(dict(zip("ab", forest(own[a], own[b]))))

    return run


def links(fingerprints: DataFrame, column: str, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """Links ``a``-``b`` that connect exactly what all links between the distinct values of ``column`` connect."""
    width = BITS // (budget + 1)
    distinct = fingerprints.select(F.col(column).alias("fp")).where("fp is not null").distinct()
    turns = F.explode(F.array(*[
        F.struct(F.lit(i * width).alias("turn"), turned(F.col("fp"), i * width).alias("value")) for i in range(budget + 1)]))
    tries = stored(distinct.select(turns.alias("t")).select("t.turn", "t.value"))

    def nodes(depth: int) -> DataFrame:
        return tries.groupBy("turn", prefix(F.col("value"), depth).alias("node")).count()

    pairs = checkpointed(nodes(width).where(F.col("count") > leaf).select(
        "turn", F.col("node").alias("node_a"), F.col("node").alias("node_b"), F.lit(0).alias("spent"),
        F.col("count").alias("n_a"), F.col("count").alias("n_b")))
    crowded = pairs.select("turn", F.col("node_a").alias("node"))
    plain = tries.withColumn("node", prefix(F.col("value"), width)).join(crowded, ["turn", "node"], "left_anti").select(
        F.xxhash64("turn", "node").alias("task"), "turn", "value",
        F.lit(0).alias("side"), F.lit(0).alias("spent"), F.lit(width).alias("depth"))
    tasks, depth = [plain], width
    while not pairs.isEmpty():
        below, depth = depth, min(BITS, depth + STEP)
        child = nodes(depth).withColumn("parent", prefix(F.col("node"), depth) if depth == below else F.shiftrightunsigned("node", depth - below))
        side_a = child.select("turn", F.col("parent").alias("node_a"), F.col("node").alias("child_a"), F.col("count").alias("m_a"))
        side_b = child.select("turn", F.col("parent").alias("node_b"), F.col("node").alias("child_b"), F.col("count").alias("m_b"))
        differing = F.col("spent") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b"))) - F.bit_count(F.col("node_a").bitwiseXOR(F.col("node_b")))
        grown = checkpointed(
            pairs.join(side_a, ["turn", "node_a"]).join(side_b, ["turn", "node_b"])
            .where((differing <= budget) & ((F.col("node_a") != F.col("node_b")) | (F.col("child_a") <= F.col("child_b"))))
            .where("not (child_a = child_b and m_a = 1)")
            .select("turn", F.col("child_a").alias("node_a"), F.col("child_b").alias("node_b"), differing.alias("spent"),
                    F.col("m_a").alias("n_a"), F.col("m_b").alias("n_b")))
        small = (F.col("n_a") + F.col("n_b") <= 2 * leaf) | F.lit(depth == BITS)
        ends = grown.where(small).select("turn", "spent", F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("node_a").alias("node")),
            F.struct(F.lit(1).alias("side"), F.col("node_b").alias("node")))).alias("end"),
            F.xxhash64("turn", "node_a", "node_b", F.lit(depth)).alias("task"), (F.col("node_a") == F.col("node_b")).alias("same"))
        ends = ends.where("not (same and end.side = 1)").select("turn", "spent", "task", "end.side", "end.node")
        tasks.append(ends.join(tries.withColumn("node", prefix(F.col("value"), depth)), ["turn", "node"]).select(
            "task", "turn", "value", "side", "spent", F.lit(depth).alias("depth")))
        pairs = grown.where(~small)
    rows = reduce(DataFrame.unionAll, tasks).select("task", "turn", "value", "side", "spent", "depth")
    return rows.repartition("task").mapInPandas(_finish(budget), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """``id_col``, ``fingerprint`` (signed 64 bits) and ``component`` (smallest id reachable over links) of every row."""
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")))
    reached = components(links(marked, "fp", budget, leaf), "a", "b")
    known = marked.groupBy("fp").agg(F.min("id").alias("least"))
    classes = known.join(reached, F.col("fp") == F.col("node"), "left").withColumn("class", F.coalesce("component", "fp"))
    least = classes.groupBy("class").agg(F.min("least").alias("first"))
    linked = checkpointed(classes.where("component is not null").join(least, "class").select("fp", F.col("first").alias("linked")))
    # Alone in its class, a fingerprint's first id is that of its own rows; a window would gather them, so it is looked up.
    first = known.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component"))
    return marked.join(first, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their component, with all their columns: those whose id is its smallest.

    Rows without id stay only if nobody in their component has one, one row a component; of rows that repeat an id
    one stays, the one with the smallest text.
    """
    # The document travels as one column, so its own column names clash with nothing here.
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(marked, "id", "text")
    heads = found.where(F.col("component").eqNullSafe(F.col("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("fingerprint").alias("fp"))
    kept = marked.join(heads.where("id is not null and rows = 1").select("id"), "id", "left_semi").select("doc")
    rest = marked.join(heads.where("id is not null and rows > 1").select("id"), "id", "left_semi").select("id", "text", "doc")
    alone = found.where("id is null and component is null").select("fingerprint").distinct()
    nameless = marked.where("id is null").withColumn("fingerprint", fingerprint(F.col("text"))).join(alone, "fingerprint", "left_semi").select("fingerprint", "text", "doc")
    one = [df.groupBy(key).agg(F.min_by("doc", F.struct("text", F.to_json("doc"))).alias("doc")).select("doc") for key, df in (("id", rest), ("fingerprint", nameless))]
    return kept.unionAll(one[0]).unionAll(one[1]).select("doc.*")
