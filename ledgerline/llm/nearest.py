"""Nearest neighbours by largest inner product: inverted lists with adaptive dimension scans.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance; then they
are rotated at random, so that any first columns estimate the whole distance. An index of lists (k-means on a bounded
sample, every vector filed) is cut into blocks of bounded size, and queries into blocks as well; a task scans one block of
a probed list for one block of queries. The scan goes over column blocks: after each, a hypothesis test compares the
distance so far, scaled to all columns, with the distance of the query's k-th best, and abandons the candidate when it is
too large to come back. What survives all columns gets its inner product from the original vectors in double precision.

A query's k-th best is first taken from the sample, of which all are candidates, and falls while blocks are scanned. Rows
that repeat id and vector are filed once, the sample has one vector of an id, and every bound and cut counts ids.
``SHARE`` of the lists are probed, the nearest first (more if they hold few vectors): without clusters, as in vectors spread
evenly over a sphere, neighbours lie in most lists, and fewer would not reach a recall of 0.9.

Edge cases: ids or vectors that are null, zero, or hold null or non-finite components take no part, nor vectors whose length
is not the most frequent one. Ties go to the smaller id. Rows that share an id are one candidate, with the largest score
found, and one query, with the smallest vector; a query never finds its own id. With fewer candidates than k all are returned.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerline.llm.durable import stored

K = 20
#: Lists, vectors of the sample they are fitted on, share of lists probed, and rounds of k-means.
LISTS, SAMPLE, SHARE, ROUNDS = 64, 8192, 0.75, 12
#: Vectors and queries of a task; columns looked at between two tests; how sure a test is before it abandons.
BLOCK, QUERIES, COLUMNS, SURE = 2048, 2048, 16, 2.1
SEED = 7


@dataclass(frozen=True)
class Index:
    dimension: int
    largest: float  # norm
    rotation: np.ndarray
    centres: np.ndarray  # rotated
    sample_ids: np.ndarray
    sample: np.ndarray  # rotated
    sample_vectors: np.ndarray


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part, but for their length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def rotated(vectors: np.ndarray, index_rotation: np.ndarray, largest: float | None) -> np.ndarray:
    """With the norm's missing part as one more component (zero for queries, ``largest`` None), rotated."""
    missing = np.zeros(len(vectors)) if largest is None else np.sqrt(np.maximum(0, largest ** 2 - (vectors ** 2).sum(1)))
    return (np.column_stack([vectors, missing]) @ index_rotation).astype(np.float32)


def centres_of(points: np.ndarray, number: int, rounds: int, seed: int) -> np.ndarray:
    """k-means; a centre that loses all its points stays."""
    rng = np.random.default_rng(seed)
    points = points.astype(np.float64)
    centres = points[rng.permutation(len(points))[:number]].copy()
    for _ in range(rounds):
        own = nearest_centres(points, centres, 1)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_centres(points: np.ndarray, centres: np.ndarray, number: int) -> np.ndarray:
    return np.argsort((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1, kind="stable")[:, :number]


def fit(rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = SEED) -> Index | None:
    """The index's rotation and centres from one vector of at most ``sample`` ids, those with the smallest hash."""
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("most"))
    frequent = length.orderBy(F.desc("rows"), "n").first()
    if frequent is None:
        return None
    n, largest = frequent["n"], float(np.sqrt(frequent["most"]))
    own = rows.where(F.size("vector") == n)
    ids = own.select("id").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    chosen = own.join(ids, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").collect()
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((n + 1, n + 1)))
    points = rotated(np.array([r["vector"] for r in chosen]), rotation, largest)
    centres = centres_of(points, max(1, min(lists, len(points) // 8)), ROUNDS, seed)
    return Index(n, largest, rotation, centres, np.array([r["id"] for r in chosen]), points, np.array([r["vector"] for r in chosen]))


def file_vectors(rows: DataFrame, index: Index, id_col: str = "id") -> DataFrame:
    """Every vector with its list and its double components and rotated form as bytes."""
    def file(frames):
        for frame in frames:
            if len(frame):
                vectors = np.stack(frame["vector"].to_numpy())
                turned = rotated(vectors, index.rotation, index.largest)
                yield pd.DataFrame({"id": frame["id"], "list": nearest_centres(turned, index.centres, 1)[:, 0].astype(np.int32),
                                    "vector": [v.tobytes() for v in vectors], "turned": [v.tobytes() for v in turned]})

    return rows.where(F.size("vector") == index.dimension).mapInPandas(file, "id long, list int, vector binary, turned binary")


def ask(rows: DataFrame, index: Index, sizes: dict[int, int], k: int, share: float) -> DataFrame:
    """A row for each query and probed list: ``probed``, the query as bytes and its first bound on the k-th distance."""
    filled = np.array([sizes.get(i, 0) for i in range(len(index.centres))])

    def probe(frames):
        for frame in frames:
            if not len(frame):
                continue
            ids, vectors = frame["id"].to_numpy(), np.stack(frame["vector"].to_numpy())
            turned = rotated(vectors, index.rotation, None)
            away = ((turned ** 2).sum(1)[:, None] + (index.sample ** 2).sum(1) - 2 * turned @ index.sample.T)
            away[ids[:, None] == index.sample_ids] = np.inf
            bound = np.partition(away, k - 1, axis=1)[:, k - 1] if away.shape[1] >= k else np.full(len(ids), np.inf)
            order = nearest_centres(turned, index.centres, len(index.centres))
            seen = np.cumsum(filled[order], axis=1) - filled[order]  # ids in the lists before
            go = (np.arange(order.shape[1]) < share * order.shape[1]) | (seen < 8 * (k + 1))
            at, which = np.nonzero(go & (filled[order] > 0))
            yield pd.DataFrame({"query": ids[at], "probed": order[at, which].astype(np.int32), "bound": bound[at].astype(float) * (1 + 1e-4) + 1e-6,
                                "asked": [vectors[i].tobytes() for i in at], "asked_turned": [turned[i].tobytes() for i in at]})

    return rows.where(F.size("vector") == index.dimension).mapInPandas(probe, "query long, probed int, bound double, asked binary, asked_turned binary")


def among_sample(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """Each query's ``k`` best of the sample, whose distances gave the first bound: so nobody ends with fewer than these."""
    def look(frames):
        for frame in frames:
            if len(frame):
                ids, vectors = frame["id"].to_numpy(), np.stack(frame["vector"].to_numpy())
                score = vectors @ index.sample_vectors.T
                score[ids[:, None] == index.sample_ids] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                at, which = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
                some = np.isfinite(score[at, which])
                at, which = at[some], which[some]
                yield pd.DataFrame({"query": ids[at], "id": index.sample_ids[which], "score": np.einsum("ij,ij->i", vectors[at], index.sample_vectors[which])})

    return rows.where(F.size("vector") == index.dimension).mapInPandas(look, "query long, id long, score double")


def survivors(queries: np.ndarray, points: np.ndarray, bound: np.ndarray, columns: int, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, point, squared distance) that no test over the column blocks abandoned."""
    width = queries.shape[1]
    at: tuple[np.ndarray, np.ndarray] | None = None
    so_far = np.zeros((len(queries), len(points)), np.float32)
    for start in range(0, width, columns):
        q, p = queries[:, start:start + columns], points[:, start:start + columns]
        done = min(width, start + columns)
        most = bound if done == width else bound * done / width * (1 + sure / np.sqrt(done)) ** 2
        if at is None:
            so_far += np.maximum(0, (q ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * q @ p.T)
            keep = so_far <= most[:, None]
            if done == width or keep.mean() < 0.2:  # few are left: from here on pair by pair
                at = np.nonzero(keep)
                so_far = so_far[at]
            else:
                so_far[~keep] = np.inf
        else:
            so_far = so_far + ((q[at[0]] - p[at[1]]) ** 2).sum(1)
            keep = so_far <= most[at[0]]
            at, so_far = (at[0][keep], at[1][keep]), so_far[keep]
    return at[0], at[1], so_far


def _scan(k: int, columns: int, sure: float):
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            points, turned = (np.stack([np.frombuffer(b, t) for b in block[c]]) for c, t in (("vector", np.float64), ("turned", np.float32)))
            queries, q_turned = (np.stack([np.frombuffer(b, t) for b in asked[c]]) for c, t in (("asked", np.float64), ("asked_turned", np.float32)))
            ids, names, bound = block["id"].to_numpy(), asked["query"].to_numpy(), asked["bound"].to_numpy().copy()
            for start in range(0, len(ids), 512):
                q, p, away = survivors(q_turned, turned[start:start + 512], bound, columns, sure)
                p = p + start
                own = ids[p] != names[q]
                q, p, away = q[own], p[own], away[own]
                found = pd.DataFrame({"q": q, "query": names[q], "id": ids[p], "score": np.einsum("ij,ij->i", queries[q], points[p]), "away": away})
                found = found.sort_values(["q", "score", "id"], ascending=[True, False, True]).drop_duplicates(["q", "id"])
                found["n"] = found.groupby("q").cumcount()
                full = found[found["n"] == k - 1]
                # A slightly larger distance than measured, so that ties and rounding abandon nothing.
                np.minimum.at(bound, full["q"].to_numpy(), found[found["n"] < k].groupby("q")["away"].max().reindex(full["q"]).to_numpy() * (1 + 1e-4) + 1e-6)
                out.append(found[found["n"] < k])
        if not out:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        every = pd.concat(out).sort_values(["q", "score", "id"], ascending=[True, False, True]).drop_duplicates(["q", "id"])
        return every.groupby("q").head(k)[["query", "id", "score"]]

    return run


def dealt(df: DataFrame, key: str, value: list[str], sizes: dict[int, int], most: int, name: str) -> DataFrame:
    """``df`` with a block number by the hash of ``value``, so that a block of a ``key`` holds about ``most`` rows."""
    ways = F.coalesce(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, -(-n // most)))])[F.col(key)], F.lit(1)) if sizes else F.lit(1)
    return df.withColumn(name, F.pmod(F.xxhash64(*value), ways).cast("int"))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, lists: int = LISTS,
           sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score``: the ``k`` nearest found of every row for which ``is_query`` holds.

    ``is_query`` is a condition on a column ``id``.
    """
    rows = usable(vectors, id_col, vector_col)
    index = fit(rows, lists, sample)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    filed = stored(file_vectors(rows.distinct(), index))
    held = filed.groupBy("list", "id").count().groupBy("list").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("ids")).collect()  # one row a list
    sizes = {r["list"]: r["rows"] for r in held}
    wanted = rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = stored(ask(wanted, index, {r["list"]: r["ids"] for r in held}, k, share))
    askers = {r["probed"]: r["count"] for r in asked.groupBy("probed").count().collect()}
    blocks = {k_: max(1, -(-n // BLOCK)) for k_, n in sizes.items()}
    # Each block of a list meets each block of the queries that probe it.
    count = lambda numbers: F.create_map(*[F.lit(x) for k_, n in numbers.items() for x in (k_, n)])
    points = dealt(filed, "list", ["id", "vector"], sizes, BLOCK, "block").withColumn(
        "asked_block", F.explode(F.sequence(F.lit(0), F.coalesce(count({k_: max(1, -(-n // QUERIES)) for k_, n in askers.items()})[F.col("list")], F.lit(1)) - 1)))
    asks = dealt(asked, "probed", ["query"], askers, QUERIES, "asked_block").withColumn(
        "block", F.explode(F.sequence(F.lit(0), count(blocks)[F.col("probed")] - 1))).withColumnRenamed("probed", "list")
    keys = ["list", "block", "asked_block"]
    found = points.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(_scan(k, COLUMNS, SURE), "query long, id long, score double")
    found = found.unionAll(among_sample(wanted, index, k)).groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "id", "score")
