"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous steps.

Documents longer than a sequence are cut into full pieces and a rest; every piece is placed whole. Pieces are sorted by
length and gaps by size. A step places all pieces of one length, the longest first: a successor sweep goes over the gaps
from the smallest that holds the piece upwards, the pieces' ranks decide which piece takes which gap, the gaps shrink, and
the next step follows. Pieces that find no gap open sequences. This is best fit in decreasing order, whatever the number
of pieces.

Pieces of one length and gaps of one size are interchangeable, so a step works on runs of them. Their number is bounded by
the capacity (at most three new runs a step, at most ``capacity`` steps), not by the data: the driver sees the number of
pieces of each length and the runs, never a piece. What grows with the data, the sort and the ranks within a length, is
done by Spark: a length's pieces are dealt into about the square root of their number of buckets, counted, and
numbered from the counts of the buckets before, so that a length shared by a third of all documents is no single task.
The runs then go to all tasks (their bound makes that safe), and each piece finds its own place by length and rank.

Edge cases: null and empty texts are the end mark alone. Null ids and repeated rows are packed like others. An empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.llm.durable import stored
from ledgerline.llm.tokens import WIDTH, tokenizer

CAPACITY = 4096
END = 1
PLAN = "length int, first long, last long, sequence long, each long, offset long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece of every document."""
    mark = end.to_bytes(WIDTH, "little")
    size = capacity * WIDTH
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).ids
        for frame in frames:
            if not len(frame):
                continue
            row, number, length, check = [], [], [], []
            for i, text in enumerate(frame["text"]):
                ids = encode(text) + mark
                for n, at in enumerate(range(0, len(ids), size)):
                    part = ids[at:at + size]
                    row.append(i)
                    number.append(n)
                    length.append(len(part) // WIDTH)
                    check.append(crc32(part))
            out = frame[["id"]].iloc[row].reset_index(drop=True)
            yield out.assign(piece=number, start=pd.Series(number, dtype="int64") * capacity, length=length, ids_crc32=check)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(cut, "id string, piece int, start long, length int, ids_crc32 long")
    return found.withColumn("id", F.col("id").cast(kind))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end of ranks, first sequence, pieces for each, offset).

    Piece ``rank`` lies in sequence ``first sequence + (rank - first rank) // each``.
    """
    places: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # size of the gap: runs (first sequence, number of sequences)
    sizes: list[int] = []
    opened = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            if gap not in runs:
                runs[gap] = []
                insort(sizes, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]

        def fill(gap: int, first: int, number: int) -> None:
            """Place pieces into up to ``number`` sequences that have this gap."""
            nonlocal rank
            each = gap // length
            full = min(number, (end - rank) // each)
            if full:
                places.append((length, rank, rank + full * each, first, each, capacity - gap))
                rank += full * each
                leave(gap - each * length, first, full)
            if full < number and rank < end:
                places.append((length, rank, end, first + full, end - rank, capacity - gap))
                leave(gap - (end - rank) * length, first + full, 1)
                rank, full = end, full + 1
            leave(gap, first + full, number - full)

        at = bisect_left(sizes, length)
        while rank < end and at < len(sizes):
            gap = sizes.pop(at)  # what comes back is shorter than the piece, or the last of this step
            for first, number in runs.pop(gap):
                fill(gap, first, number)
            at = bisect_left(sizes, length)
        if rank < end:
            each = capacity // length
            number = -(-(end - rank) // each)
            first, opened = opened, opened + number
            fill(capacity, first, number)
    return places


def pack(found: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("id", "piece", "ids_crc32")) -> DataFrame:
    """``found`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset`` of every row."""
    spark = found.sparkSession
    sizes = found.groupBy("length").agg(F.count(F.lit(1)).alias("pieces"))
    counts = {r["length"]: r["pieces"] for r in sizes.collect()}  # at most ``capacity`` rows
    ways = spark.createDataFrame([(n, max(1, round(c ** 0.5))) for n, c in counts.items()], "length int, ways int")
    dealt = found.join(F.broadcast(ways), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), "ways")).drop("ways")
    before = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    places = spark.createDataFrame(plan(counts, capacity), PLAN).withColumnRenamed("offset", "base")
    skipped = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & F.col("rank").between(F.col("first"), F.col("last") - 1)).select(
        *[found[c] for c in found.columns], (F.col("sequence") + F.floor(skipped / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (skipped % F.col("each")) * found["length"]).alias("offset"))


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: where it lies in the document and in which sequence, at which offset."""
    found = stored(pieces(docs, vocabulary, id_col, text_col, capacity))
    return pack(found, capacity).select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
