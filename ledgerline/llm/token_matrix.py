"""Token-id output: best-fit-decreasing packing into id matrices, with segment lengths and position resets.

Each task walks over its documents, tokenises them, cuts those longer than a sequence into full pieces and a rest, and
packs a window of pieces at a time (``WINDOW`` tokens, so memory is bounded whatever the table's size): longest first, each
into the open sequence with the smallest sufficient capacity, which a segment tree over the sequences finds. No row
crosses the network. Every token of every document is written once; nothing is cut but overlong documents, whose pieces
carry their number, so the texts' ids come back whole (``documents_of``).

A sequence is a row of a matrix: ``capacity`` ids, padded at the end. ``cu_seqlens`` are the cumulative segment lengths
(first 0, last the tokens before the padding), ``positions`` count from 0 again at each segment.

Edge cases: null and empty texts are the end mark alone. Null ids and repeated rows are packed like others. An empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import UUID

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128

from ledgerline.llm.tokens import WIDTH, tokenizer

CAPACITY = 4096
END, PAD = 1, 0
#: Tokens that are packed together.
WINDOW = 1 << 21
SCHEMA = "sequence_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<string>, pieces array<int>"


class Capacities:
    """Segment tree over open sequences keyed by remaining capacity: how many sequences have each capacity.

    A node counts the sequences in its range of capacities, so the smallest capacity that suffices is found by walking up
    from the wanted leaf to the first right neighbour that holds something, then down its left side.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, sequence: int) -> None:
        self.open.setdefault(capacity, []).append(sequence)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the smallest capacity of ``least`` or more."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of the pieces in each sequence, longest first; equal lengths keep their order."""
    gaps, sequences = Capacities(capacity), []
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = gaps.take(lengths[at])
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        sequences[found[1]].append(at)
        if found[0] > lengths[at]:
            gaps.add(found[0] - lengths[at], found[1])
    return sequences


def matrix_rows(held: list[tuple[str | None, int, bytes]], capacity: int) -> pd.DataFrame:
    """The packed sequences of pieces (id, number, ids) as rows of ``SCHEMA``."""
    rows = []
    for own in best_fit_decreasing([len(p[2]) // WIDTH for p in held], capacity):
        parts = [held[i] for i in own]
        lengths = [len(p[2]) // WIDTH for p in parts]
        ids = b"".join(p[2] for p in parts)
        total = len(ids) // WIDTH
        ids += PAD.to_bytes(WIDTH, "little") * (capacity - total)
        ends = np.cumsum([0, *lengths])
        positions = np.arange(capacity, dtype="<i4") - np.repeat([*ends[:-1], total], [*lengths, capacity - total]).astype("<i4")
        # Named by content and documents: the same sequence gets the same name when a task is run again.
        name = xxh3_128(repr([p[:2] for p in parts]).encode() + ids).intdigest()
        rows.append((str(UUID(int=name)), total, len(parts), ids, ends.tolist(), positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def packed_matrix(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  end: int = END, window: int = WINDOW) -> DataFrame:
    """Sequences of ``capacity`` ids (little-endian unsigned 32 bits) with their segments and positions (signed 32 bits)."""
    mark, size = end.to_bytes(WIDTH, "little"), capacity * WIDTH

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).ids
        held: list[tuple[str | None, int, bytes]] = []
        tokens = 0
        for frame in frames:
            for key, text in zip(frame["id"], frame["text"]):
                ids = encode(text) + mark
                for number, at in enumerate(range(0, len(ids), size)):
                    held.append((key, number, ids[at:at + size]))
                    tokens += len(held[-1][2]) // WIDTH
                    if tokens >= window:
                        yield from batches(held)
                        held, tokens = [], 0
        if held:
            yield from batches(held)

    def batches(held) -> Iterator[pd.DataFrame]:
        rows = matrix_rows(held, capacity)
        for at in range(0, len(rows), 256):
            yield rows.iloc[at:at + 256]

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(pack, SCHEMA)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Store the sequences as Parquet with binary id and position columns, through Spark's commit protocol."""
    packed.write.mode("overwrite").parquet(path)


def documents_of(packed: DataFrame) -> DataFrame:
    """The pieces back from the sequences: ``doc_id``, ``piece``, ``ids``; a document's pieces in order are its ids."""
    each = packed.select("ids", "cu_seqlens", F.posexplode("doc_ids").alias("at", "doc_id"), "pieces")
    start, end = F.col("cu_seqlens")[F.col("at")], F.col("cu_seqlens")[F.col("at") + 1]
    return each.select("doc_id", F.col("pieces")[F.col("at")].alias("piece"), F.substring("ids", start * WIDTH + 1, (end - start) * WIDTH).alias("ids"))
