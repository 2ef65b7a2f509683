"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, stop) over two immutable buffers, its own UTF-8 text and the sentinels.
Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels between them, and the inverse permutation
of the descriptors read off the output restores the text. Hashes run over the descriptors one after another; no text is copied
for them. Cut points and form come from a hash of the document's id, so a run repeats exactly on any cluster.

A token is a run of the letters A to Z in either case, or any other single character. Tokens are counted in blocks of bytes,
so what is held beside a text is bounded. Rows are independent: nothing is exchanged.

Edge cases: a null or empty text, and a text that holds a sentinel, stays as it is (form ``plain``). Rows without id draw as
an empty id. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The sentinels, and the percentages of documents that are rearranged and, of these, that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
REARRANGED, SUFFIX_FIRST = 90, 20
#: Pieces of a cut document: its three parts, then the sentinels; each form is a permutation of them.
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes whose tokens are counted at a time, and documents given back at a time.
BLOCK, SLICE = 1 << 20, 500

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class PieceTable:
    buffers: tuple[bytes, ...]
    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((text, b"".join(SENTINELS)), ((0, 0, len(text)),))

    def cut(self, number: int, at: int) -> PieceTable:
        """Piece ``number`` in two, the first of them ``at`` bytes long."""
        buffer, start, stop = self.pieces[number]
        both = ((buffer, start, start + at), (buffer, start + at, stop))
        return PieceTable(self.buffers, self.pieces[:number] + both + self.pieces[number + 1:])

    def with_sentinels(self) -> PieceTable:
        ends = np.cumsum([0, *map(len, SENTINELS)]).tolist()
        return PieceTable(self.buffers, self.pieces + tuple((1, a, b) for a, b in zip(ends, ends[1:])))

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        return (views[buffer][start:stop] for buffer, start, stop in self.pieces)

    def digest(self) -> str:
        found = sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.stream())


def token_starts(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of UTF-8 bytes: its place, and which of its bytes begin a token."""
    before = False
    for at in range(0, len(raw), BLOCK):
        part = raw[at:at + BLOCK]
        letter = ((part | 0x20) - np.uint8(97)) < 26
        follows = np.concatenate([[before], letter[:-1]])
        before = letter[-1]
        yield at, ((part & 0xC0) != 0x80) & ~(letter & follows)


def cut_points(text: bytes, draws: tuple[int, int]) -> tuple[int, int, int]:
    """The number of tokens and the two byte offsets at which prefix and middle end."""
    raw = np.frombuffer(text, np.uint8)
    counts = [int(np.count_nonzero(starts)) for _, starts in token_starts(raw)]
    n = sum(counts)
    ends = []
    for wanted in sorted(d % (n + 1) for d in draws):
        end, seen = len(text), 0
        if wanted < n:
            for (at, starts), count in zip(token_starts(raw), counts):
                if wanted < seen + count:
                    end = at + int(np.flatnonzero(starts)[wanted - seen])
                    break
                seen += count
        ends.append(end)
    return n, ends[0], ends[1]


def characters(text: bytes, start: int, stop: int) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8, stop - start, start) & 0xC0) != 0x80)) if stop > start else 0


def read(output: bytes, form: str) -> PieceTable:
    """The pieces of an output, in the output's order, found by its sentinels."""
    if form == "plain":
        return PieceTable((output,), ((0, 0, len(output)),))
    pieces: list[Piece] = []
    at = 0
    for piece in FORMS[form]:
        if piece > 2:
            # Parts hold no sentinel, so the first one found is the one that was put there.
            start = output.index(SENTINELS[piece - 3], at)
            if pieces:
                pieces.append((0, at, start))
            at = start + len(SENTINELS[piece - 3])
            pieces.append((0, start, at))
    return PieceTable((output,), (*pieces, (0, at, len(output))))


def restored(output: bytes, form: str) -> PieceTable:
    """The document that an output was made of, as pieces of the output."""
    found = read(output, form)
    return found if form == "plain" else found.arranged(tuple(FORMS[form].index(part) for part in range(3)))


def transform(text: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Tokens, form, characters of prefix and middle, and the arranged pieces of one text."""
    n, first, second = cut_points(text, draws[:2])
    if not text or any(s in text for s in SENTINELS) or draws[2] % 100 >= REARRANGED:
        return n, "plain", None, None, PieceTable.of(text)
    form = "spm" if draws[3] % 100 < SUFFIX_FIRST else "psm"
    cut = PieceTable.of(text).cut(0, first).cut(1, second - first).with_sentinels()
    return n, form, characters(text, 0, first), characters(text, first, second), cut.arranged(FORMS[form])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1) -> DataFrame:
    """``id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``output_sha256`` and ``restored_sha256`` of every row.

    ``epoch`` draws other cuts for another pass over the same documents.
    """
    kind = dict(docs.dtypes)[id_col]
    # A hash of the id, not of the text, so copies under other ids are cut elsewhere.
    draw = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(draw, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).select(
        F.col("id").cast("string").alias("id"), "text", *[number(k) for k in range(4)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), SLICE):
                part = frame.iloc[start:start + SLICE]
                out = []
                for text, *draws in zip(part["text"], part["h1"], part["h2"], part["h3"], part["h4"]):
                    n, form, prefix, middle, pieces = transform(text or b"", tuple(map(int, draws)))
                    whole = pieces.text()
                    out.append((n, form, prefix, middle, whole.decode("utf-8", "replace"), pieces.digest(), restored(whole, form).digest()))
                made = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
                made.insert(0, "id", part["id"].to_numpy())
                yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = rows.mapInPandas(run, "id string, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")
    return made.withColumn("id", F.col("id").cast(kind))
