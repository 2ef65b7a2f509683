"""Fuzzy duplicate lines: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line is normalised to its lower-case words (letters, digits, underscores) joined by one blank; equal normalised lines are
one node, named by a 128-bit hash. Lines are candidates of each other if the SimHashes of their words differ in at most
three bits, found over shared blocks (``block_links``); they link if besides their edit similarity, one minus
the Levenshtein distance over the longer length, is ``similarity`` (0.8) or more. Of each connected group of lines only the
first occurrence stays, by document id, then line number.

Texts move only for lines that have a candidate (and the few whose hash falls on the same bit of a map of fixed size), and a set of candidates too large for one task is dealt out as pairs of
parts, so that every candidate pair meets in some task. Pairs that are connected already need no test; that changes no group.
Lines that occur once and link to none are their own first occurrence: nothing is joined to them but by their absence.

Edge cases: lines without words (blank, marks alone) are never removed. Null texts stay null. Rows without id stay as they
are and take no part. Rows that share id and text are one document and stay repeated. A document all of whose lines with
words were removed is dropped. Equal ids with different texts: the smaller text hash comes first. An empty table gives an
empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from ledgerline.llm.components import components, forest
from ledgerline.llm.durable import checkpointed, stored
from ledgerline.llm.memory import memory
from ledgerline.llm.simhash_dedup import BITS, BUDGET, links, prefix, turned

SIMILARITY = 0.8
#: Lines of a candidate set that one part holds.
PART = 512
#: Words whose bits are counted at a time.
SLICE = 1 << 17
#: Documents a task looks at together, and the size of the maps of candidates.
DOCUMENTS, MAP_BITS = 400, 24
#: SimHashes with a block in common that one task compares; and how many it compares without cutting the other blocks.
CROWD, FEW = 1 << 13, 64
WORD = re.compile(r"\w+")


def normalised(line: str) -> str:
    return " ".join(WORD.findall(line.lower()))


#: For an ASCII character, what stands for it: itself if it belongs to a word or ends a line, else a blank.
ASCII = {i: i if WORD.match(chr(i)) or chr(i) == "\n" else ord(" ") for i in range(128)}


def normalised_lines(text: str) -> list[str]:
    """``normalised`` of every line of a text, the whole text at a time."""
    low = text.lower()
    if low.isascii():
        low = low.translate(ASCII)
    else:
        held = memory("line characters")
        if not held:
            marks = [i for i in range(0x110000) if not (chr(i).isalnum() or chr(i) in "_\n")]
            held["stands"] = np.arange(0x110000, dtype="<u4")
            held["stands"][marks] = ord(" ")
        low = held["stands"][np.frombuffer(low.encode("utf-32-le"), "<u4")].tobytes().decode("utf-32-le")
    return [" ".join(line.split()) for line in low.split("\n")]


#: For a byte, its eight bits as the bytes of one number: sums of these count eight bits at a time, up to 255 of each.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.dtype("<u8"))[:, 0]


def simhashes(lines: list[str]) -> np.ndarray:
    """SimHash (signed 64 bits) of the distinct words of each normalised line; repeats would let the commonest words decide."""
    out = np.zeros(len(lines), np.int64)
    sizes = np.array([line.count(" ") + 1 for line in lines], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], len(lines)]):
        # Words are numbered, so that each is hashed once and a line's repeats are equal numbers.
        coded = pc.split_pattern(pa.array(lines[start:end], pa.large_string()), " ").flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        values = np.fromiter(map(xxh64_intdigest, words), np.dtype("<u8"), len(words))
        own = np.repeat(np.arange(end - start) * len(words), sizes[start:end]) + coded.indices.to_numpy()
        own.sort()
        line, word = np.divmod(own[np.r_[True, own[1:] != own[:-1]]], len(words))
        size = np.bincount(line, minlength=end - start)
        parts = -(-size // 255)  # stretches of a line that a lane can count
        first = np.repeat(np.cumsum(size) - size, parts)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        counted = np.add.reduceat(LANES[values.view(np.uint8).reshape(-1, 8)][word], first + 255 * within, axis=0)
        ones = np.add.reduceat(counted.view(np.uint8).astype(np.int32), np.cumsum(parts) - parts, axis=0)
        out[start:end] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.dtype("<i8"))[:, 0]
    return out


def near_pairs(value: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values (unsigned) of one group that differ in at most ``budget`` bits; rows of a group follow each other."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    end = np.repeat(starts + sizes, sizes)
    at, step = np.arange(len(value)), 1
    a, b = [at[:0]], [at[:0]]
    while len(at := at[at + step < end[at]]):
        near = at[np.bitwise_count(value[at] ^ value[at + step]) <= budget]
        a.append(near)
        b.append(near + step)
        step += 1
    return np.concatenate(a), np.concatenate(b)


def _near_values(value: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted values that share their first ``width`` bits and differ in at most ``budget`` of the others.

    Where many share them, the other bits are cut into blocks in the same way: of each pair that is near one is equal.
    """
    block = value >> np.uint64(BITS - width) if width < BITS else value
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, len(block)])
    group = np.repeat(np.arange(len(starts)), sizes)
    many = np.repeat(sizes > FEW, sizes)
    few = value[~many]
    a, b = near_pairs(few, group[~many], budget)
    pairs = [(few[a], few[b])]
    value, group = value[many], group[many]
    inner = (BITS - width) // (budget + 1)
    for i in range(budget + 1 if len(value) else 0):
        part = (value >> np.uint64(i * inner)) & np.uint64((1 << inner) - 1)
        order = np.lexsort((part, group))
        turned_to = value[order]
        a, b = near_pairs(turned_to, (group[order] << inner) | part[order].astype(np.int64), budget)
        pairs.append((turned_to[a], turned_to[b]))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _compare(budget: int):
    """Rows (turn, value: a SimHash turned by so many bits) of whole blocks into forest links between SimHashes."""
    width = BITS // (budget + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory("line blocks")
        held = [f for f in frames if len(f)]
        if not held:
            return
        for turn, value in pd.concat(held).groupby("turn")["value"]:
            ends = _near_values(np.sort(value.to_numpy().view(np.uint64)), width, budget)
            if turn:
                ends = [(x >> np.uint64(turn)) | (x << np.uint64(BITS - turn)) for x in ends]
            yield pd.DataFrame(dict(zip("ab", forest(*[x.view(np.int64) for x in ends]))))

    return run


def block_links(marks: DataFrame, column: str, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Links ``a``-``b`` that connect what all links (``budget`` bits or fewer) between the distinct values of ``column`` connect.

    Of the ``budget + 1`` blocks of two linked values one is equal, so values that share a block are compared in one task;
    those of blocks with more than ``crowd`` values are linked by ``simhash_dedup.links``, which deals them out further.
    """
    width = BITS // (budget + 1)
    blocks = marks.select(F.col(column).alias("fp"), F.explode(F.array(*[
        F.struct(F.lit(i * width).alias("turn"), turned(F.col(column), i * width).alias("value")) for i in range(budget + 1)])).alias("t")).select(
        "fp", "t.turn", "t.value", prefix(F.col("t.value"), width).alias("block"))
    crowded = checkpointed(blocks.groupBy("turn", "block").count().where(F.col("count") > crowd).select("turn", "block"))
    none = crowded.isEmpty()
    plain = blocks if none else blocks.join(crowded, ["turn", "block"], "left_anti")
    found = plain.repartition("turn", "block").select("turn", "value").mapInPandas(_compare(budget), "a long, b long")
    return found if none else found.unionAll(links(blocks.join(crowded, ["turn", "block"], "left_semi"), "fp", budget))


def shared_start(a: str, b: str) -> int:
    """How many characters two strings have in common from the start on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of two strings, or any number above ``most`` if it is larger; bit-parallel over columns."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    head = shared_start(a, b)
    a, b = a[head:], b[head:]
    tail = shared_start(a[::-1], b[::-1])
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    # Bits say where a cell is one more or one less than its neighbour above (rise, fall) or to the left (grow, drop).
    rise, fall, distance = full, 0, len(a)
    for at, c in enumerate(b):
        match = where.get(c, 0)
        level = match | fall
        carried = (((match & rise) + rise) ^ rise) | match
        grow, drop = fall | ~(carried | rise) & full, rise & carried
        distance += bool(grow & last) - bool(drop & last)
        if distance - (len(b) - 1 - at) > most:
            return most + 1
        grow, drop = (grow << 1 | 1) & full, (drop << 1) & full
        rise, fall = drop | ~(level | grow) & full, grow & level
    return distance


def similar(a: str, b: str, similarity: float) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    words_a, words_b = a.split(" "), b.split(" ")
    # Writing the words that differ anew, one for one, is one way to edit: where it is short enough, none is needed.
    if len(words_a) == len(words_b) and sum(max(len(x), len(y)) for x, y in zip(words_a, words_b) if x != y) <= most:
        return True
    return edit_distance(a, b, most) <= most


def spot(key: bytes) -> int:
    """Bit of a line key in a map of candidates."""
    return int.from_bytes(key[:3], "big")


def map_of(spots: DataFrame) -> np.ndarray:
    """Which of the 2 ** MAP_BITS numbers ``spot`` occur, eight to a byte: a map of fixed size, whatever the number of rows."""
    held = spots.select(F.shiftright("spot", 15).alias("page"), F.col("spot").bitwiseAND(32767).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in held.collect():  # at most 2 ** MAP_BITS / 32768 rows of 4 KB
        out[r["page"] * 4096:(r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def key_spots(lines: DataFrame) -> DataFrame:
    return lines.select(F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("long").alias("spot"))


def text_spots(lines: DataFrame) -> DataFrame:
    """Spots of the texts in which lines occur first."""
    return lines.select(F.shiftrightunsigned("first.hash", 64 - MAP_BITS).alias("spot"))


def lines_of(docs: DataFrame, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row for each line with words of docs (id, hash, text): its number, key and SimHash.

    With ``wanted``, maps of texts and of keys: key and normalised text of the lines of such texts whose spot is set.
    """
    kind = dict(docs.dtypes)["id"]

    def each(frame: pd.DataFrame) -> Iterator[tuple[int, int, str]]:
        for i, text in enumerate(frame["text"]):
            for n, plain in enumerate(normalised_lines(text)):
                if plain:
                    yield i, n, plain

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), DOCUMENTS):
                yield frame.iloc[at:at + DOCUMENTS]

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            found = list(each(frame))
            if found:
                row, number, words = zip(*found)
                distinct: dict[str, int] = {}
                at = [distinct.setdefault(w, len(distinct)) for w in words]
                keys = [xxh3_128_digest(w) for w in distinct]
                yield frame[["id", "hash"]].iloc[list(row)].reset_index(drop=True).assign(
                    line=number, key=[keys[i] for i in at], simhash=simhashes(list(distinct))[at])

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_text, in_key = wanted
        for frame in frames:
            at = frame["hash"].to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            chosen = frame[(in_text[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            for part in slices([chosen]):
                found = {key: words for _, _, words in each(part) if in_key[(at := spot(key := xxh3_128_digest(words))) >> 3] >> (at & 7) & 1}
                if found:
                    yield pd.DataFrame({"key": list(found), "words": list(found.values())})

    rows = docs.where("text is not null").select(F.col("id").cast("string").alias("id"), "hash", "text")
    if wanted is not None:
        return rows.select("hash", "text").mapInPandas(texts, "key binary, words string")
    return rows.mapInPandas(marked, "id string, hash long, line int, key binary, simhash long").withColumn("id", F.col("id").cast(kind))


def _verify(similarity: float, budget: int):
    """Rows (set, parts a and b, line, simhash, words), sorted so, into forest links between lines of one task: two parts of a set."""
    def linked(line: np.ndarray, value: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
        root = np.arange(len(line))
        for i in range(1, len(line)):
            near = np.flatnonzero(np.bitwise_count(value[:i] ^ value[i]) <= budget)
            while len(near := near[root[near] != root[i]]):
                j, near = near[0], near[1:]
                if similar(words[i], words[j], similarity):
                    yield line[i], line[j]
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory("line pairs")
        rest = None  # the task that the next frame may go on with
        for frame in itertools.chain(frames, [None]):
            rows = pd.concat([x for x in (rest, frame) if x is not None], ignore_index=True) if frame is not None else rest
            if rows is None or not len(rows):
                continue
            task = rows[["set", "part_a", "part_b"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]).any(axis=1)])
            if frame is not None:
                rest = rows.iloc[starts[-1]:]
            ends = starts[1:] if frame is not None else np.r_[starts[1:], len(rows)]
            line, value, words = rows["line"].to_numpy(), rows["simhash"].to_numpy().view(np.uint64), rows["words"].to_numpy()
            out = [pair for at, end in zip(starts, ends) if end > at + 1 for pair in linked(line[at:end], value[at:end], words[at:end])]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                budget: int = BUDGET, part: int = PART) -> DataFrame:
    """Every line with words: ``id``, ``hash`` (of the text), ``line``, the first occurrence of its group, whether it is that one."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).where("id is not null")
    seen = stored(lines_of(plain))
    distinct = stored(seen.groupBy("key").agg(F.first("simhash").alias("simhash"), F.min(F.struct("id", "hash", "line")).alias("first"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("node", F.monotonically_increasing_id()))
    marks = stored(distinct.groupBy("simhash").agg((F.count(F.lit(1)) > 1).alias("shared")))
    sets = components(block_links(marks, "simhash", budget), "a", "b").select(F.col("node").alias("simhash"), F.col("component").alias("set"))
    chosen = marks.where("shared").select("simhash").join(sets, "simhash", "full").select("simhash", F.coalesce("set", "simhash").alias("set"))
    candidates = stored(distinct.join(chosen, "simhash").select("key", "node", "simhash", "set", "first"))
    sizes = candidates.groupBy("set").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    # The two parts that meet in a task are an unordered pair; a line goes to every task that its part takes part in.
    own = F.pmod(F.xxhash64("node"), "parts").cast("int")
    tasks = candidates.join(sizes, "set").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", "node", "simhash", "set", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"))
    texts = lines_of(plain, (map_of(text_spots(candidates)), map_of(key_spots(candidates)))).join(candidates.select("key"), "key", "left_semi")
    texts = stored(texts.groupBy("key").agg(F.first("words").alias("words")))
    # Sets are many and small: tasks follow each other in a partition, as a group for each would cost more than its comparisons.
    task = ["set", "part_a", "part_b"]
    verified = tasks.join(texts, "key").select(*task, F.col("node").alias("line"), "simhash", "words").repartition(*task).sortWithinPartitions(
        *task, "line").mapInPandas(_verify(similarity, budget), "a long, b long")
    groups = components(verified, "a", "b")
    grouped = candidates.join(groups, "node").select("key", "first", "component")
    first = grouped.groupBy("component").agg(F.min("first").alias("kept"))
    moved = checkpointed(grouped.join(first, "component").select("key", "kept"))
    heads = distinct.where("copies > 1").select("key", "first").join(moved, "key", "full").select("key", F.coalesce("kept", "first").alias("first"))
    own = F.struct("id", "hash", "line")
    found = seen.select("id", "hash", "line", "key").join(heads, "key", "left").withColumn("first", F.coalesce("first", own))
    return found.select("id", "hash", "line", "first", (own == F.col("first")).alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                    similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that repeat an earlier one; ``length_col`` is set to the length of a changed text."""
    found = occurrences(docs, id_col, text_col, similarity)
    gone = found.groupBy("id", "hash").agg(F.collect_list(F.when(~F.col("kept"), F.col("line"))).alias("gone"), F.max("kept").alias("some")).where(F.size("gone") > 0)
    # The document travels as one column, so its own column names clash with nothing here.
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = marked.join(gone, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left").where("some is null or some")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, removed: pd.Series) -> pd.Series:
        memory("line removal")
        return pd.Series([t if r is None else _without(t, r) for t, r in zip(texts, removed)], dtype=object)

    changed = joined.withColumn("rest", rest("text", "gone"))
    length = lambda c: F.when(F.col("gone").isNotNull(), F.length("rest")).otherwise(F.col("doc")[c]).cast(dict(docs.dtypes)[c])
    return changed.select(*[(F.col("rest") if c == text_col else length(c) if c == length_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def _without(text: str, removed) -> str:
    gone = set(removed)
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
