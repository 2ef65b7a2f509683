"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that finds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers as they are defined. The random field labels the
blank-separated words of a text as beginning or continuing a kind, from the shapes of the word and its neighbours; it is
trained from a small labelled table and decoded by Viterbi, many word sequences at a time in numpy. Its spans are added
where they overlap no other and look valid (digits, check sum); so phone numbers without a plus sign, spelled-out addresses
and the like come in.

Every word of every text is scored and may begin a kind, whatever the text's length. Viterbi runs on the stretches that a span
of the likeliest labelling may touch; a bound proves all other words to be outside in it, so the labels are those of whole texts.

Edge cases: null and empty texts have no spans. Rows are treated one by one, so repeated rows and null ids keep their
places. An empty table gives an empty result. An empty labelled table leaves the patterns alone. Only id and text are read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.memory import memory

# The kinds, and the patterns of the contract. A look behind keeps long runs of digits from being tried at each digit.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
BUCKETS = 1 << 12
STEPS, RATE, RIDGE = 60, 0.15, 0.002
WORD = re.compile(r"\S+")
LETTER = re.compile("[A-Za-z]")
KNOWN = frozenset(("at", "dot", "com", "org", "net", "edu", "gov", "info"))
PAUSES = frozenset(".,;:!?")
#: Words without digits whose shape a worker remembers, more or less.
REMEMBERED = 1 << 17
MARKS = ".,;:!?()[]{}<>\"'"
# An address in any spelling: local part, at, and a domain with a dot, each sign written out or not, in brackets or not.
SPELLED = re.compile(r"""\W*[\w.%+-]+(?:\s+dot\s+[\w.%+-]+)*\s*[(\[{<]?\s*(?:@|\bat\b)\s*[)\]}>]?\s*
    [\w-]+(?:(?:\.|\s*[(\[{<]?\s*\bdot\b\s*[)\]}>]?\s*)[\w-]+)+""", re.I | re.X)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def valid(kind: str, text: str) -> bool:
    """Whether a span of the field can be of its kind."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        return SPELLED.fullmatch(text) is not None
    if kind == "ip":
        parts = DIGIT.sub("0", text).strip("[]().,") and re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z@/=]", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, kind by kind, from left to right."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(end, at + 1))
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def shape(word: str) -> str:
    """Kinds of characters with their numbers: letters x and X, digits 0, others themselves."""
    core = word[:-1] if word[-1:] in PAUSES else word
    if core.isascii() and core.isalpha() and (core.islower() or core[1:].islower()):  # most words; the same as below
        first, rest = ("x", core) if core[0].islower() else ("X", core[1:])
        return (first if first == "X" else "") + ("x" if len(rest) == 1 else "x+") + word[len(core):]
    kinds = "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", lambda m: m[1] + (str(len(m[0])) if m[1] == "0" and len(m[0]) < 20 else "+"), kinds)


def known_word(word: str) -> str:
    """The word's letters, if they write out a sign or a domain's end; all other words with letters are one."""
    core = word.strip(MARKS).lower()
    return core if core in KNOWN else "*" if LETTER.search(word) else ""


def features(words: list[str]) -> np.ndarray:
    """Buckets of the features of each word of a sequence, one row a word."""
    shapes = ["<", *map(shape, words), ">"]
    rows = []
    for i, word in enumerate(words):
        before, own, after = shapes[i:i + 3]
        values = (*word_features(word, own), f"b{before}", f"a{after}", f"ba{before}|{own}", f"aa{own}|{after}", f"p{known_word(words[i - 1]) if i else ''}")
        rows.append([crc32(v.encode("utf-8", "replace")) % BUCKETS for v in values])
    return np.array(rows, np.int32).reshape(len(words), -1)


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # bucket by label
    move: np.ndarray  # label to label
    first: np.ndarray


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Which label may follow which, and which may come first: a kind continues only itself."""
    inner = np.array([0 if n[0] != "I" else LABELS.index(n) for n in LABELS])
    follow = np.array([[inner[b] == 0 or LABELS[a][2:] == LABELS[b][2:] for b in range(len(LABELS))] for a in range(len(LABELS))])
    return follow, inner == 0


def _peak_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(rows: list[tuple[list[str], list[str]]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge, by Adam over all sequences (words, labels) at once."""
    n, labels = len(LABELS), {x: i for i, x in enumerate(LABELS)}
    follow, begin = allowed()
    emit, move, first = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n)
    if not rows:
        return Field(emit, np.where(follow, move, -1e9), np.where(begin, np.where(np.arange(n) == 0, 0.0, -1e9), -1e9))
    longest = max(len(w) for w, _ in rows)
    found = [features(w) for w, _ in rows]
    at = np.zeros((len(rows), longest, found[0].shape[1]), np.int32)
    gold, real = np.zeros((len(rows), longest), int), np.zeros((len(rows), longest), bool)
    for i, (f, (_, own)) in enumerate(zip(found, rows)):
        at[i, :len(f)], gold[i, :len(f)], real[i, :len(f)] = f, [labels[x] for x in own], True
    state = [np.zeros((2, *p.shape)) for p in (emit, move, first)]
    hot = np.eye(n)[gold]
    for step in range(1, steps + 1):
        score = emit[at].sum(2)
        ways, start = np.where(follow, move, -1e9), np.where(begin, first, -1e9)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            new = _peak_sum(forward[:, t - 1, :, None] + ways, 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _peak_sum(ways + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        whole = _peak_sum(forward[:, -1], 1)
        node = np.exp(np.minimum(0, forward + backward - whole[:, None, None])) * real[..., None]
        slopes = [np.zeros_like(emit), np.zeros_like(move), node[:, 0].sum(0) - hot[:, 0].sum(0)]
        off = (node - hot * real[..., None])
        np.add.at(slopes[0], at.reshape(-1, at.shape[2]).ravel(), np.repeat(off.reshape(-1, n), at.shape[2], axis=0))
        for t in range(1, longest):
            both = np.exp(np.minimum(0, forward[:, t - 1, :, None] + ways + (score[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]))
            slopes[1] += ((both - hot[:, t - 1, :, None] * hot[:, t, None, :]) * real[:, t, None, None]).sum(0)
        for p, slope, s in zip((emit, move, first), slopes, state):
            slope = slope / len(rows) + RIDGE * p / len(rows)
            s[0], s[1] = 0.9 * s[0] + 0.1 * slope, 0.99 * s[1] + 0.01 * slope ** 2
            p -= RATE * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.99 ** step)) + 1e-8)
    return Field(emit, np.where(follow, move, -1e9), np.where(begin, first, -1e9))


def word_features(word: str, own: str) -> tuple[str, str, str, str]:
    """The features of a word that its neighbours have no part in; ``own`` is its shape."""
    digits = min(20, sum(c.isdigit() for c in word)) if "0" in own else 0
    return f"s{own}", f"d{digits}", f"w{known_word(word)}" if digits == 0 else f"e{own[:2]}{own[-2:]}", f"@{'@' in word}{'.' in word}{word[:1] == '+'}"


def emissions(field: Field, sequences: list[list[str]]) -> np.ndarray:
    """Sums of the weights of :func:`features` for every word of all sequences, one row a word.

    Different words, and pairs of neighbours, are described once, then looked up.
    """
    def weights(values: list[str]) -> np.ndarray:
        return field.emit[[crc32(v.encode("utf-8", "replace")) % BUCKETS for v in values]]

    sizes = np.array([len(s) for s in sequences])
    first = np.cumsum(sizes) - sizes
    flat = np.empty(sizes.sum(), object)
    flat[:] = [w for s in sequences for w in s]
    code, words = pd.factorize(flat)
    alike: dict[tuple, int] = {}  # words of the same features: of one shape and known word, those with digits apart
    of, seen = [], memory("personal_data")
    if len(seen) > REMEMBERED:
        seen.clear()
    for w in words:
        said = seen.get(w)
        if said is None:
            said = shape(w), known_word(w)
            if "0" in said[0]:
                said = *said, w
            elif len(w) < 20:
                seen[w] = said
        of.append(alike.setdefault(said, len(alike)))
    own, count = np.array(of)[code], len(alike)
    described = [word_features(words[i], s) for (s, *_), i in zip(alike, np.unique(of, return_index=True)[1])]
    kinds = [*((s, k) for s, k, *_ in alike), ("<", ""), (">", "")]
    before, after = np.concatenate([[0], own[:-1]]), np.concatenate([own[1:], [0]])
    before[first], after[first + sizes - 1] = count, count + 1
    left, lefts = pd.factorize(before * len(kinds) + own)
    right, rights = pd.factorize(own * len(kinds) + after)
    pairs = [(kinds[p // len(kinds)], kinds[p % len(kinds)]) for p in lefts]
    score = sum(weights([f[i] for f in described]) for i in range(4))[own]
    score += (weights([f"b{a}" for (a, _), _ in pairs]) + weights([f"ba{a}|{b}" for (a, _), (b, _) in pairs]) + weights([f"p{k}" for (_, k), _ in pairs]))[left]
    pairs = [(kinds[p // len(kinds)][0], kinds[p % len(kinds)][0]) for p in rights]
    score += (weights([f"a{b}" for _, b in pairs]) + weights([f"aa{a}|{b}" for a, b in pairs]))[right]
    return score


def possible(field: Field, score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that a kind's span in a likeliest labelling may cover; all others are outside in every likeliest labelling.

    Replacing a span by outside labels is always allowed. What a span gains over that is at most a part for its first word,
    one for each further word and one for its end, so the best span over a word follows from running maxima. ``first``: where sequences begin.
    """
    move, apart = field.move, 1e6
    out = np.zeros(len(score), bool)
    for begin in range(1, len(LABELS), 2):
        inner, follow = begin + 1, [0, *range(1, len(LABELS), 2)]
        enter = max((move[:, begin] - move[:, 0]).max(), field.first[begin] - field.first[0])
        stay = max(move[begin, inner], move[inner, inner]) - move[0, 0]
        leave = max(0.0, *(move[x, n] - move[0, n] for x in (begin, inner) for n in follow))
        more = score[:, inner] - score[:, 0] + stay
        more[first] -= apart  # no span reaches into the next sequence
        total = np.cumsum(more)
        opened = np.maximum.accumulate(score[:, begin] - score[:, 0] + enter - total)
        closed = np.maximum.accumulate(total[::-1])[::-1]
        out |= opened + closed + leave >= -1e-3
    return out


def likeliest(field: Field, runs: list[tuple[np.ndarray, bool, bool]], batch: int) -> list[np.ndarray]:
    """The likeliest labels of runs (scores, whether outside words stand before and after), by Viterbi over batches of like length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * len(runs[order[end]][0]) <= batch:
            end += 1
        own = [runs[i] for i in order[start:end]]
        sizes = np.array([len(r[0]) for r in own])
        score = np.zeros((len(own), sizes.max(), len(LABELS)))
        for row, r in enumerate(own):
            score[row, :sizes[row]] = r[0]
        best = np.where(np.array([r[1] for r in own])[:, None], field.move[0], field.first) + score[:, 0]
        came = np.zeros(score.shape, np.int8)
        for t in range(1, sizes.max()):
            ways = best[:, :, None] + field.move
            came[:, t] = ways.argmax(1)
            best = np.where((t < sizes)[:, None], ways.max(1) + score[:, t], best)
        best = best + np.where(np.array([r[2] for r in own])[:, None], field.move[:, 0], 0)
        for row in range(len(own)):
            label = int(best[row].argmax())
            path = [label]
            for t in range(sizes[row] - 1, 0, -1):
                label = int(came[row, t, label])
                path.append(label)
            out[order[start + row]] = np.array(path[::-1])
        start = end
    return out


def decode(field: Field, sequences: list[list[str]], batch: int = 20_000, words: int = 200_000) -> list[np.ndarray]:
    """The likeliest labels of each sequence, all its words regarded; some ``words`` of whole sequences at a time."""
    out = [np.zeros(len(s), np.int8) for s in sequences]
    filled = [i for i, s in enumerate(sequences) if s]
    start = 0
    while start < len(filled):
        end, held = start, 0
        while end < len(filled) and (end == start or held + len(sequences[filled[end]]) <= words):
            held += len(sequences[filled[end]])
            end += 1
        own = filled[start:end]
        sizes = np.array([len(sequences[i]) for i in own])
        first = np.cumsum(sizes) - sizes
        score = emissions(field, [sequences[i] for i in own])
        maybe = possible(field, score, first)
        begins = np.flatnonzero(maybe & ~np.concatenate([[False], maybe[:-1]]) | maybe & np.isin(np.arange(held), first))
        ends = np.flatnonzero(maybe & ~np.concatenate([maybe[1:], [False]]) | maybe & np.isin(np.arange(held), first + sizes - 1)) + 1
        of = np.searchsorted(first, begins, "right") - 1
        found = likeliest(field, [(score[a:b], a > first[i], b < first[i] + sizes[i]) for a, b, i in zip(begins, ends, of)], batch)
        for a, b, i, labels in zip(begins, ends, of, found):
            out[own[i]][a - first[i]:b - first[i]] = labels
        start = end
    return out


def added_spans(text: str, words: list[tuple[int, int]], own: np.ndarray, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Valid spans of the decoded labels of a text's words that overlap no span already taken."""
    merged: list[list[int]] = []
    for _, a, b in sorted(taken, key=lambda s: s[1:]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out: list[tuple[str, int, int]] = []
    for at in np.flatnonzero(np.array([n[0] == "B" for n in LABELS])[own]):
        kind, end = LABELS[own[at]][2:], at + 1
        while end < len(words) and LABELS[own[end]] == "I-" + kind:
            end += 1
        start, stop = words[at][0], words[end - 1][1]
        while stop > start and text[stop - 1] in ".,;:!?)]>\"'" and not (text[stop - 1] == ")" and "(" in text[start:stop - 1]):
            stop -= 1
        last = bisect_left(starts, stop) - 1  # the last one taken that begins before the span ends
        if valid(kind, text[start:stop]) and (last < 0 or merged[last][1] <= start):
            out.append((kind, start, stop))
    return out


def labelled_examples(number: int = 360, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: sentences of plain words with a finding, or with a number that is none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    makers = {
        "email": [lambda: f"{name()}.{digits(2)}@{name()}.example.com", lambda: f"{name()}@{name()}.org", lambda: f"{name()} at {name()} dot com",
                  lambda: f"{name()} (at) {name()} (dot) org", lambda: f"{name()}.{name()} [at] {name()}.net"],
        "ip": [lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"[{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}]"],
        "card": [card, lambda: " ".join(re.findall("....", card())), lambda: "-".join(re.findall("....", card()))],
        "phone": [lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
                  lambda: f"00{rng.randint(20, 99)} {digits(3)} {digits(4)} {digits(2)}"],
    }
    others = [lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2030)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}",
              lambda: f"${rng.randint(1, 999)},{digits(3)}.{digits(2)}", lambda: digits(rng.randint(1, 6)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
              lambda: f"{name()}{digits(3)}", lambda: f"@{name()}", lambda: "at", lambda: f"\"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"AK{name().upper()}{digits(4)}",
              lambda: f"{rng.randint(1, 12)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"#{digits(7)}", lambda: f"{name()}={digits(8)}{name()}"]
    plain = lambda: [w.capitalize() if rng.random() < 0.2 else w for w in (name() for _ in range(rng.randint(1, 4)))]
    out = []
    for i in range(number):
        kind = KINDS[i % 4] if i % 3 else None
        middle = rng.choice(makers[kind])() if kind else rng.choice(others)()
        middle += rng.choice(["", "", ".", ","])
        before, own, after = plain(), middle.split(), plain()
        marks = [f"B-{kind}", *[f"I-{kind}"] * (len(own) - 1)] if kind else ["O"] * len(own)
        out.append((before + own + after, ["O"] * len(before) + marks + ["O"] * len(after)))
    # Running prose, in which at and dot are words like others.
    small = ["at", "dot", "to", "of", "the", "in", "and", "on"]
    for _ in range(number // 20):
        prose = [w + rng.choice(["", "", "", ",", "."]) for w in (rng.choice(small) if rng.random() < 0.3 else rng.choice(plain()) for _ in range(rng.randint(6, 14)))]
        out.append((prose, ["O"] * len(prose)))
    return out


def examples_table(spark: SparkSession) -> DataFrame:
    """The labelled table as words and labels."""
    return spark.createDataFrame(labelled_examples(), "words array<string>, labels array<string>")


def find(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` (kind, start, end, base) of every document, by kind and then start; code points, end exclusive.

    ``labelled``: the small table (words, labels) to train the field from.
    """
    field = train([(list(r["words"]), list(r["labels"])) for r in labelled.orderBy("words").collect()])
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            texts = [t or "" for t in frame["text"]]
            base = [base_spans(t) for t in texts]
            spans = []
            for text, own, labels in zip(texts, base, decode(sent.value, [t.split() for t in texts])):
                new = added_spans(text, [m.span() for m in WORD.finditer(text)], labels, own) if labels.any() else []
                every = [(*s, True) for s in own] + [(*s, False) for s in new]
                spans.append([dict(zip(("kind", "start", "end", "base"), s)) for s in sorted(every, key=lambda s: (KINDS.index(s[0]), *s[1:3]))])
            yield pd.DataFrame({"id": frame["id"], "spans": spans})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(search, "id string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return found.withColumn("id", F.col("id").cast(kind))


def digest(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
