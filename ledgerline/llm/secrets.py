"""Secret scans: candidate patterns, and a random forest trained from labelled findings that removes false positives.

Patterns find candidates: key ids of fixed form, private-key heads, values assigned to a telling name, and long runs of
letters, digits and marks. A candidate is described by its length, its kinds of characters and how likely its transitions
from character to character are in plain words, the share of it that dictionary words cover, the path of its document and
the words next to it. Spark's random forest, trained from a table of labelled findings, gives each the probability of being
a secret. The dictionary is the ``DICTIONARY`` most frequent words of all documents, counted over whole texts; so the
dictionary and the transitions taken from it have a fixed size.

Edge cases: null and empty texts have no candidates; a null path is an empty one. Rows are scanned one by one, so the
candidates of repeated rows repeat, and null ids stay null. An empty table gives an empty result; labelled findings that
are all alike give their own probability to every candidate. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.durable import stored

DICTIONARY = 20_000
TREES, DEPTH, SEED = 40, 6, 11
#: Candidates are looked at in stretches of this length, which overlap by half.
STRETCH = 64
#: Steps between a count and its double, by which words are ranked.
STEPS = 64

# Forms of candidates, and words that speak for or against one.
KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
KEY_HEAD = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: Names before a run's value; a value is not shorter than one of ``ASSIGNED``.
NAMES = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_-]*+=)+(?=[^=])")
LEAST_RUN, LEAST_VALUE = 20, 6
FOR = ("password", "passwd", "pwd", "token", "secret", "key", "credential", "auth", "bearer", "private")
AGAINST = ("commit", "sha", "hash", "md5", "checksum", "digest", "uuid", "example", "sample", "test", "dummy", "version", "revision", "id")
FEATURES = ("length", "digits", "upper", "lower", "marks", "distinct", "entropy", "changes", "transition", "unlikely", "coverage", "longest_word",
            "path_depth", "path_test", "path_code", "before_for", "before_against", "before_sign", "after_against", "quoted")


def mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def apart(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of candidates that overlap, the first and there the longest."""
    out: list[tuple[str, int, int]] = []
    for rule, start, end in sorted(found, key=lambda f: (f[1], -f[2], f[0])):
        if not out or start >= out[-1][2]:
            out.append((rule, start, end))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(rule, start, end) from left to right, of which none overlap.

    Key ids, key heads and assigned values go before runs, of which only what lies outside of them is left; a run that opens
    with ``name=`` starts at its value.
    """
    found = []
    if "AKIA" in text or "ASIA" in text:
        found += [("key_id", *m.span()) for m in KEY_ID.finditer(text)]
    if "-----BEGIN" in text:
        found += [("key_head", *m.span()) for m in KEY_HEAD.finditer(text)]
    if "=" in text or ":" in text:
        found += [("assigned", *m.span(1)) for m in ASSIGNED.finditer(text)]
    out = apart(found)
    runs, at = [], 0
    for m in RUN.finditer(text):
        while at < len(out) and out[at][2] <= m.start():
            at += 1
        start, n = m.start(), at
        while start < m.end():
            taken = n < len(out) and out[n][1] < m.end()
            end = max(start, out[n][1]) if taken else m.end()
            piece = text[start:end]
            if mixed(piece) and len(piece) >= LEAST_RUN:
                names = NAMES.match(piece)
                value = start + (names.end() if names else 0)
                runs.append(("run", value if end - value >= LEAST_VALUE and mixed(text[value:end]) else start, end))
            start, n = (out[n][2], n + 1) if taken else (m.end(), n)
    return apart(out + runs)


def kind(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-"


class Language:
    """What plain words look like: a dictionary, and the log-probabilities of a letter after a letter in its words."""

    def __init__(self, words: dict[str, int]):
        self.words = {w for w in words if len(w) >= 3}
        # Lengths of the words that begin with three letters, longest first.
        self.lengths: dict[str, list[int]] = {}
        for head, length in sorted({(w[:3], len(w)) for w in self.words}, key=lambda x: -x[1]):
            self.lengths.setdefault(head, []).append(length)
        pairs: dict[str, int] = {}
        heads: dict[str, int] = {}
        for word, n in words.items():
            for a, b in zip(word, word[1:]):
                pairs[a + b] = pairs.get(a + b, 0) + n
                heads[a] = heads.get(a, 0) + n
        self.step = {p: math.log((n + 1) / (heads[p[0]] + 30)) for p, n in pairs.items()}
        self.least = min(self.step.values(), default=-8.0) - 1.0

    def steps(self, text: str) -> list[float]:
        low = text.lower()
        return [self.step.get(low[i:i + 2], self.least) for i in range(len(low) - 1)]

    def coverage(self, text: str) -> tuple[float, int]:
        """Share of the characters that dictionary words cover, taking the longest at each place, and the longest word."""
        low, covered, most, at = text.lower(), 0, 0, 0
        while at < len(low):
            size = next((n for n in self.lengths.get(low[at:at + 3], ()) if at + n <= len(low) and low[at:at + n] in self.words), 0)
            covered, most = covered + size, max(most, size)
            at += size or 1
        return covered / max(1, len(low)), most


def telling(own: str, language: Language) -> str:
    """The stretch of a candidate that looks least like words and rulers: of even spread, changing kinds, uncovered."""
    if len(own) <= STRETCH:
        return own

    def tells(part: str) -> float:
        kinds = [kind(c) for c in part]
        spread = -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values()) / math.log2(len(part))
        return spread + sum(a != b for a, b in zip(kinds, kinds[1:])) / len(part) - language.coverage(part)[0]

    starts = [*range(0, len(own) - STRETCH, STRETCH // 2), len(own) - STRETCH]
    return max((own[at:at + STRETCH] for at in starts), key=tells)


def describe(text: str, start: int, end: int, path: str | None, language: Language) -> list[float]:
    """The values of ``FEATURES`` for one candidate: the length, the words around it and its quote are of the whole, the rest
    is of its most telling stretch, wherever that lies."""
    own = text[start:end]
    seen = telling(own, language)
    n = len(seen)
    kinds = [kind(c) for c in seen]
    counts = [c / n for c in Counter(seen).values()]
    steps = language.steps(seen) or [0.0]
    coverage, longest = language.coverage(seen)
    before = re.findall(r"[A-Za-z]+", text[max(0, start - 40):start].lower())[-2:]
    after = re.findall(r"[A-Za-z]+", text[end:end + 24].lower())[:1]
    where = (path or "").lower()
    sign = text[max(0, start - 4):start].strip(" \"'")[-1:]
    return [float(x) for x in (
        len(own), kinds.count("0") / n, kinds.count("A") / n, kinds.count("a") / n, kinds.count("-") / n, len(set(seen)) / n,
        -sum(p * math.log2(p) for p in counts), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(steps) / len(steps),
        sum(s <= language.least for s in steps) / len(steps), coverage, longest, where.count("/"),
        any(w in where for w in ("test", "example", "sample", "doc")), where.endswith((".py", ".js", ".env", ".yml", ".yaml", ".json", ".cfg", ".ini")),
        any(w in b for b in before for w in FOR), any(w == b for b in before for w in AGAINST), sign in ("=", ":"),
        any(w == a for a in after for w in AGAINST), text[start - 1:start] in ("\"", "'") if start else False)]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> Language:
    """The most frequent words of letters over all documents, with their counts: at most ``size``, without the words of a
    rank that does not fit as a whole. Ranks are steps of the count's logarithm, so only their few sizes and the chosen words
    reach the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = stored(words.groupBy("word").count().withColumn("rank", F.floor(F.log2("count") * STEPS).cast("int")))
    held, least = 0, None
    for rank in counts.groupBy("rank").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("rank")).collect():
        held += rank["words"]
        if held > size:
            break
        least = rank["rank"]
    chosen = [] if least is None else counts.where(F.col("rank") >= least).collect()
    return Language({r["word"]: r["count"] for r in chosen})


def labelled_findings(number: int = 600, seed: int = 3) -> list[tuple[str, int, int, str, int]]:
    """A small table of labelled findings made by rule: (text, start, end, path, secret)."""
    rng = random.Random(seed)
    syllables = ("an er on the in ti re ed ou ha sh le ing la de es que men tion ver un ar os").split()
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    yes = [lambda: ("AKIA" + some(base, 16), ""), lambda: (some(hexes, 40), "token = \""), lambda: (some(hexes, rng.choice((16, 18, 24, 32))), "password="),
           lambda: (some(mixed, rng.randint(20, 44)), "api_key: "), lambda: (some(mixed + "+/", rng.randint(32, 64)), "secret = '"), lambda: (some(mixed, 24), "bearer ")]
    no = [lambda: (some(hexes, 40), "commit "), lambda: (some(hexes, 64), "sha "), lambda: (word(2) + str(rng.randint(1, 99)), "password="), lambda: ("changeme123", "password="),
          lambda: ("x" * rng.randint(20, 30) + "1", "token = \""), lambda: (f"{word(4)}-{word(4)}-{rng.randint(1, 999)}", ""), lambda: (f"{word(3)}/{word(4)}/{word(3)}{rng.randint(1, 9)}", ""),
          lambda: (f"{some(hexes, 8)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 12)}", "uuid "), lambda: ("your_" + word(2) + "_here", "token = \""),
          lambda: (word(9) + "_" + str(rng.randint(1900, 2100)), ""), lambda: ("0" * 24 + "a", "id "), lambda: (f"example{word(3)}{rng.randint(1, 9)}key", "api_key: ")]
    out = []
    for i in range(number):
        value, before = rng.choice(yes if i % 2 else no)()
        head = f"{word(2)} {word(1)} {before}"
        path = rng.choice(("src0", "src/app/main.py", "docs/guide.md", "web/page", "tests/test_app.py" if i % 2 == 0 else "config/prod.env", ""))
        out.append((f"{head}{value}\" {word(2)} {word(1)}.", len(head), len(head) + len(value), path, i % 2))
    return out


def findings_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_findings(), "text string, start int, end int, path string, secret int")


def scan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id``, ``start``, ``end`` (code points, end exclusive), ``rule``, ``sha256`` of the value, ``probability`` and ``secret`` of every candidate."""
    spark = docs.sparkSession
    language = spark.sparkContext.broadcast(dictionary(docs, text_col))
    names = [F.col("features")]
    kind_of_id = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["secret"]].assign(features=[describe(*row, language.value) for row in frame[["text", "start", "end", "path"]].itertuples(index=False)])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, start, end, rule, sha256(text[start:end].encode()).hexdigest(), describe(text, start, end, path, language.value))
                    for key, text, path in frame[["id", "text", "path"]].itertuples(index=False) if text for rule, start, end in candidates(text)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "start", "end", "rule", "sha256", "features"])

    train = labelled.where("secret in (0, 1) and text is not null").mapInPandas(described, "secret int, features array<double>").select(
        F.col("secret").cast("double").alias("label"), array_to_vector(*names).alias("features"))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    found = texts.mapInPandas(search, "id string, start int, end int, rule string, sha256 string, features array<double>")
    share = train.agg(F.avg("label"), F.count(F.lit(1))).first()
    if share[0] is None or share[0] in (0.0, 1.0):
        scored = found.withColumn("probability", F.lit(float(share[0] or 0.0)))
    else:
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(train)
        scored = model.transform(found.withColumn("features", array_to_vector(*names))).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(F.col("id").cast(kind_of_id).alias("id"), "start", "end", "rule", "sha256", "probability", (F.col("probability") >= 0.5).alias("secret"))
