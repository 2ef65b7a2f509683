"""Components, SimHash tries, line groups and nearest neighbours against brute force, and on odd rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerline.llm import components as C, line_dedup, nearest, simhash_dedup
from test_text_operators import DOCS, ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def joined(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("held", [500_000, 40])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(C, "FOREST_ROWS", held)
    rng = np.random.default_rng(1)
    order = rng.permutation(400)
    pairs = [*zip(order[:-1], order[1:]), *((450 + i, 449) for i in range(200)), *zip(rng.integers(700, 1000, 250), rng.integers(700, 1000, 250)), (5, 5)]
    frame = spark.createDataFrame(pd.DataFrame(pairs, columns=["x", "y"])).repartition(4)
    root = joined(1000, pairs)
    got = {r.node: r.component for r in C.components(frame, "x", "y").collect()}
    assert got == {int(x): root[x] for a, b in pairs if a != b for x in (a, b)}
    assert C.components(frame.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("leaf", [512, 8])
def test_trie_join_of_crowded_fingerprints(spark, leaf):
    rng = np.random.default_rng(3)
    values = set(rng.integers(0, 2 ** 63, 150).tolist())
    for base in rng.integers(0, 2 ** 63, 3).tolist():
        for _ in range(150):
            for k in rng.integers(0, 24, rng.integers(0, 5)):
                base ^= 1 << int(k)
            values.add(base)
    v = np.array(sorted(values), np.uint64)
    near = [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 3)]
    root = joined(len(v), near)
    frame = spark.createDataFrame(pd.DataFrame({"fp": v.view(np.int64)}))
    got = {r.node: r.component for r in C.components(simhash_dedup.links(frame, "fp", 3, leaf), "a", "b").collect()}
    least = {}
    for x, r in zip(v.view(np.int64).tolist(), root):
        least[r] = min(least.get(r, x), x)
    assert all(got.get(x, x) == least[r] for x, r in zip(v.view(np.int64).tolist(), root))


def test_fingerprint_by_definition():
    for text in ("", " \n", "One two", "A b c D e\x0bf", "É a É b c " * 40):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        values = [xxh64_intdigest(s, 42) for s in shingles]
        wanted = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in values) > len(values))
        assert simhash_dedup.fingerprint_of(text.encode()) % 2 ** 64 == wanted


def test_one_of_each(spark, docs):
    got = simhash_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 2, 4, 5]  # 2 and 3 are both empty
    assert [r.text for r in got.where("doc_id is null").collect()] == ["zz yy xx"]
    assert simhash_dedup.one_of_each(docs.limit(0)).count() == 0
    assert len(simhash_dedup.near_duplicates(docs).collect()) == len(ROWS)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        most, true = rng.randint(0, 12), levenshtein(a, b)
        got = line_dedup.edit_distance(a, b, most)
        assert got == true if true <= most else got > most


@pytest.mark.parametrize("part", [512, 3])
def test_line_groups(spark, part):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(40)]
    for line in list(lines):
        own = line.split()
        for _ in range(3):
            own = own[:]
            own[rng.randrange(len(own))] = rng.choice(words)
            lines.append(" ".join(own).title() + rng.choice(["", ".", " !"]))
    texts = [[rng.choice(lines + ["", "--"]) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    frame = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = sorted({line_dedup.normalised(x) for t in texts for x in t} - {""})
    marks = line_dedup.simhashes(plain).view(np.uint64)
    root = joined(len(plain), [(i, int(j)) for i in range(len(plain)) for j in np.flatnonzero(np.bitwise_count(marks[:i] ^ marks[i]) <= 3)
                               if levenshtein(plain[i], plain[j]) <= 0.2 * max(len(plain[i]), len(plain[j])) + 1e-9])
    group = dict(zip(plain, root))
    first, wanted = {}, {}
    for d, t in enumerate(texts):
        for n, x in enumerate(t):
            if line_dedup.normalised(x):
                wanted[d, n] = first.setdefault(group[line_dedup.normalised(x)], (d, n))
    got = {(r.id, r.line): (r.first["id"], r.first["line"]) for r in line_dedup.occurrences(frame, part=part).collect()}
    assert got == wanted and len(set(wanted.values())) < len(plain)
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.without_repeats(frame).collect()}
    for d, t in enumerate(texts):
        left = [x for n, x in enumerate(t) if wanted.get((d, n), (d, n)) == (d, n)]
        alive = not any((d, n) in wanted for n in range(len(t))) or any(wanted.get((d, n)) == (d, n) for n in range(len(t)))
        assert kept.get(d) == (left if alive else None)


def test_lines_of_whole_texts():
    odd = ["", "\n\n", "A-b_c  D\tE\r\n\u2028x\x85y", "ΟΔΟΣ\nΑΣ. Σ\nİstanbul ßẞ", "naïve café—№ 5 ½ x²\n\x1c中文、字 e\u0301 \U0001d7d9\U0001f600z", "'t is 1,5!\n_"]
    for text in [*odd, *(c.join("ab") for c in map(chr, range(1, 0x3000)) if c != "\n")]:
        assert line_dedup.normalised_lines(text) == [line_dedup.normalised(x) for x in text.split("\n")]


def test_simhashes_over_slices(monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", 500)
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(900)}é" for _ in range(rng.choice([1, 2, 30, 254, 256, 1200]))) for _ in range(60)]
    for line, got in zip(lines, line_dedup.simhashes(lines)):
        values = [xxh64_intdigest(w.encode()) for w in set(line.split(" "))]
        assert int(got) % 2 ** 64 == sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))
    assert len(line_dedup.simhashes([])) == 0


@pytest.mark.parametrize("crowd", [line_dedup.CROWD, 100])
def test_block_links(spark, crowd):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [0xABCD << 48 | rng.getrandbits(48) for _ in range(400)]  # more in one block than are compared pair by pair
    for bits in (1, 2, 3, 3, 4, 4):
        for v in rng.sample(values, 80):
            for bit in rng.sample(range(64), bits):
                v ^= 1 << bit
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    frame = spark.createDataFrame(pd.DataFrame({"fp": values.view(np.int64)}))
    got = {r.node: r.component for r in C.components(line_dedup.block_links(frame, "fp", 3, crowd), "a", "b").collect()}
    root = joined(len(values), [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3)])
    groups = {}
    for v, r in zip(values.view(np.int64).tolist(), root):
        groups.setdefault(r, []).append(v)
    assert got == {v: min(g) for g in groups.values() if len(g) > 1 for v in g}


def test_verified_links_of_cut_frames():
    words = ["one two three four five six seven"[:k] + "x" for k in (27, 29, 30, 31)] + ["other words", "other wordz"]
    rows = pd.DataFrame([(s, 0, p, n, 0, w) for s in range(4) for p in range(2) for n, w in enumerate(words[: 6 - s])],
                        columns=["set", "part_a", "part_b", "line", "simhash", "words"])
    run = line_dedup._verify(0.8, 3)
    whole = pd.concat(list(run(iter([rows]))))
    for size in (1, 4, 7):
        cut = pd.concat(list(run(rows.iloc[i:i + size] for i in range(0, len(rows), size))))
        assert cut.to_numpy().tolist() == whole.to_numpy().tolist()
    assert len(whole) == 2 * (4 + 3 + 3 + 2) and not list(run(iter([])))


def test_single_lines_are_joined_to_nothing(spark):
    frame = spark.createDataFrame([(1, "one line\nother words here"), (2, "one line\nonly this")], "doc_id long, text string")
    found = line_dedup.occurrences(frame)
    assert "GreaterThan(copies,1)" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.line): (r.first["id"], r.first["line"], r.kept) for r in found.collect()} == {
        (1, 0): (1, 0, True), (1, 1): (1, 1, True), (2, 0): (1, 0, False), (2, 1): (2, 1, True)}


def test_lines_of_odd_rows(docs):
    got = line_dedup.without_repeats(docs, length_col="n_chars")
    assert got.columns == docs.columns and got.count() == len(ROWS)
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((1500, 24))
    vectors[100:160] = vectors[100]
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = nearest.search(frame, F.col("id") % 20 == 0, sample=400).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own["score"], score[own["id"]])
        hits += len(set(best) & set(own["id"]))
    assert got.query_id.nunique() == 75 and hits >= 0.9 * 75 * 20


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    n, copies = 240, 30
    vectors = rng.standard_normal((n, 12))
    # A hot id near everything: half of all rows, each with its own vector; every other row comes many times.
    hot = 2.0 * vectors[rng.integers(0, n, n * copies)] + 0.01 * rng.standard_normal((n * copies, 12))
    rows = [(i, v) for i, v in enumerate(vectors.tolist())] * copies + [(1001, v) for v in hot.tolist()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(frame, F.col("id") % 20 == 0, share=1.0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        score = np.r_[vectors @ vectors[q], (hot @ vectors[q]).max()]
        score[q] = -np.inf
        best = np.lexsort((np.arange(n + 1), -score))[:20]
        assert list(own["rank"]) == list(range(1, 21)) and own["id"].is_unique
        assert np.allclose(own["score"], score[own["id"].replace(1001, n)])
        hits += len(set(best) & set(own["id"].replace(1001, n)))
    assert got.query_id.nunique() == n // 20 and hits >= 0.95 * 20 * n // 20
    assert len(set(nearest.fit(nearest.usable(frame, "vec_id", "embedding"), sample=100).sample_ids)) == 100


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 9), (20, [0.0, 1.0], 9), (None, [1.0, 1.0], 9), (1, None, 9), (2, [0.0, 0.0], 9), (3, [math.nan, 1.0], 9), (4, [1.0], 9),
            (5, [2.0, 0.0], 9), (6, [2.0, 0.0], 9), (6, [2.0, 0.0], 9), (7, [None, 1.0], 9), (8, [math.inf, 1.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = [tuple(r) for r in nearest.search(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, 0.0), (20, 3, 6, 0.0)]
    assert nearest.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0
