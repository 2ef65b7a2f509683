"""Tokens, packing, matrices and the pipeline: round trips and bounds."""

import bisect
import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import best_fit, token_matrix, tokens
from test_text_operators import DOCS, ROWS

PATH = tokens.word_vocabulary()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_ids_are_the_tokenizers():
    own, plain = tokens.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    odd = ["", "a  b", "don't it's", "a\x1cb", "İstanbul ΣΑΣ ΟΔΟΣ", "é é", "<|endoftext|> x<|startoftext|>y", "a\tb\r\nc", "'s'", "ſt", "Ab12,", "ﬁ ½", "x" * 5000,
           "日本語 テスト", "__init__ A.B", "ÀÉÎ ß ÿ ª º µ ×÷ É9ß.", "don’t", "a.b c", "<|x"]
    odd += ["".join(rng.choice("aB9é'.,!<|> \n×ß") for _ in range(30)) for _ in range(500)]
    for text in odd:
        assert own.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def best_fit_count(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at == len(gaps):
            opened += 1
            bisect.insort(gaps, capacity - n)
        else:
            bisect.insort(gaps, gaps.pop(at) - n)
    return opened


@pytest.mark.parametrize("capacity", [10, 60, 4096])
def test_plans_are_best_fit(capacity):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else max(1, capacity // 17) for _ in range(2000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, seen = {}, set()
    for n, first, end, sequence, each, offset in best_fit.plan(counts, capacity):
        for rank in range(first, end):
            assert (n, rank) not in seen
            seen.add((n, rank))
            used.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    assert len(seen) == len(lengths) and len(used) == best_fit_count(lengths, capacity)
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    rows = token_matrix.best_fit_decreasing(lengths, capacity)
    assert len(rows) == best_fit_count(lengths, capacity) and sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in r) for r in rows) <= capacity


def expected(text):
    return tokens.WordTokenizer(PATH).ids(text) + (1).to_bytes(4, "little")


def test_packing_covers_every_document(docs):
    got = best_fit.packed(docs, PATH, capacity=64).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= 64).all()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    for key, text in [(r[0], r[1]) for r in ROWS if r[0] is not None]:
        ids = expected(text)
        own = got[got.doc_id == key].drop_duplicates("piece").sort_values("piece")
        parts = [ids[i:i + 256] for i in range(0, len(ids), 256)]
        assert own.ids_crc32.tolist() == [crc32(p) for p in parts] and own.start.tolist() == [64 * i for i in range(len(parts))]
    assert len(got[got.doc_id.isna()]) == 2 and best_fit.packed(docs.limit(0), PATH).count() == 0


def test_matrices_round_trip(spark, docs, tmp_path):
    token_matrix.write_matrix(token_matrix.packed_matrix(docs, PATH, capacity=64, window=500), str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    for r in stored.collect():
        positions = np.frombuffer(r.positions, "<i4")
        assert len(r.ids) == 256 and len(positions) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
    back = token_matrix.documents_of(stored).dropDuplicates(["doc_id", "piece"]).toPandas()
    for key, text in [(r[0], r[1]) for r in ROWS if r[0] is not None]:
        own = back[back.doc_id == str(key)].sort_values("piece")
        assert b"".join(bytes(x) for x in own.ids) == expected(text)
    assert token_matrix.packed_matrix(docs.limit(0), PATH).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage takes what the one before kept; the last packs it whole."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n))
    rows = [(i, text(5), "en", f"s{i % 3}") for i in range(60)]
    shared = text(1)
    rows += [(100, rows[0][1], "en", "s0"), (101, shared + "\n" + text(3), "en", "s1"), (102, text(3) + "\n" + shared.upper(), "en", "s1"), (103, None, "en", "s1")]
    rows += [(200 + i, text(2) + " scumbag moron", "en", "s2") for i in range(40)]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] >= 200)) for r in rows if r[0] % 2 == 0 and r[0] < 60 or r[0] >= 200]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, kept = str(tmp_path), {}
    now = spark.read.parquet(folder + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == frame.columns, name
        now.write.parquet(f"{folder}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{folder}/{name.replace(' ', '_')}")
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    tox, lines, near, mix = kept.values()
    assert sum(i >= 200 for i in tox) <= 4 and sum(i < 200 for i in tox) == 64, sorted(i for i in tox if i >= 200)
    assert 100 not in lines and lines[101].startswith(shared) and shared.upper() not in lines[102] and lines[103] is None
    assert set(near) <= set(lines) and set(mix) <= set(near) and len(near) >= 60
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder).toPandas()
    assert set(packed.doc_id) == set(mix)
    assert set(corpus_pipeline.run(spark, folder).columns) == set(packed.columns)
