"""Fill-in-middle, chat formatting and hard negatives against brute-force versions and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import chat, fill_in_middle as fim, hard_negatives as hard

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_against_plain_cutting(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abXYZ é漢😀\n<>PSM1") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "a", "<", "<S", "x <P> y", "word " * 40_000, "q" * 100_000, "é" * 70_000]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "no id", "x", 0), (3, texts[3], "x", 0), (3, texts[3], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, h1 long")
    found = fim.fill_in_middle(docs)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    want = sorted((repr((i, *plain_middle(i, t), t or "")) for i, t, *_ in rows))
    got = [(r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored_sha256, r.output_sha256) for r in found.collect()]
    by_hash = {sha(t or ""): t or "" for _, t, *_ in rows}
    assert sorted(repr((*g[:6], by_hash[g[6]])) for g in got) == want
    assert all(sha(g[5]) == g[7] for g in got)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_middles_of_string_ids_and_other_epochs(spark):
    docs = spark.createDataFrame([(f"d{i}", "one two three four five six " * 5) for i in range(40)], "name string, body string")
    first, second = (fim.fill_in_middle(docs, "name", "body", epoch=e).select("id", "prefix_chars", "restored_sha256").collect() for e in (1, 2))
    assert {r.restored_sha256 for r in first + second} == {sha("one two three four five six " * 5)}
    assert [r.prefix_chars for r in first] != [r.prefix_chars for r in second] and first[0].id.startswith("d")


def test_tokens_over_block_borders(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 3)
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab é漢😀Z") for _ in range(rng.randint(0, 20)))
        draws = (rng.randrange(1 << 32), rng.randrange(1 << 32))
        tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        n, a, b = fim.cut_points(text.encode(), draws)
        ends = sorted(d % (len(tokens) + 1) for d in draws)
        assert n == len(tokens) and [a, b] == [len("".join(tokens[:e]).encode()) for e in ends]


def test_piece_tables():
    table = fim.PieceTable.of("añb".encode()).cut(0, 1).cut(1, 2)
    assert [bytes(p).decode() for p in table.stream()] == ["a", "ñ", "b"] and table.arranged((2, 0, 1)).text().decode() == "bañ"
    assert table.digest() == sha("añb") and table.cut(1, 0).digest() == sha("añb")
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("<PSM>a") for _ in range(rng.randint(0, 12)))
        draws = tuple(rng.randrange(1 << 32) for _ in range(4))
        _, form, _, _, pieces = fim.transform(text.encode(), draws)
        assert fim.restored(pieces.text(), form).text().decode() == text


MESSAGES = "conv long, node long, parent long, score double, role string, text string, extra int"


def branches(messages):
    """(conv, nodes from root to leaf, score) of every branch, by walking up from leaves."""
    parents, scores = {}, {}
    for conv, node, parent, score, *_ in messages:
        parents[conv, node], scores[conv, node] = parent, score or 0.0
    answered = {(c, p) for (c, n), p in parents.items() if p is not None and p != n}
    out = []
    for conv, node in parents:
        if (conv, node) in answered:
            continue
        path, at = [], node
        while at is not None and (conv, at) in parents and at not in path:
            path.append(at)
            at = parents[conv, at]
        if at is not None and (conv, at) in parents and at != path[-1]:
            continue  # a circle
        out.append((conv, path[::-1], sum(scores[conv, n] for n in path)))
    return out


def test_paths_and_ranks_of_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        for node in range(rng.randint(1, 30)):
            rows.append((conv, node, rng.randint(-1, node) if node else None, rng.choice([None, 0.5, 1.0, -1.0]), rng.choice(["user", "assistant"]), f"t{node}", 1))
    rows += [(50, 1, 2, 1.0, "user", "in a circle", 1), (50, 2, 1, 1.0, "user", "in a circle", 1), (50, 3, 1, 1.0, "user", "hangs on it", 1),
             (50, 7, 7, 1.0, "user", "answers itself", 1), (None, 1, None, 1.0, "user", "no id", 1), (None, 2, 1, 1.0, "assistant", "none", 1)]
    rows += [(60, n, n - 1, 0.0, "user" if n % 2 else "assistant", str(n), 1) for n in range(1, 200)]
    messages = spark.createDataFrame(rows, MESSAGES)
    paths = chat.reply_paths(messages.select("conv", "node", "parent")).collect()
    got = {}
    for r in paths:
        got.setdefault((r.conv, r.leaf), []).append((-r.up, r.node))
    want = branches(rows)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(c, p[-1]): p for c, p, _ in want}
    assert all(len({u for u, _ in v}) == len(v) for v in got.values())
    chosen = chat.conversations(messages, best=2).collect()
    texts = {(c, n): (role, t) for c, n, _, _, role, t, _ in rows}
    order = {}
    for c, p, s in sorted(want, key=lambda x: (-x[2], x[1][-1])):
        order.setdefault(c, []).append((p, s))
    assert sorted((r.conv is None, r.conv, r.branch) for r in chosen) == sorted((c is None, c, i + 1) for c, b in order.items() for i in range(min(2, len(b))))
    for r in chosen:
        path, score = order[r.conv][r.branch - 1]
        assert r.leaf == path[-1] and r.score == pytest.approx(score)
        assert r.formatted == "".join("<|im_start|>{}\n{}<|im_end|>\n".format(*texts[r.conv, n]) for n in path)
        assert "".join(r.formatted[s.start:s.start + s.length] for s in r.loss) == "".join(texts[r.conv, n][1] for n in path if texts[r.conv, n][0] == "assistant")


def test_texts_come_back_from_the_format(spark):
    rng = random.Random(5)
    signs = ["<|im_start|>", "<|im_end|>", "\n", "\\", "\\l", "\\b", "\\n", "<", "|", ">", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "a", "é", "assistant", "<|", "im_end|>", ""]
    word = lambda n: "".join(rng.choice(signs) for _ in range(rng.randint(0, n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", word(4)]), word(12)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, None, None), (101, None, "assistant", "b"), (101, 1, "assistant", "a"), (102, 1, "user", "tie"), (102, 1, "user", "tie"),
             (102, 1, "assistant", "tie"), (None, 0, "user", "x"), (103, 0, "assistant", "long é " * 50_000)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node long, conv int")
    formatted = chat.conversations(chat.chain(turns))
    read = formatted.select("conv", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv: [tuple(t) for t in r.turns] for r in read} == want
    assert {r.conv: r.learned for r in read} == {c: "".join(t for role, t in turns_ if role == "assistant") for c, turns_ in want.items()}
    for r in read:
        body = re.sub(r"<\|im_start\|>|<\|im_end\|>\n", "", r.formatted)
        assert not re.search(r"<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>", body)
    assert chat.conversations(chat.chain(turns.limit(0))).count() == 0


def hardest(rows, positives=5, negatives=10):
    seen = {(i, lab, tuple(int(np.floor(256 * x)) for x in v)) for i, lab, v in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, lab, v in seen:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in seen if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            inside = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("wide", [False, True])
def test_hard_negatives_against_all_scores(spark, wide):
    rng = random.Random(6)
    value = (lambda: rng.gauss(0, 0.3)) if wide else (lambda: rng.choice([-0.25, 0.0, 0.25, 0.5]))
    rows = [(i, rng.randint(0, 3), [value() for _ in range(12)]) for i in range(300)]
    rows += [(10, 1, [value() for _ in range(7)]), (21, 1, [value() for _ in range(7)]), (22, 2, [value() for _ in range(7)])]
    rows += [(None, 1, [0.1] * 12), (400, None, [0.1] * 12), (410, 1, None), (420, 1, [float("nan")] * 12), (430, 1, [None] * 12), (440, 1, []), (450, 2, [0.0] * 12)]
    rows += [rows[20]] * 50 + [(500, 9, [0.5] * 12)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, id int, score int")
    found = hard.hard_negatives(table, F.col("id") % 10 == 0, block=32, chunk=9)
    assert sorted(map(tuple, found.collect())) == hardest(rows)
    assert hard.hard_negatives(table.limit(0), F.col("id") % 10 == 0).count() == 0


def test_bounds_rule_out_no_winner():
    rng = np.random.default_rng(7)
    columns = rng.integers(-50, 50, (16, 400)).astype("<i4")
    block = hard.Block(np.arange(400), np.zeros(400, np.int64), columns, columns.min(1).astype(np.int64), columns.max(1).astype(np.int64))
    anchor = rng.integers(-50, 50, 16)
    every = anchor @ columns.astype(np.int64)
    best = hard.Best(10, -2000, 3000)
    looked = []
    def judge(least, most):
        looked.append(len(least))
        return best.open(least, most)

    at, scores = hard.scan(block, anchor, np.ones(400, bool), judge, step=4)
    best.offer(block.ids[at], scores)
    inside = [i for i in np.lexsort([block.ids, -every]) if -2000 <= every[i] <= 3000][:10]
    assert best.ids.tolist() == inside and (scores == every[at]).all()
    assert looked[-1] < looked[0]
