import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrovane.llm import superminhash as m
from agrovane.llm.components import components
from agrovane.llm.hashing import LOWER, U64, mix


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(LOWER).split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def expected(rows):
    """doc_id, set size, component and kept by comparing all pairs."""
    sets, parent = sets_of(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=repr)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def near(corpus):
    """Chains, large groups of copies and near copies, and documents around the threshold."""
    rng, rows = random.Random(11), list(corpus)
    words = [f"q{k}" for k in range(200)]
    rows += [(1000 + k, edited(words, rng, k % 9)) for k in range(120)]
    rows += [(2000 + k, " ".join(words[:60])) for k in range(150)]
    rows += [(3000 + k, " ".join(f"c{j}" for j in range(6 * k, 6 * k + 100))) for k in range(40)]
    for k in range(30):
        base = [f"t{k}_{j}" for j in range(44)]
        rows += [(4000 + 2 * k, " ".join(base)), (4001 + 2 * k, " ".join(base[: 33 + k % 4]))]
    return rows


def test_against_all_pairs(frame, near, rows):
    assert rows(m.op5(frame(near))) == expected(near)


def test_one_row_of_each_group_stays(frame, near):
    kept = m.keep_one(frame(near)).select("doc_id", "text").collect()
    groups = {}
    for (i, size, least, _), k in zip(expected(near), range(10**6), strict=False):
        groups[(i, k) if not size else (least, -1)] = 1
    assert len(kept) == len(groups)
    assert {r["doc_id"] for r in kept if r["text"] and r["text"].strip()} == {least for _, size, least, _ in expected(near) if size}


def test_signature_is_that_of_the_sequential_algorithm():
    """Early stopping and batches change nothing: element by element, with whole permutations, gives the same."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300, 3000)]
    got = m.signatures(sets, 16)
    for s, signature in zip(sets, got, strict=True):
        least = [1 << 64] * 16
        for x in s:
            order = list(range(16))
            for j in range(16):
                drawn = int(m.stream(np.array([x], U64), j)[0])
                k = j + ((drawn >> 32) * (16 - j) >> 32)
                order[j], order[k] = order[k], order[j]
                least[order[j]] = min(least[order[j]], (j << 32) | (drawn & 0xFFFFFFFF))
        assert signature.tolist() == least


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        pool = mix(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        a, b = m.signatures([pool[:200], pool[60:260]])
        errors.append((a == b).mean() - 140 / 260)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < np.sqrt(140 / 260 * 120 / 260 / m.POSITIONS)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)]
    name = lambda x: f"{x * 7919 % 10007:05d}".encode()
    pairs = [(bytearray(name(a)), bytearray(name(b))) for a, b in edges if a != b]
    got = {bytes(r["node"]): bytes(r["root"]) for r in components(spark.createDataFrame(pairs, "u binary, v binary")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(bytes(a)), root(bytes(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_empty_table(frame):
    assert m.op5(frame([])).collect() == []
    assert m.keep_one(frame([])).collect() == []
    assert m.op5(frame([(1, None), (1, ""), (None, " ")])).where(F.col("kept")).count() == 3


def test_intersections_of_a_block():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 50, 300, 300, 800)]
    got = m.intersections(sets, 64)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert got[a, b] == len(np.intersect1d(x, y)) or a == b


def test_blocks_smaller_than_the_groups_give_the_same(frame, near, rows, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    assert rows(m.op5(frame(near))) == expected(near)
