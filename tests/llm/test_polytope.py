import math

import numpy as np
import pyarrow.parquet as pq

from agrovane.llm import polytope


def brute(rows, k=20, every=20):
    """Exact top k of every query by inner product, ties to the smaller id, over the valid rows."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for qi, q in ok:
        if qi % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in ok if i != qi and len(v) == len(q)))
        out[qi] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_exact_scores(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    expected = brute(rows)
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in polytope.op12(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) <= set(expected)
    hits = 0
    for q, best in expected.items():
        found = got.get(q, [])
        assert [r for r in range(1, len(found) + 1)] == list(range(1, len(found) + 1))
        scores = [s for _, s in found]
        assert scores == sorted(scores, reverse=True)
        vectors = dict(rows)
        for i, s in found:
            assert abs(s - sum(float(a) * float(b) for a, b in zip(vectors[q], vectors[i], strict=True))) <= 1e-12
        hits += len({i for i, _ in best} & {i for i, _ in found})
    assert hits / (20 * len(expected)) >= 0.9


def test_invalid_vectors_ties_and_few_candidates(spark):
    rows = [
        (0, [1.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.5, 0.5, 0.0]),
        (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]),
        (40, None), (60, [2.0, 1.0]), (9, [1.0, 1.0]), (10, []), (2, [1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in polytope.op12(df).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (0, 4, 3, 0.5),
        (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 3, 0.5),
        (60, 1, 9, 3.0),
    ]


def test_empty(spark):
    assert polytope.op12(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 128))
    assert np.allclose(np.linalg.norm(polytope.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
