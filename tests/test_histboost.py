import random

import numpy as np
import pytest

from agrovane.ml import histboost
from agrovane.sources.schemas import KEY


def brute(rows, edges, models, trees, depth, step):
    """Level-wise histogram boosting in NumPy over the same bins: every model, every node, every threshold."""
    x = np.array([[sum(e < v for e in col) for v, col in zip(r[3:-1], edges, strict=True)] for r in rows])
    y = np.array([r[-1] for r in rows])
    out = {}
    for name, member in models.items():
        idx = np.array([i for i, r in enumerate(rows) if member(r)])
        pred = np.full(len(idx), y[idx].mean())
        for _ in range(trees):
            res = y[idx] - pred
            node = np.ones(len(idx), dtype=int)
            for _level in range(depth):
                new = node * 2
                for nd in np.unique(node):
                    at = node == nd
                    best = None
                    for f in range(x.shape[1]):
                        for b in range(len(edges[f]) + 1):
                            left = at & (x[idx, f] <= b)
                            nl, nr = left.sum(), (at & ~left).sum()
                            if nr == 0 or nl == 0:
                                continue
                            sl, st = res[left].sum(), res[at].sum()
                            gain = sl * sl / nl + (st - sl) ** 2 / nr - st * st / at.sum()
                            key = (gain, -f, -b)
                            if best is None or key > best:
                                best = key
                    if best is not None and best[0] > 1e-12:
                        new[at & (x[idx, -best[1]] > -best[2])] += 1
                node = new
            for nd in np.unique(node):
                pred[node == nd] += step * res[node == nd].mean()
        for i, p in zip(idx, pred, strict=True):
            out[(rows[i][0], rows[i][1], rows[i][2], name)] = p
    return out


@pytest.fixture
def table(spark):
    rng = random.Random(4)
    rows = []
    for k in range(160):
        crop = "big" if k < 120 else f"small{k % 3}"
        a, b = rng.uniform(0, 10), rng.choice([0.0, 1.0, 2.0])
        rows.append((str(k % 17), crop, 2000 + k, a, b, 3 * a + (5 if b > 1 else 0) + rng.gauss(0, 1)))
    return rows


def test_against_numpy(spark, table):
    df = spark.createDataFrame(table, "codigo_municipio string, cultivo string, periodo int, a double, b double, target double")
    got = histboost.fit(df, trees=3, depth=3, step=0.5, sample=1.0, bins=8, minimum=100, columns=["a", "b"])
    expected = brute(table, got.edges, {"big": lambda r: r[1] == "big", histboost.GLOBAL: lambda r: True}, 3, 3, 0.5)
    found = {tuple(r[c] for c in [*KEY, "modelo"]): r["prediction"] for r in got.predictions.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    shares = {(r["modelo"], r["var"]): r["importance"] for r in got.importances(["a", "b"]).collect()}
    assert abs(shares[("big", "a")] + shares.get(("big", "b"), 0.0) - 1) < 1e-12 and shares[("big", "a")] > 0.5
    served = {(r["cultivo"], r["periodo"]) for r in histboost.predict(got, ["a", "b"]).collect()}
    assert len(served) == len(table)


def test_empty(spark):
    df = spark.createDataFrame([], "codigo_municipio string, cultivo string, periodo int, a double, target double")
    got = histboost.fit(df, trees=2, depth=2, columns=["a"])
    assert got.predictions.collect() == []


SCHEMA = "codigo_municipio string, cultivo string, periodo int, a double, b double, target double"


def test_rows_are_stored_every_few_trees(spark, table, monkeypatch):
    """A fit stores its rows, their blocks, the blocks again every STORE_EVERY trees, and the predictions: not each tree."""
    stored, write = [], histboost.materialize
    monkeypatch.setattr(histboost, "materialize", lambda df, name: stored.append(name) or write(df, name))
    monkeypatch.setattr(histboost, "BLOCK_ROWS", 50, raising=False)
    df = spark.createDataFrame(table, SCHEMA)
    options = {"trees": 5, "depth": 3, "step": 0.5, "sample": 0.7, "bins": 8, "minimum": 100, "columns": ["a", "b"]}
    monkeypatch.setattr(histboost, "STORE_EVERY", 2)
    often = {tuple(r)[:4]: r["prediction"] for r in histboost.fit(df, **options).predictions.collect()}
    assert len(stored) <= 5
    monkeypatch.setattr(histboost, "STORE_EVERY", 20)
    once = {tuple(r)[:4]: r["prediction"] for r in histboost.fit(df, **options).predictions.collect()}
    assert often.keys() == once.keys() and all(abs(often[k] - once[k]) < 1e-9 for k in once)


def test_sample_is_drawn_by_spark_hash(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 1234567890123]
    rows = spark.createDataFrame([(i,) for i in ids], "rid long").selectExpr("xxhash64(rid, 7, 42) AS h").collect()
    assert histboost._xxhash64(np.array(ids), 7, 42).tolist() == [r["h"] for r in rows]


def test_constant_target_and_repeated_rows(spark):
    rows = [("1", "c", 2000, float(k % 3), 0.0, 4.0) for k in range(60)]
    got = histboost.fit(spark.createDataFrame(rows, SCHEMA), trees=2, depth=2, columns=["a", "b"])
    assert [r["prediction"] for r in got.predictions.collect()] == [4.0] * 60 and got.splits.collect() == []


def test_models_of_one_block_take_one_job(spark, table, monkeypatch):
    """Models of one block are grown whole in their tasks, not by a job per level; both ways give the same trees."""
    levels, grow = [], histboost._grow
    monkeypatch.setattr(histboost, "_grow", lambda *a: levels.append(a[2]) or grow(*a))
    df = spark.createDataFrame(table, SCHEMA)
    options = {"trees": 4, "depth": 4, "step": 0.5, "sample": 0.7, "bins": 8, "minimum": 100, "columns": ["a", "b"]}
    alone = histboost.fit(df, **options)
    assert levels == []
    # "big" has 120 rows, the global model 160: one of them is one block, then none.
    for rows in (130, 50):
        monkeypatch.setattr(histboost, "BLOCK_ROWS", rows)
        shared = histboost.fit(df, **options)
        assert levels == [0, 1, 2, 3]
        levels.clear()
        found = [{tuple(r)[:4]: r["prediction"] for r in f.predictions.collect()} for f in (alone, shared)]
        assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])
        assert {tuple(r)[:5] for r in alone.splits.collect()} == {tuple(r)[:5] for r in shared.splits.collect()}
