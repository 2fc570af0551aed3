import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrovane.ml import evaluation, isolation, network, supervised, trees
from agrovane.sources.schemas import FEATURE_COLUMNS, PREDICTOR_COLUMNS

KEYS = "codigo_municipio string, cultivo string, periodo date"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Two crops, one with few rows; the target is a simple function of two predictors."""
    rng = np.random.default_rng(0)
    data = []
    for zone in range(12):
        for crop in ("maiz", "yuca"):
            for month in range(24 if crop == "maiz" else 2):
                x = rng.normal(size=len(PREDICTOR_COLUMNS))
                y = 3 + 2 * x[0] + (1.5 if x[14] > 0 else -1.5)
                data.append((f"{zone:05d}", crop, dt.date(2020 + month // 12, month % 12 + 1, 1), *map(float, x), float(y)))
    schema = KEYS + ", " + ", ".join(f"{c} double" for c in PREDICTOR_COLUMNS) + ", target double"
    path = str(tmp_path_factory.mktemp("m") / "t")
    spark.createDataFrame(data, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_next_target_and_null_rules(spark):
    base = spark.createDataFrame(
        [("z", "c", dt.date(2020, m, 1), y) for m, y in ((1, 5.0), (2, None), (3, 7.0), (4, 8.0))], KEYS + ", y double"
    ).withColumns({c: F.lit(None).cast("double") for c in FEATURE_COLUMNS})
    strict = supervised.supervised_set(base, "y").orderBy("periodo").collect()
    assert [(r["periodo"].month, r["target"]) for r in strict] == [(3, 8.0)]
    loose = supervised.supervised_set(base, "y", require_current=False).orderBy("periodo").collect()
    assert [(r["periodo"].month, r["target"]) for r in loose] == [(2, 7.0), (3, 8.0)]
    assert strict[0]["pct_rural"] == 0.0


def test_standardizer_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    got = supervised.Standardizer.fit(df, ["a", "b"]).transform(df).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    np.testing.assert_allclose(got["a"], (x - x.mean()) / x.std())
    assert set(got["b"]) == {0.0}


@pytest.mark.parametrize("n", [3, 5, 23])
def test_folds_are_contiguous(spark, n):
    random.seed(n)
    keys = [(f"{random.randint(0, 3):05d}", random.choice("ab"), dt.date(2000, 1, 1) + dt.timedelta(days=i)) for i in range(n)]
    df = spark.createDataFrame(keys, KEYS)
    got = {(r[0], r[1], r[2]): r["fold"] for r in supervised.contiguous_folds(df, by_crop=False).collect()}
    sizes = [n // 5 + (i < n % 5) for i in range(5)]
    expected = [f for f, s in enumerate(sizes) for _ in range(s)]
    assert [got[k] for k in sorted(keys)] == expected
    per_crop = {(r[0], r[1], r[2]): r["fold"] for r in supervised.contiguous_folds(df).collect()}
    for crop in "ab":
        mine = sorted(k for k in keys if k[1] == crop)
        m = len(mine)
        assert [per_crop[k] for k in mine] == [f for f in range(5) for _ in range(m // 5 + (f < m % 5))]


@pytest.mark.parametrize("periods,newest", [(1, 1), (4, 1), (12, 2), (13, 3), (24, 5)])
def test_holdout_cutoff(spark, periods, newest):
    df = spark.range(periods).select(F.add_months(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("periodo"))
    row = supervised.holdout_cutoff(df.union(df)).first()
    assert row["periodos"] == periods
    assert df.filter(F.col("periodo") >= row["periodo_corte"]).count() == newest


def test_split_needs_rows_on_both_sides(spark, table):
    with pytest.raises(ValueError):
        supervised.temporal_split(table.limit(10))


def test_metrics(spark):
    df = spark.createDataFrame([("m", 1.0, 1.5), ("m", 2.0, 2.0), ("m", 4.0, 3.0), ("k", 2.0, 3.0), ("k", 2.0, 1.0)], "modelo string, target double, prediction double")
    got = {r["modelo"]: r for r in supervised.regression_metrics(df, ["modelo"]).collect()}
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 2, 3])
    assert got["m"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    assert got["m"]["mae"] == 0.5 and got["k"]["r2"] is None and got["k"]["rmse"] == 1.0


def test_trees_per_crop_with_global_fallback(spark, table, tmp_path):
    models = trees.fit_models(table, trees.boosted_trees(3))
    assert set(models) == {"maiz", trees.GLOBAL}
    out = trees.predict(table, models)
    assert out.count() == table.count()
    rows = out.collect()
    assert all(r["rendimiento_ic_inf"] <= r["rendimiento_predicho"] <= r["rendimiento_ic_sup"] for r in rows)
    drivers = json.loads(next(r["importancia_top3"] for r in rows if r["cultivo"] == "maiz"))
    assert len(drivers) == 3 and {drivers[0]["var"], drivers[1]["var"]} == {PREDICTOR_COLUMNS[0], PREDICTOR_COLUMNS[14]}
    trees.save_models(models, str(tmp_path))
    again = trees.predict(table, trees.load_models(list(models), str(tmp_path)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_forest_interval_is_the_spread_of_its_trees(table):
    models = trees.fit_models(table, trees.random_forest(4), scope="global")
    out = trees.predict(table, models).orderBy("codigo_municipio", "cultivo", "periodo").limit(20).collect()
    features = trees.assemble(table).orderBy("codigo_municipio", "cultivo", "periodo").limit(20).collect()
    for row, f in zip(out, features):
        single = np.array([t.predict(f["features"]) for t in models[trees.GLOBAL].trees])
        assert row["rendimiento_predicho"] == pytest.approx(single.mean(), abs=6e-4)
        assert row["rendimiento_ic_sup"] == pytest.approx(single.mean() + 1.96 * single.std(), abs=6e-4)


def test_cross_validation_runs_on_contiguous_folds(table):
    assert -1 < trees.cross_validated_r2(table, trees.boosted_trees(3)) <= 1


def _unusual(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    x[17] = [9, 9, 9]
    data = [(f"{i:05d}", "big" if i < 580 else "small", dt.date(2020, 1, 1), float(a), float(b), 1.0 if i % 9 else None) for i, (a, b, _) in enumerate(x)]
    return spark.createDataFrame(data, KEYS + ", u double, v double, w double")


@pytest.mark.parametrize("scope", ["global", "group"])
def test_isolation_forest(spark, scope):
    df, columns = _unusual(spark), ["u", "v", "w"]
    nodes = isolation.fit_forest(df, columns, scope, trees=15)
    assert nodes.select("modelo").distinct().count() == (1 if scope == "global" else 2)
    assert nodes.groupBy("modelo", "tree").count().agg(F.max("count")).first()[0] < 2 * isolation.SAMPLE
    raw = isolation.raw_scores(df, nodes, columns, scope)
    assert raw.count() == 600
    out = isolation.rescale(raw)
    got = {r["codigo_municipio"]: r for r in out.collect()}
    assert got["00017"]["anomaly_score"] == pytest.approx(1.0) and got["00017"]["is_anomaly"]
    assert all(-1e-9 <= r["anomaly_score"] <= 1.0 for r in got.values())
    flagged = sum(r["is_anomaly"] for r in got.values())
    assert 20 <= flagged <= 40
    again = isolation.fit_forest(df.repartition(7), columns, scope, trees=15)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nodes.collect()))


def test_average_path_values():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert isolation.average_path(256) == pytest.approx(10.244, abs=0.01)


def test_rescale_single_row_crop(spark):
    raw = spark.createDataFrame([("z", "solo", dt.date(2020, 1, 1), "*", -0.4)], KEYS + ", modelo string, raw double")
    row = isolation.rescale(raw).first()
    assert row["anomaly_score"] == 1.0 and row["is_anomaly"] is False


def test_network_learns_and_round_trips(spark, table, tmp_path):
    fitted = network.YieldNetwork.fit(table, max_rounds=30)
    out = fitted.transform(table)
    mse, base = out.agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2)), F.var_pop("target")).first()
    # The untrained network is worse than the mean; few rows mean few steps per round.
    assert mse < 0.95 * base and fitted.validation_r2 > 0
    interval = network.network_interval(out)
    assert interval.filter("nnet_ic_inf > rendimiento_nnet or nnet_ic_sup < rendimiento_nnet").count() == 0
    fitted.save(spark, str(tmp_path / "n"))
    loaded = network.YieldNetwork.load(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, network.predict(table, loaded).collect())) == sorted(map(tuple, interval.collect()))


def test_network_trains_on_stored_shares(spark, table, monkeypatch):
    """Rounds read NumPy blocks, cut at SHARE_ROWS, and average them by their rows."""
    stored, write = [], network.materialize
    monkeypatch.setattr(network, "materialize", lambda df, name: stored.append((name, write(df, name))) or stored[-1][1])
    monkeypatch.setattr(network, "SHARE_ROWS", 7)
    fitted = network.YieldNetwork.fit(table, max_rounds=2)
    (name, shares), inputs = stored[0], len(network.PREDICTOR_COLUMNS)
    assert name == "network-shares"
    blocks = [network._unpacked(r, inputs) for r in shares.collect()]
    assert sum(len(y) for _, y, _ in blocks) == table.count() and max(len(y) for _, y, _ in blocks) == 7
    first = network._initial(inputs, network.SEED)
    passes = [network._pass(b, np.concatenate([first, np.zeros(2 * len(first))]), 0, network.SEED) for b in blocks]
    mean = sum(p[0] for p in passes) / sum(p[1] for p in passes)
    assert fitted.rounds == 2 and any(np.allclose(fitted.weights, w) for w in (first, mean[: len(first)]))


def test_network_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7)
    flat = network._initial(5, 3)
    loss = lambda w: 0.5 * np.mean((network._forward(w, x)[-1][:, 0] - y) ** 2)
    grad = network._gradient(flat, x, y)
    for i in rng.integers(0, len(flat), 25):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        numeric = (loss(flat + step) - loss(flat - step)) / 2e-6
        assert grad[i] == pytest.approx(numeric, abs=2e-4)


def test_evaluation_table(table):
    got = evaluation.evaluate_models(table.filter("cultivo = 'maiz'"), trees.boosted_trees(2), max_rounds=3)
    rows = {r["modelo"]: r for r in got.collect()}
    assert set(rows) == {"arbol_gbm", "red_neuronal"} and rows["arbol_gbm"]["periodo_corte"] == "2021-08-01"
    assert rows["arbol_gbm"]["n_train"] + rows["arbol_gbm"]["n_test"] == 288
    assert evaluation.best_model(got) in rows
