"""The three fits of the served results run side by side, and the network leaves nothing in the executors' stores."""

import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrovane.ml import histboost, network
from agrovane.plans import pipeline
from agrovane.sources.schemas import PREDICTOR_COLUMNS


class Met(Exception):
    pass


def test_fits_do_not_wait_for_each_other(spark, monkeypatch):
    all_here = threading.Barrier(3)

    def meet(*args, **options):
        all_here.wait(20)
        raise Met

    monkeypatch.setattr(pipeline, "materialize", lambda df, name: df)
    monkeypatch.setattr(pipeline, "supervised_set", lambda df, **options: df)
    monkeypatch.setattr(pipeline.isolation, "fit_forest", meet)
    monkeypatch.setattr(pipeline.histboost, "fit", meet)
    monkeypatch.setattr(pipeline.network.YieldNetwork, "fit", staticmethod(meet))
    rows = spark.range(1)
    with pytest.raises(Met):
        pipeline.full_results(SimpleNamespace(master=rows, normalized=rows, scores=rows))


def test_shares_are_let_go(spark):
    values = [F.rand(k).alias(c) for k, c in enumerate(PREDICTOR_COLUMNS)]
    key = [F.col("id").cast("string").alias("codigo_municipio"), F.lit("a").alias("cultivo"), F.lit("2020-01-01").cast("date").alias("periodo")]
    rows = spark.range(300).select(*key, *values, F.rand(99).alias("target"))
    assert network.YieldNetwork.fit(rows, 2).rounds == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_thresholds_of_many_nodes_are_those_of_each():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (150, 1, 7)).repeat(3, axis=1)
    nodes = [(k, np.stack([rng.normal(size=(3, 7)) * c, c.astype(float)])) for k, c in enumerate(counts) if c.any()]
    together = list(histboost._best(iter(nodes)))
    assert together == [next(histboost._best(iter([n]))) for n in nodes] and len(together) == len(nodes) > histboost.NODES_AT_ONCE
