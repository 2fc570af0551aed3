"""Temporal hold-out evaluation of the yield models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.ml.network import MAX_ROUNDS, YieldNetwork
from agrovane.ml.supervised import regression_metrics, sized_for_training, temporal_split
from agrovane.ml.trees import assemble, boosted_trees


def evaluate_models(supervised: DataFrame, tree_estimator=None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row per model: R², MAE, RMSE, sizes, cutoff and time. Trained on the older periods, measured on the newest."""
    train, test, cutoff = temporal_split(supervised)
    rows = train.count()
    tree = (tree_estimator or boosted_trees()).fit(sized_for_training(assemble(train), rows))
    network = YieldNetwork.fit(train, max_rounds)
    predicted = (
        tree.transform(assemble(test))
        .select(F.lit("arbol_gbm").alias("modelo"), "target", "prediction")
        .unionByName(network.transform(test).select(F.lit("red_neuronal").alias("modelo"), "target", "prediction"))
    )
    return (
        regression_metrics(predicted, ["modelo"])
        .withColumn("n_train", F.lit(rows))
        .withColumn("periodo_corte", F.lit(cutoff.isoformat()))
        .withColumn("generado_en", F.lit(dt.datetime.now(dt.UTC).isoformat()))
        .select("modelo", "r2", "mae", "rmse", "n_train", "n_test", "periodo_corte", "generado_en")
    )


def best_model(evaluation: DataFrame) -> str:
    return evaluation.agg(F.max_by("modelo", "r2")).first()[0]
