"""Yield regression with MLlib tree ensembles: per crop or global, with intervals and drivers."""

from __future__ import annotations

import functools
import json
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.ml.supervised import FOLDS, contiguous_folds, sized_for_training
from agrovane.scale import materialize, small_side
from agrovane.sources.schemas import KEY, PREDICTOR_COLUMNS

# Fixed values.
TREES = 200
MIN_ROWS_PER_CROP = 50
Z95 = 1.96
BOOSTED_SPREAD = 0.1
SEED = 42
GLOBAL = "*"


def boosted_trees(trees: int = TREES) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol="target",
        maxIter=trees,
        maxDepth=6,
        stepSize=0.05,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.8",
        seed=SEED,
        # Rows remember their node between levels; the ids are cut by the shared checkpoint folder.
        cacheNodeIds=True,
    )


def random_forest(trees: int = TREES) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="target",
        numTrees=trees,
        maxDepth=12,
        minInstancesPerNode=5,
        featureSubsetStrategy="all",
        # Room for the statistics of more nodes per pass: fewer passes over the rows.
        maxMemoryInMB=1024,
        seed=SEED,
    )


def assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=PREDICTOR_COLUMNS, outputCol="features").transform(df)


def crop_counts(supervised: DataFrame) -> dict[str, int]:
    """Rows per crop (as long as the crop vocabulary)."""
    counts = supervised.groupBy("cultivo").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["cultivo"]: r["n"] for r in counts}


def fit_models(
    supervised: DataFrame, estimator, scope: str = "crop", minimum: int = MIN_ROWS_PER_CROP, parallelism: int = 4
) -> dict:
    """``crop -> model`` plus the global model under ``*``.

    ``scope="crop"`` fits one distributed model per crop with at least ``minimum`` rows and the global model once for
    the others (only if there are others); ``scope="global"`` fits one model for all. Every fit is a Spark job over
    all executors, so a crop with most of the rows is no problem; ``parallelism`` fits overlap. Pass a stored table.
    """
    assembled = assemble(supervised).select(*KEY, "features", "target")
    counts = crop_counts(supervised)
    own = {crop: n for crop, n in counts.items() if n >= minimum} if scope == "crop" else {}
    jobs = {crop: sized_for_training(assembled.filter(F.col("cultivo") == crop), n) for crop, n in own.items()}
    if len(own) < len(counts):
        jobs[GLOBAL] = sized_for_training(assembled, sum(counts.values()))
    with ThreadPoolExecutor(parallelism) as pool:
        fitted = pool.map(lambda item: (item[0], estimator.copy().fit(item[1])), jobs.items())
        return dict(fitted)


def model_rows(supervised: DataFrame, models: dict) -> list[tuple[str, object, DataFrame]]:
    """The rows each model predicts: its own crop, or every crop without a model of its own."""
    assembled = assemble(supervised)
    own = [c for c in models if c != GLOBAL]
    out = [(crop, models[crop], assembled.filter(F.col("cultivo") == crop)) for crop in own]
    if GLOBAL in models:
        rest = assembled.filter(~F.col("cultivo").isin(own)) if own else assembled
        out.append((GLOBAL, models[GLOBAL], rest))
    return out


def top_drivers(model, columns: list[str] | None = None, count: int = 3) -> str:
    """The most important predictors as a JSON list."""
    columns = columns or PREDICTOR_COLUMNS
    ranked = sorted(zip(model.featureImportances.toArray(), columns, strict=True), key=lambda p: -p[0])
    return json.dumps([{"var": c, "importance": round(float(v), 4)} for v, c in ranked[:count]], ensure_ascii=False)


def _with_forest_spread(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    """Mean and population deviation of the single trees. Every tree is a JVM-side column; no Python per row."""
    names = [f"_t{i}" for i in range(len(model.trees))]
    scored = functools.reduce(
        lambda df, pair: pair[1].setFeaturesCol("features").setPredictionCol(pair[0]).transform(df),
        zip(names, model.trees, strict=True),
        rows,
    )
    values = F.array(*names)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / len(names)
    scored = scored.withColumn("prediction", mean).withColumn("_values", values).drop(*names)
    squares = F.aggregate("_values", F.lit(0.0), lambda a, v: a + (v - F.col("prediction")) * (v - F.col("prediction")))
    return scored.withColumn("ic_std", F.sqrt(squares / len(names))).drop("_values")


def boosted_interval(predicted: DataFrame) -> DataFrame:
    """Interval of ±1.96 · 0.1 · population deviation of the predictions of the crop.

    The deviation is grouped and joined back, so a crop with most of the rows is not gathered by a window.
    """
    spread = predicted.groupBy("cultivo").agg((F.stddev_pop("prediction") * BOOSTED_SPREAD).alias("ic_std"))
    return with_interval(predicted.join(small_side(spread), "cultivo"))


def with_interval(predicted: DataFrame) -> DataFrame:
    margin = F.col("ic_std") * Z95
    return predicted.withColumns(
        {
            "rendimiento_predicho": F.bround("prediction", 3),
            "rendimiento_ic_inf": F.bround(F.col("prediction") - margin, 3),
            "rendimiento_ic_sup": F.bround(F.col("prediction") + margin, 3),
        }
    )


def predict(supervised: DataFrame, models: dict) -> DataFrame:
    """Predictions, intervals and drivers for every supervised row (the results of the models, concatenated)."""
    parts = []
    for _, model, rows in model_rows(supervised, models):
        if isinstance(model, GBTRegressionModel):
            # Stored, so that the spread per crop does not score the rows again.
            scored = boosted_interval(materialize(model.transform(rows).select(*KEY, "prediction"), "tree-scores"))
        else:
            scored = with_interval(_with_forest_spread(model, rows))
        parts.append(
            scored.select(
                *KEY,
                "rendimiento_predicho",
                "rendimiento_ic_inf",
                "rendimiento_ic_sup",
                F.lit(top_drivers(model)).alias("importancia_top3"),
            )
        )
    return functools.reduce(DataFrame.unionByName, parts)


def driver_rows(supervised: DataFrame, models: dict) -> DataFrame:
    """All importances as rows ``(modelo, var, importance)``."""
    rows = [
        (name, column, float(value))
        for name, model in models.items()
        for column, value in zip(PREDICTOR_COLUMNS, model.featureImportances.toArray(), strict=True)
    ]
    return supervised.sparkSession.createDataFrame(rows, "modelo string, var string, importance double")


def cross_validated_r2(supervised: DataFrame, estimator, folds: int = FOLDS) -> float:
    """Mean R² over contiguous folds. The folded rows are stored, as every fold reads them."""
    placed = contiguous_folds(supervised, by_crop=False, folds=folds)
    folded = assemble(materialize(sized_for_training(placed, supervised.count()), "folds"))
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(labelCol="target", metricName="r2"),
        numFolds=folds,
        foldCol="fold",
        parallelism=folds,
    )
    return validator.fit(folded).avgMetrics[0]


def save_models(models: dict, folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{_folder_name(name)}")


def load_models(names: list[str], folder: str, kind=GBTRegressionModel) -> dict:
    return {name: kind.load(f"{folder}/{_folder_name(name)}") for name in names}


def _folder_name(name: str) -> str:
    """One folder per name: every character but letters and digits is written as its code."""
    return "global" if name == GLOBAL else "crop-" + re.sub(r"[^0-9A-Za-z]", lambda m: f"_{ord(m[0]):x}_", name)
