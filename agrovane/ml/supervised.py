"""Supervised yield set, standardisation, folds and hold-out by period."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.sources.schemas import KEY, PREDICTOR_COLUMNS

ZONE_CROP = ["codigo_municipio", "cultivo"]
HOLD_OUT = 0.2
MIN_ROWS_PER_SIDE = 20
FOLDS = 5
ROWS_PER_TASK = 8_000


def next_target(master: DataFrame, yield_col: str = "rendimiento_promedio") -> DataFrame:
    """Adds ``target``: the yield of the next period of the same zone and crop."""
    order = Window.partitionBy(*ZONE_CROP).orderBy("periodo", yield_col, "insumos_nivel")
    return master.withColumn("target", F.lead(yield_col, 1).over(order))


def supervised_set(
    master: DataFrame, yield_col: str = "rendimiento_promedio", require_current: bool = True
) -> DataFrame:
    """Key, 23 predictors (NULL as 0) and target. The tree models also require the current yield, the network does not."""
    needed = ["target", yield_col] if require_current else ["target"]
    rows = next_target(master, yield_col).na.drop(subset=needed)
    predictors = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PREDICTOR_COLUMNS]
    return rows.select(*KEY, *predictors, F.col("target").cast("double").alias("target"))


def sized_for_training(df: DataFrame, rows: int) -> DataFrame:
    """Partitions by row count alone, so that what is fitted per partition does not depend on the cluster.

    Every boosting step schedules one task per partition, so a small crop must not inherit the splits of the table.
    """
    return df.repartition(max(1, -(-rows // ROWS_PER_TASK)), *KEY)


@dataclass(frozen=True)
class Standardizer:
    """Zero mean and unit population deviation per column; a constant column becomes 0."""

    moments: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Standardizer:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()})


def contiguous_folds(df: DataFrame, by_crop: bool = True, folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``: consecutive blocks of the order (zone, crop, period), the first blocks one row longer.

    The global position is the number of rows of earlier zones, plus those of earlier crops in the zone, plus the
    position inside the pair. Only counts per zone and per pair are ordered across the table, never the rows.
    """
    scope = ["cultivo"] if by_crop else []
    pairs = df.groupBy(*ZONE_CROP).agg(F.count(F.lit(1)).alias("_n"))
    zones = pairs.groupBy("codigo_municipio", *scope).agg(F.sum("_n").alias("_nz"))
    before = Window.partitionBy(*(scope or [F.lit(0)])).orderBy("codigo_municipio")
    zones = zones.select(
        "codigo_municipio",
        *scope,
        (F.sum("_nz").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_nz")).alias("_zone_start"),
        F.sum("_nz").over(Window.partitionBy(*(scope or [F.lit(0)]))).alias("_total"),
    )
    in_zone = Window.partitionBy("codigo_municipio", *scope).orderBy("cultivo")
    starts = pairs.join(zones, ["codigo_municipio", *scope]).withColumn(
        "_start",
        F.col("_zone_start") + F.sum("_n").over(in_zone.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
    )
    inside = Window.partitionBy(*ZONE_CROP).orderBy("periodo")
    placed = df.join(starts.select(*ZONE_CROP, "_start", "_total"), ZONE_CROP).withColumn(
        "_position", F.col("_start") + F.row_number().over(inside) - 1
    )
    short = F.floor(F.col("_total") / folds)
    extra = F.col("_total") % folds
    in_long = F.col("_position") < extra * (short + 1)
    fold = F.when(in_long, F.floor(F.col("_position") / (short + 1))).otherwise(
        extra + F.floor((F.col("_position") - extra * (short + 1)) / F.greatest(short, F.lit(1)))
    )
    return placed.withColumn("fold", fold.cast("int")).drop("_start", "_total", "_position")


def holdout_cutoff(df: DataFrame, fraction: float = HOLD_OUT) -> DataFrame:
    """One row ``(periodo_corte, periodos)``: the first of the newest ``max(1, round(fraction * periods))`` periods.

    The distinct periods form a calendar-sized array.
    """
    periods = df.agg(F.sort_array(F.collect_set("periodo"), False).alias("p"))
    wanted = F.greatest(F.lit(1), F.bround(F.size("p") * F.lit(fraction), 0).cast("int"))
    return periods.select(F.element_at("p", wanted).alias("periodo_corte"), F.size("p").alias("periodos"))


def temporal_split(df: DataFrame, fraction: float = HOLD_OUT) -> tuple[DataFrame, DataFrame, dt.date]:
    """Train on the older periods, test on the newest; an error if a side has fewer than 20 rows."""
    cutoff = holdout_cutoff(df, fraction).first()["periodo_corte"]
    if cutoff is None:
        raise ValueError("no supervised rows")
    train, test = df.filter(F.col("periodo") < F.lit(cutoff)), df.filter(F.col("periodo") >= F.lit(cutoff))
    if min(train.count(), test.count()) < MIN_ROWS_PER_SIDE:
        raise ValueError(f"fewer than {MIN_ROWS_PER_SIDE} rows on one side of {cutoff}")
    return train, test, cutoff


def regression_metrics(predicted: DataFrame, by: list[str], actual: str = "target", prediction: str = "prediction") -> DataFrame:
    """R², MAE and RMSE (4 decimals) and row count per group, in one aggregation; R² is NULL for a constant target."""
    error = F.col(actual) - F.col(prediction)
    spread = F.var_pop(actual) * F.count(actual)
    return predicted.groupBy(*by).agg(
        F.bround(1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0)), 4).alias("r2"),
        F.bround(F.avg(F.abs(error)), 4).alias("mae"),
        F.bround(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.count(F.lit(1)).alias("n_test"),
    )
