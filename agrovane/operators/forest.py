"""Forest-loss tables and features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.operators.names import attach_codes, resolve_names
from agrovane.scale import materialize

# Fixed values.
CANOPY_THRESHOLD = 30
LOSS_PREFIX = "tc_loss_ha_"
RISING, FALLING = 50, -50
UNIT_PATTERN = r"^[A-Z]{3}\.(\d+)\.(\d+)_"


def loss_by_year(landed: DataFrame, primary_only: bool = False, threshold: int = CANOPY_THRESHOLD) -> DataFrame:
    """Loss per administrative unit and year at one canopy threshold."""
    rows = landed.filter(F.col("threshold") == threshold)
    if primary_only:
        rows = rows.filter(F.col("primary_forest"))
    return rows.groupBy("iso", "adm1", "adm2", "year").agg(F.sum("ha").alias("ha"))


def unit_names(adm_names: DataFrame) -> DataFrame:
    """Names by numeric unit codes; ids that do not parse are dropped, a repeated unit takes its greatest id."""
    level = lambda group: F.nullif(F.regexp_extract("gid_2", UNIT_PATTERN, group), F.lit("")).cast("int")
    return (
        adm_names.select(level(1).alias("adm1"), level(2).alias("adm2"), "gid_2", "name_1", "name_2")
        .filter(F.col("adm1").isNotNull() & F.col("name_2").isNotNull())
        .groupBy("adm1", "adm2")
        .agg(F.max_by(F.struct("name_1", "name_2"), "gid_2").alias("n"))
        .select(
            "adm1",
            "adm2",
            F.coalesce("n.name_1", F.lit("")).alias("departamento"),
            F.col("n.name_2").alias("municipio"),
        )
    )


def typed_loss(long: DataFrame) -> DataFrame:
    """Loss rows with numeric fields; a row with an unreadable field is dropped, an absent loss is 0."""
    return (
        long.select(
            F.col("adm1").cast("string").try_cast("int").alias("adm1"),
            F.col("adm2").cast("string").try_cast("int").alias("adm2"),
            F.col("year").cast("string").try_cast("int").alias("year"),
            F.coalesce("ha", F.lit(0)).cast("string").try_cast("double").alias("ha"),
        )
        .na.drop()
    )


def name_units(long: DataFrame, names: DataFrame) -> DataFrame:
    """Loss rows with department and municipality; rows of unnamed units are dropped."""
    return typed_loss(long).join(names, ["adm1", "adm2"])


def unnamed_units(long: DataFrame, names: DataFrame) -> DataFrame:
    """The rows that ``name_units`` drops for want of a name."""
    return typed_loss(long).join(names.select("adm1", "adm2"), ["adm1", "adm2"], "left_anti")


def loss_wide(named: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row per unit, one column per year. Without ``years`` the distinct years are looked up (a short list)."""
    if years is None:
        years = sorted(r["year"] for r in named.select("year").distinct().collect())
    wide = named.groupBy("adm1", "adm2", "departamento", "municipio").pivot("year", years).agg(F.sum("ha"))
    return wide.select(
        F.lit("Colombia").alias("country"),
        F.col("departamento").alias("subnational1"),
        F.col("municipio").alias("subnational2"),
        F.lit(CANOPY_THRESHOLD).alias("threshold"),
        *[F.col(f"`{y}`").alias(f"{LOSS_PREFIX}{y}") for y in years],
    )


def loss_long(wide: DataFrame, value: str = "tc_loss_ha", start_year: int = 2001) -> DataFrame:
    """Positive yearly losses at the canopy threshold from year-suffixed columns."""
    columns = [c for c in wide.columns if re.fullmatch(rf"{LOSS_PREFIX}\d+", c)]
    kept = [c for c in columns if int(c.removeprefix(LOSS_PREFIX)) >= start_year]
    return (
        wide.filter(F.col("threshold") == CANOPY_THRESHOLD)
        .select("subnational1", "subnational2", *[F.col(c).cast("double").alias(c) for c in kept])
        .unpivot(["subnational1", "subnational2"], kept, "column", value)
        .filter(F.col(value) > 0)
        .select(
            F.col("subnational1").alias("departamento"),
            F.col("subnational2").alias("municipio"),
            F.replace("column", F.lit(LOSS_PREFIX), F.lit("")).cast("int").alias("year"),
            value,
        )
    )


def with_primary(loss: DataFrame, primary: DataFrame | None) -> DataFrame:
    """Primary-forest loss of the same unit and year; 0 where there is none."""
    if primary is None:
        return loss.withColumn("primary_loss_ha", F.lit(0.0))
    return loss.join(primary, ["departamento", "municipio", "year"], "left").withColumn(
        "primary_loss_ha", F.coalesce("primary_loss_ha", F.lit(0.0))
    )


def loss_features(loss: DataFrame) -> DataFrame:
    """Recent totals, mean, number of years and trend per zone.

    The latest year of the whole table names a column, so it is looked up first (one scalar). Rows are folded to one
    per zone and year before the zone is formed.
    """
    known = loss.filter(F.col("codigo_municipio").isNotNull())
    latest = known.agg(F.max("year")).first()[0]
    if latest is None:
        raise ValueError("no loss row has a zone")
    yearly = known.groupBy("codigo_municipio", "year").agg(
        F.sum("tc_loss_ha").alias("ha"),
        F.sum("primary_loss_ha").alias("primary_ha"),
        F.count("tc_loss_ha").alias("rows"),
    )
    recent = F.col("year") >= latest - 4

    def total(condition, column):
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0.0))

    slope = F.when(
        F.count_if(recent) >= 3,
        F.regr_slope(F.when(recent, F.col("ha")), F.when(recent, F.col("year").cast("double"))),
    ).otherwise(0.0)
    return (
        yearly.groupBy("codigo_municipio")
        .agg(
            total(F.col("year") == latest, "ha").alias(f"deforestacion_{latest}"),
            total(recent, "ha").alias("deforestacion_total_5y"),
            total(F.col("year") >= latest - 9, "ha").alias("deforestacion_total_10y"),
            total(recent, "primary_ha").alias("primary_loss_5y"),
            (F.sum("ha") / F.sum("rows")).alias("deforestacion_ha_promedio"),
            F.count(F.lit(1)).alias("n_anos_datos"),
            slope.alias("deforestacion_tendencia"),
        )
        .withColumn("deforestacion_tendencia_label", trend_label(F.col("deforestacion_tendencia")))
    )


def trend_label(slope: F.Column) -> F.Column:
    return (
        F.when(slope.isNull(), "Sin datos")
        .when(slope > RISING, "Aumentando")
        .when(slope > FALLING, "Estable")
        .otherwise("Disminuyendo")
    )


def deforestation_features(wide: DataFrame, primary_wide: DataFrame | None, zones: DataFrame) -> DataFrame:
    """Loss features per zone from the two wide files and the zone dictionary."""
    loss = loss_long(wide)
    primary = None if primary_wide is None else loss_long(primary_wide, "primary_loss_ha", 2002)
    joined = with_primary(loss, primary)
    resolved = materialize(resolve_names(joined, zones), "resolved-names")
    return loss_features(attach_codes(joined, resolved))
