"""Productive exposure and economic vulnerability features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.functions.numeric import lenient_month, lenient_number
from agrovane.sources.landing import resolve_column

CROP_ZONE = ["cultivo", "codigo_municipio"]

# Accepted names in the price index source.
PRICE_DATE_NAMES = ["periodo", "fecha", "mes", "date", "fechaperiodo"]
PRICE_VALUE_NAMES = ["nivel", "indice", "valor", "value", "insumos_nivel"]


def yield_stats(production: DataFrame) -> DataFrame:
    """Mean yield, its coefficient of variation and total areas per crop and zone."""
    mean = F.avg("rendimiento")
    return (
        production.filter(
            F.col("rendimiento").isNotNull() & F.col("codigo_municipio").isNotNull() & F.col("cultivo").isNotNull()
        )
        .groupBy(
            F.lower(F.trim("cultivo")).alias("cultivo"), F.trim("codigo_municipio").alias("codigo_municipio")
        )
        .agg(
            mean.alias("rendimiento_promedio"),
            F.when(mean > 0, F.stddev_samp("rendimiento") / mean).otherwise(0.0).alias("rendimiento_cv"),
            F.sum("area_sembrada").alias("area_sembrada"),
            F.sum("area_cosechada").alias("area_cosechada"),
        )
    )


def crop_share(stats: DataFrame) -> DataFrame:
    """Share of each zone in the national area of the crop; NULL if the crop has no area.

    ``stats`` has one row per crop and zone, so the window of a crop holds at most one row per zone; a grouped total
    joined back would aggregate the production facts a second time.
    """
    total = F.coalesce(F.sum("area_sembrada").over(Window.partitionBy("cultivo")), F.lit(0.0))
    return stats.withColumn("participacion_municipal", F.col("area_sembrada") / F.nullif(total, F.lit(0.0)))


def attach_calendar(stats: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Sowing and harvest month by crop and zone, or by crop alone if the calendar has no zone."""
    if calendar is None:
        return stats.withColumn("mes_siembra", F.lit(None).cast("int")).withColumn(
            "mes_cosecha", F.lit(None).cast("int")
        )
    keys = [k for k in CROP_ZONE if k in calendar.columns]
    shaped = calendar.filter(F.col("cultivo").isNotNull()).select(
        F.lower(F.trim("cultivo")).alias("cultivo"),
        *[F.trim(k).alias(k) for k in keys if k != "cultivo"],
        F.col("mes_siembra").cast("int").alias("mes_siembra"),
        F.col("mes_cosecha").cast("int").alias("mes_cosecha"),
    )
    return stats.join(shaped, keys, "left")


def production_features(production: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    return attach_calendar(crop_share(yield_stats(production)), calendar)


def price_features(
    raw: DataFrame, series: str | None = None, window: int = 12, min_periods: int = 6, average_month: bool = False
) -> DataFrame:
    """Price level, its deviation from the trailing mean and its three-row change.

    ``series`` names a column that separates several series; each is bounded by the calendar. Two rows in one month are
    kept (and later double the master rows); ``average_month`` merges them first.
    """
    date = resolve_column(raw, PRICE_DATE_NAMES)
    value = resolve_column(raw, PRICE_VALUE_NAMES)
    keys = [series] if series else []
    levels = raw.select(
        *keys, lenient_month(F.col(f"`{date}`")).alias("periodo"), lenient_number(F.col(f"`{value}`")).alias("insumos_nivel")
    ).na.drop(subset=["periodo", "insumos_nivel"])
    if average_month:
        levels = levels.groupBy(*keys, "periodo").agg(F.avg("insumos_nivel").alias("insumos_nivel"))
    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("periodo", "insumos_nivel")
    trailing = ordered.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("insumos_nivel").over(trailing) >= min_periods, F.avg("insumos_nivel").over(trailing))
    return levels.select(
        *keys,
        "periodo",
        "insumos_nivel",
        (F.col("insumos_nivel") - mean).alias("insumos_anomalia_12m"),
        (F.col("insumos_nivel") - F.lag("insumos_nivel", 3).over(ordered)).alias("insumos_delta_3m"),
    )


def socio_features(source: DataFrame) -> DataFrame:
    """Socio-economic columns of the index; one the source lacks is a typed NULL."""
    wanted = ["nbi_total", "poblacion_rural", "pct_rural"]
    return source.filter(F.col("codigo_municipio").isNotNull()).select(
        "codigo_municipio",
        *[(F.col(c) if c in source.columns else F.lit(None)).cast("double").alias(c) for c in wanted],
    )
