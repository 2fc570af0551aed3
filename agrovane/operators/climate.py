"""Monthly climate hazard features per zone."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.operators.stations import COUNT, MIN, SUM, Partial, aggregate_by_zone
from agrovane.sources.schemas import SPC_COLUMNS

# Fixed values.
WET_DAY_MM = 1
EXTREME_RAIN_QUANTILE = 0.95
CRITICAL_TMAX = 33.0

ZONE_MONTH = ["codigo_municipio", "periodo"]


def _month():
    return F.trunc(F.col("fechaobservacion").cast("date"), "month")


def rain_daily(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Rain per zone and day: the sum over all stations and readings.

    From here on a zone has at most one row per calendar day, so windows by zone stay small whatever the number of
    readings.
    """
    day = F.col("fechaobservacion").cast("date")
    return aggregate_by_zone(observations, stations, {"fecha": day}, [SUM]).select(
        "codigo_municipio", "fecha", F.col("suma").alias("precip_dia")
    )


def rain_rolling(daily: DataFrame, rows: int = 7) -> DataFrame:
    """Trailing sum over the last ``rows`` rows of the zone (rows, not calendar days)."""
    window = Window.partitionBy("codigo_municipio").orderBy("fecha").rowsBetween(-(rows - 1), 0)
    return daily.withColumn("precip_7d", F.sum("precip_dia").over(window))


def extreme_rain(daily: DataFrame, quantile: float = EXTREME_RAIN_QUANTILE) -> DataFrame:
    """Per-zone threshold of extreme daily rain, added as ``umbral``.

    The exact percentile keeps one entry per distinct daily value of the zone, at most one per calendar day.
    """
    window = Window.partitionBy("codigo_municipio")
    return daily.withColumn("umbral", F.percentile("precip_dia", F.lit(quantile)).over(window))


def dry_runs(daily: DataFrame, wet: float = WET_DAY_MM) -> DataFrame:
    """Length of the dry run up to each day as ``racha``, starting anew at each month; NULL on wet days.

    The run length is the month's running count of dry days minus its value at the last wet day.
    """
    is_dry = F.col("precip_dia") < wet
    so_far = (
        Window.partitionBy("codigo_municipio", F.trunc("fecha", "month"))
        .orderBy("fecha")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = daily.withColumn("_dry", F.count_if(is_dry).over(so_far))
    at_last_wet = F.max(F.when(~is_dry, F.col("_dry"))).over(so_far)
    run = F.col("_dry") - F.coalesce(at_last_wet, F.lit(0))
    return counted.withColumn("racha", F.when(is_dry, run)).drop("_dry")


def dry_streaks(daily: DataFrame, wet: float = WET_DAY_MM) -> DataFrame:
    """Longest dry run per zone and month; months without a dry day have no row."""
    return (
        dry_runs(daily, wet)
        .groupBy("codigo_municipio", F.trunc("fecha", "month").alias("periodo"))
        .agg(F.max("racha").alias("dias_secos_consecutivos"))
        .filter(F.col("dias_secos_consecutivos").isNotNull())
    )


def with_anomaly(monthly: DataFrame, value: str, anomaly: str) -> DataFrame:
    """Monthly value minus the mean of the same calendar month over the years."""
    window = Window.partitionBy("codigo_municipio", F.month("periodo"))
    return monthly.withColumn(anomaly, F.col(value) - F.avg(value).over(window))


def _rain_months(daily: DataFrame) -> DataFrame:
    """Rain features but the anomaly. All windows share the partitioning by zone, so one shuffle serves them."""
    days = dry_runs(extreme_rain(rain_rolling(daily.repartition("codigo_municipio"))))
    return days.groupBy("codigo_municipio", F.trunc("fecha", "month").alias("periodo")).agg(
        F.avg("precip_7d").alias("precip_acum_7d"),
        F.sum("precip_dia").alias("precip_acum_30d"),
        F.max("racha").alias("dias_secos_consecutivos"),
        F.count_if(F.col("precip_dia") > F.col("umbral")).alias("dias_lluvia_extrema"),
    )


def rain_monthly(daily: DataFrame) -> DataFrame:
    """The five rain features."""
    return with_anomaly(_rain_months(daily), "precip_acum_30d", "precip_anomalia_30d")


def _mean():
    return F.col("suma") / F.col("lecturas")


def _critical_count(critical: float) -> Partial:
    return Partial("criticas", lambda v: F.count_if(v > critical), F.sum)


def tmax_monthly(observations: DataFrame, stations: DataFrame, critical: float = CRITICAL_TMAX) -> DataFrame:
    """Monthly mean of the maximum temperature, its anomaly and the number of critical readings."""
    hot = _critical_count(critical)
    monthly = aggregate_by_zone(observations, stations, {"periodo": _month()}, [SUM, COUNT, hot]).select(
        *ZONE_MONTH, _mean().alias("tmax_media_7d"), F.col("criticas").alias("dias_tmax_critica")
    )
    return with_anomaly(monthly, "tmax_media_7d", "tmax_anomalia_30d")


def mean_with_anomaly(observations: DataFrame, stations: DataFrame, prefix: str) -> DataFrame:
    """Monthly mean and anomaly of one variable (humidity, pressure)."""
    monthly = aggregate_by_zone(observations, stations, {"periodo": _month()}, [SUM, COUNT]).select(
        *ZONE_MONTH, _mean().alias(f"{prefix}_media_30d")
    )
    return with_anomaly(monthly, f"{prefix}_media_30d", f"{prefix}_anomalia_30d")


def humidity_monthly(observations: DataFrame, stations: DataFrame) -> DataFrame:
    return mean_with_anomaly(observations, stations, "humedad")


def pressure_monthly(observations: DataFrame, stations: DataFrame) -> DataFrame:
    return mean_with_anomaly(observations, stations, "presion")


def ambient_monthly(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Monthly mean and lowest reading of the ambient temperature."""
    return aggregate_by_zone(observations, stations, {"periodo": _month()}, [SUM, COUNT, MIN]).select(
        *ZONE_MONTH, _mean().alias("tambiente_media_30d"), F.col("minimo").alias("tmin_media_30d")
    )


def wind_monthly(observations: DataFrame, stations: DataFrame) -> DataFrame:
    return aggregate_by_zone(observations, stations, {"periodo": _month()}, [SUM, COUNT]).select(
        *ZONE_MONTH, _mean().alias("viento_media_30d")
    )


def outer_merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of frames that each have at most one row per key.

    A union and one grouping give the same rows as the chain of full outer joins with one shuffle instead of a
    shuffle and a sort per join.
    """
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


# Column of the merged table by (source, aggregate) and the anomaly that follows from it.
_MONTHLY_VALUES = {
    "tmax_media_7d": ("temperatura", "mean"),
    "dias_tmax_critica": ("temperatura", "criticas"),
    "humedad_media_30d": ("humedad", "mean"),
    "presion_media_30d": ("presion", "mean"),
    "tambiente_media_30d": ("tambiente", "mean"),
    "tmin_media_30d": ("tambiente", "minimo"),
    "viento_media_30d": ("viento", "mean"),
}
_ANOMALIES = {
    "precip_anomalia_30d": "precip_acum_30d",
    "tmax_anomalia_30d": "tmax_media_7d",
    "humedad_anomalia_30d": "humedad_media_30d",
    "presion_anomalia_30d": "presion_media_30d",
}


def climate_features(
    rain: DataFrame,
    tmax: DataFrame,
    humidity: DataFrame,
    pressure: DataFrame,
    ambient: DataFrame,
    wind: DataFrame,
    stations: DataFrame,
    critical: float = CRITICAL_TMAX,
) -> DataFrame:
    """All 15 climate features per zone and month from the six observation tables.

    Equals the full outer merge of the six monthly operators, in fewer steps: the five monthly sources are stacked and
    aggregated in one shuffle, and the four calendar-month baselines come from one window over the merged months (an
    average skips the months a source lacks).
    """
    sources = {"temperatura": tmax, "humedad": humidity, "presion": pressure, "tambiente": ambient, "viento": wind}
    columns = ["codigoestacion", "fechaobservacion", "valorobservado"]
    stacked = functools.reduce(
        DataFrame.unionByName, [df.select(*columns, F.lit(kind).alias("fuente")) for kind, df in sources.items()]
    )
    keys = {"periodo": _month(), "fuente": F.col("fuente")}
    sums = aggregate_by_zone(stacked, stations, keys, [SUM, COUNT, MIN, _critical_count(critical)])
    spread = sums.withColumn("mean", _mean()).select(
        *ZONE_MONTH,
        *[F.expr(f"CASE WHEN fuente = '{kind}' THEN {value} END AS {name}") for name, (kind, value) in _MONTHLY_VALUES.items()],
    )
    merged = outer_merge([_rain_months(rain_daily(rain, stations)), spread], ZONE_MONTH)
    same_month = Window.partitionBy("codigo_municipio", F.month("periodo"))
    anomalies = {name: F.col(value) - F.avg(value).over(same_month) for name, value in _ANOMALIES.items()}
    return merged.withColumns(anomalies).select(*ZONE_MONTH, *SPC_COLUMNS)


def ndvi_monthly(clean: DataFrame) -> DataFrame:
    """Monthly vegetation index and its anomaly per zone."""
    return clean.groupBy("codigo_municipio", F.trunc("fecha", "month").alias("periodo")).agg(
        F.avg("ndvi").alias("ndvi_media_30d"), F.avg("ndvi_anomalia").alias("ndvi_anomalia_30d")
    )
