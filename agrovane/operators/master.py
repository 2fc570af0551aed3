"""Master feature table: one row per zone, crop and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.sources.schemas import KEY, SEP_COLUMNS, SPC_COLUMNS, SVE_COLUMNS


def phenological_flag() -> F.Column:
    """1 in the sowing and the harvest month, else 0; unknown months count as 0."""
    month = F.month("periodo")
    hit = (month == F.col("mes_siembra")) | (month == F.col("mes_cosecha"))
    return F.when(hit, 1).otherwise(0)


def master_features(
    climate: DataFrame, production: DataFrame, prices: DataFrame, socio: DataFrame | None = None
) -> DataFrame:
    """Climate by production (every month meets every crop of the zone), plus prices by month and zone attributes.

    Prices and zone attributes are joined first, while there is one row per zone and month; the fan-out over crops is
    last, so nothing after it moves the wide rows again. No side is hinted: AQE broadcasts one whose shuffled size is
    small and splits a hot zone otherwise.
    """
    joined = climate.filter(F.col("codigo_municipio").isNotNull()).join(
        prices.withColumn("periodo", F.trunc("periodo", "month")), "periodo", "left"
    )
    if socio is None:
        joined = joined.withColumns({c: F.lit(None).cast("double") for c in SVE_COLUMNS[3:]})
    else:
        joined = joined.join(socio, "codigo_municipio", "left")
    joined = joined.join(production.filter(F.col("cultivo").isNotNull()), "codigo_municipio")
    joined = joined.withColumn("fase_fenologica", phenological_flag())
    return joined.select(*KEY, *SPC_COLUMNS, *SEP_COLUMNS, *SVE_COLUMNS)
