"""Typed clean tables from landed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrovane.functions.numeric import lenient_number, strict_number
from agrovane.functions.text import composite_zone_code, zfill, zone_code
from agrovane.sources.landing import resolve_column


def clean_production(raw: DataFrame) -> DataFrame:
    """Crop production: trimmed texts, padded zone key, strict numbers."""
    return raw.select(
        F.col("c_d_dep").alias("codigo_departamento"),
        "departamento",
        zone_code(F.col("c_d_mun")).alias("codigo_municipio"),
        "municipio",
        F.lower(F.trim("cultivo")).alias("cultivo"),
        F.trim("grupo_de_cultivo").alias("grupo_cultivo"),
        F.trim("subgrupo_de_cultivo").alias("subgrupo_cultivo"),
        F.trim("desagregaci_n_regional_y").alias("desagregacion"),
        "a_o",
        "periodo",
        strict_number(F.col("rea_sembrada_ha")).alias("area_sembrada"),
        strict_number(F.col("rea_cosechada_ha")).alias("area_cosechada"),
        strict_number(F.col("producci_n_t")).alias("produccion"),
        strict_number(F.col("rendimiento_t_ha")).alias("rendimiento"),
        F.trim("estado_fisico_produccion").alias("estado_fisico"),
        F.trim("nombre_cientifico").alias("nombre_cientifico"),
        F.trim("ciclo_de_cultivo").alias("ciclo"),
    )


def clean_ndvi(raw: DataFrame) -> DataFrame:
    """Vegetation index of second-level units with a value."""
    return raw.filter((F.col("adm_level") == 2) & F.col("vim").isNotNull()).select(
        F.lpad(F.replace("PCODE", F.lit("CO"), F.lit("")), 5, "0").alias("codigo_municipio"),
        F.col("date").cast("date").alias("fecha"),
        F.col("vim").cast("double").alias("ndvi"),
        F.col("vim_avg").cast("double").alias("ndvi_avg"),
        F.col("viq").cast("double").alias("ndvi_anomalia"),
    )


def clean_passthrough(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The table as landed, in the declared column order and types; an absent optional column becomes NULL."""
    present = set(raw.columns)
    return raw.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def poverty_by_zone(raw: DataFrame) -> DataFrame:
    """Poverty sheet to ``(codigo_municipio, nbi_total)``; rows without a full code are dropped."""
    return raw.select(
        composite_zone_code(F.col("cod_depto"), F.col("cod_mun")).alias("codigo_municipio"),
        lenient_number(F.col("nbi_total")).alias("nbi_total"),
    ).filter(F.col("codigo_municipio").isNotNull())


# Accepted source names of the socio-economic columns, in order of preference.
SOCIO_CANDIDATES = {
    "codigo_municipio": ["cod_dane", "codigo_dane", "codigodane", "divipola", "codigo_municipio", "c_digo_dane"],
    "nombre_municipio": ["municipio", "nombre_municipio", "nom_municipio", "municipio_1"],
    "departamento": ["departamento", "depto", "nombre_departamento"],
    "nbi_total": ["nbi_total", "nbi", "porcentaje_nbi", "pct_nbi", "total"],
    "poblacion_rural": ["poblacion_resto", "pob_resto", "resto", "rural", "poblacion_rural"],
    "poblacion_total": ["total_personas", "poblacion_total", "total", "pob_total"],
}


def socioeconomic(raw: DataFrame) -> DataFrame:
    """Socio-economic table with standard names, upper-case labels, lenient numbers and the rural share.

    A column that the source lacks is left out, like the share when one of its parts is missing.
    """
    shape = {
        "codigo_municipio": lambda c: zfill(F.trim(c.cast("string")), 5),
        "nombre_municipio": lambda c: F.upper(F.trim(c.cast("string"))),
        "departamento": lambda c: F.upper(F.trim(c.cast("string"))),
    }
    selected = []
    for target, candidates in SOCIO_CANDIDATES.items():
        source = resolve_column(raw, candidates, required=False)
        if source is not None:
            selected.append(shape.get(target, lenient_number)(F.col(f"`{source}`")).alias(target))
    out = raw.select(*selected)
    if {"poblacion_rural", "poblacion_total"} <= set(out.columns):
        share = F.col("poblacion_rural") / F.nullif("poblacion_total", F.lit(0.0)) * 100
        out = out.withColumn("pct_rural", F.bround(share, 2))
    return out


def drop_footer(df: DataFrame, core: list[str]) -> DataFrame:
    """Drop rows whose core columns are all NULL."""
    return df.na.drop(how="all", subset=core)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which a required column is NULL."""
    return df.na.drop(how="any", subset=columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by ``order``.

    An aggregate, not a ranking window: the map side folds the copies of a hot key before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("row"))
    return kept.select(*[(F.col(c) if c in keys else F.col("row")[c]).alias(c) for c in df.columns])


def landing_profile(df: DataFrame, source: str, column: str = "fechaobservacion") -> DataFrame:
    """Row count and observation span of a landed source; unreadable dates are ignored."""
    day = F.col(column).cast("string").try_cast("timestamp").cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("filas"), F.min(day).alias("desde"), F.max(day).alias("hasta")
    ).select(F.lit(source).alias("fuente"), "filas", "desde", "hasta")
