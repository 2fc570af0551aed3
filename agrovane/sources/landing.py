"""Readers for landed files: Parquet, CSV, JSON records and GeoJSON layers."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrovane.sources.schemas import RAW_TABLES

POINT = T.ArrayType(T.DoubleType())
RING = T.ArrayType(POINT)


def read_raw(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Landed Parquet table ``<root>/<name>.parquet``; a missing source is an empty frame with the full schema."""
    schema = schema or RAW_TABLES[name]
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, landed as text and cast leniently, so no inference pass is needed."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.option("header", True).schema(text).csv(path)
    return raw.select(
        *[F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """List of JSON objects as rows. ``multi_line=False`` reads JSON lines, which Spark can split."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def since(df: DataFrame, column: str, as_of: dt.date, years: int = 5) -> DataFrame:
    """Rows observed on or after ``as_of`` minus ``365 * years`` days.

    The cutoff is a literal, so it reaches the Parquet scan as a pushed filter.
    """
    cutoff = as_of - dt.timedelta(days=365 * years)
    return df.filter(F.col(column) >= F.lit(cutoff))


def newest(df: DataFrame, column: str, rows: int, tie_break: list[str] | None = None) -> DataFrame:
    """The newest ``rows`` observations (a top-k report; ties broken by ``tie_break``)."""
    keys = [F.col(column).desc_nulls_last(), *[F.col(c) for c in tie_break or []]]
    return df.orderBy(*keys).limit(rows)


def resolve_column(df: DataFrame, candidates: list[str], mode: str = "exact", required: bool = True) -> str | None:
    """Name of the first column that matches a candidate, ignoring case and outer blanks.

    ``exact`` tries the candidates in order; ``contains`` takes the first column that contains one of them.
    """
    lowered = [(c.lower().strip(), c) for c in df.columns]
    if mode == "exact":
        names = dict(reversed(lowered))
        hits = [names[c.lower()] for c in candidates if c.lower() in names]
    else:
        hits = [real for low, real in lowered if any(c.lower() in low for c in candidates)]
    if hits:
        return hits[0]
    if required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return None


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Rename known source names to standard ones and keep only those; two sources of one target are an error."""
    targets: dict[str, str] = {}
    for column in df.columns:
        target = synonyms.get(column.lower().strip())
        if target is None:
            continue
        if target in targets:
            raise ValueError(f"both {targets[target]!r} and {column!r} map to {target!r}")
        targets[target] = column
    if not targets:
        raise ValueError(f"no known column among {df.columns}")
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in targets.items()])


# Column names of the polygon layer and their standard names.
ZONE_SYNONYMS = {
    "mpio_cdpmp": "codigo_municipio",
    "mpio_ccnct": "codigo_municipio",
    "mpio_cnmbr": "nombre_municipio",
    "dpto_ccdgo": "codigo_departamento",
    "dpto_cnmbr": "nombre_departamento",
    "codigo_municipio": "codigo_municipio",
    "nombre_municipio": "nombre_municipio",
    "codigo_departamento": "codigo_departamento",
    "nombre_departamento": "nombre_departamento",
}


def geometry_rings(geometry: Column) -> Column:
    """All rings of a GeoJSON (Multi)Polygon text, as ``array<array<array<double>>>`` of ``[x, y]`` points.

    Holes need no marking: the even-odd test treats every ring alike.
    """
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    polygon = F.from_json(coordinates, T.ArrayType(RING))
    multi = F.flatten(F.from_json(coordinates, T.ArrayType(T.ArrayType(RING))))
    return F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)


def read_geojson_zones(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON polygon layer as one row per zone: codes, names, geometry text and rings.

    Expects one feature per line (GeoJSON sequence) or a FeatureCollection document. Geometry stays text until it is
    parsed, because the nesting depth of the coordinates depends on the geometry type.
    """
    schema = T.StructType(
        [
            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
            T.StructField("geometry", T.StringType()),
        ]
    )
    collection = T.StructType([T.StructField("features", T.ArrayType(schema))])
    lines = spark.read.text(path, wholetext=False)
    is_line = F.get_json_object("value", "$.type") == "Feature"
    if lines.filter(is_line).limit(1).count():
        features = lines.filter(is_line).select(F.from_json("value", schema).alias("f"))
    else:
        whole = spark.read.text(path, wholetext=True)
        features = whole.select(F.explode(F.from_json("value", collection)["features"]).alias("f"))
    return zones_from_features(features.select("f.properties", "f.geometry"))


def zones_from_features(features: DataFrame) -> DataFrame:
    """Standardise ``(properties map, geometry text)`` rows into the zone layer."""
    lowered = F.transform_keys("properties", lambda k, v: F.lower(F.trim(k)))
    standard = {}
    for source, target in ZONE_SYNONYMS.items():
        standard.setdefault(target, []).append(lowered[source])
    return features.select(
        *[F.coalesce(*columns).alias(target) for target, columns in standard.items()],
        F.col("geometry").alias("geom"),
    ).withColumn("rings", geometry_rings(F.col("geom")))
