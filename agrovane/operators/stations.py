"""Stations: coordinates, zone assignment and enrichment of observations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.functions.geo import ring_edges, strictly_inside
from agrovane.functions.numeric import lenient_number
from agrovane.functions.text import station_key
from agrovane.operators.clean import first_per_key
from agrovane.scale import fits_broadcast, small_side
from agrovane.sources.landing import resolve_column


def station_points(raw: DataFrame) -> DataFrame:
    """Station catalogue with columns found by substring; rows without readable coordinates are dropped."""
    latitude = resolve_column(raw, ["latit"], mode="contains")
    longitude = resolve_column(raw, ["longit"], mode="contains")
    code = resolve_column(raw, ["codigo"], mode="contains")
    return raw.select(
        F.col(f"`{code}`").cast("string").alias("codigoestacion"),
        lenient_number(F.col(f"`{latitude}`")).alias("latitud"),
        lenient_number(F.col(f"`{longitude}`")).alias("longitud"),
    ).na.drop(subset=["latitud", "longitud"])


def zone_cells(zones: DataFrame, cell: float) -> DataFrame:
    """Grid cells that the bounding box of each zone touches, each with only the edges its points can meet.

    A ray to the right from a point of the cell can cross an edge only if the edge overlaps the cell's rows and is not
    left of the cell; the other edges need not travel with the cell.
    """
    edges = zones.filter(F.size("rings") > 0).withColumn("edges", ring_edges(F.col("rings")))
    xs = F.transform("edges", lambda e: e["x1"])
    ys = F.transform("edges", lambda e: e["y1"])

    def span(values: Column) -> Column:
        return F.sequence(F.floor(F.array_min(values) / cell), F.floor(F.array_max(values) / cell))

    placed = (
        edges.select("codigo_municipio", "nombre_municipio", "codigo_departamento", "nombre_departamento", "edges",
                     span(xs).alias("xs"), span(ys).alias("ys"))
        .withColumn("cell_x", F.explode("xs"))
        .withColumn("cell_y", F.explode("ys"))
    )
    slack = cell * 1e-9  # the cell of a point is found by a rounded division
    near = F.filter(
        "edges",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("cell_y") * cell - slack)
        & (F.least(e["y1"], e["y2"]) <= (F.col("cell_y") + 1) * cell + slack)
        & (F.greatest(e["x1"], e["x2"]) >= F.col("cell_x") * cell - slack),
    )
    return placed.withColumn("edges", near).filter(F.size("edges") > 0).drop("xs", "ys")


def stations_to_zones(points: DataFrame, zones: DataFrame, cell: float = 0.25) -> DataFrame:
    """One zone per station that lies strictly inside it; a station outside every zone keeps NULLs.

    An equi-join on grid cells with the exact test as residual condition. A cell that holds most of the stations is
    split by the skew join when the zone side does not fit a broadcast. Zones that overlap: the least code wins.
    """
    cells = small_side(zone_cells(zones, cell))
    placed = points.withColumn("cell_x", F.floor(F.col("longitud") / cell)).withColumn(
        "cell_y", F.floor(F.col("latitud") / cell)
    )
    inside = strictly_inside(F.col("longitud"), F.col("latitud"), F.col("edges"))
    joined = placed.join(
        cells,
        (placed["cell_x"] == cells["cell_x"]) & (placed["cell_y"] == cells["cell_y"]) & inside,
        "left",
    ).select(
        "codigoestacion", "latitud", "longitud",
        "codigo_municipio", "nombre_municipio", "codigo_departamento", "nombre_departamento",
    )
    return first_per_key(joined, ["codigoestacion"], ["codigo_municipio", "latitud", "longitud"])


def attach_zone(observations: DataFrame, stations: DataFrame) -> DataFrame:
    """Observations with their zone; rows without date, value or zone are dropped."""
    known = stations.filter(F.col("codigo_municipio").isNotNull()).select(
        station_key(stations).alias("estacion"), "codigo_municipio", "nombre_municipio"
    )
    return (
        observations.filter(F.col("fechaobservacion").isNotNull() & F.col("valorobservado").isNotNull())
        .withColumn("estacion", station_key(observations))
        .join(small_side(known), "estacion")
        .drop("estacion")
    )


@dataclass(frozen=True)
class Partial:
    """A decomposable aggregate: computed on readings, then merged over partial rows."""

    name: str
    compute: Callable[[Column], Column]
    merge: Callable[[Column], Column]


SUM = Partial("suma", F.sum, F.sum)
COUNT = Partial("lecturas", F.count, F.sum)
MIN = Partial("minimo", F.min, F.min)


def aggregate_by_zone(
    observations: DataFrame, stations: DataFrame, keys: dict[str, Column], partials: list[Partial]
) -> DataFrame:
    """Partial aggregates per zone and ``keys`` over all stations of the zone.

    With a broadcast station table the readings are aggregated on the map side right after the lookup: one shuffle of
    zone-period rows. Otherwise they are first folded per station and keys, so that neither the join nor a station
    that sends most of the readings moves raw rows.
    """
    value = F.col("valorobservado").cast("double")
    known = stations.filter(F.col("codigo_municipio").isNotNull()).select(
        station_key(stations).alias("estacion"), "codigo_municipio"
    )
    readings = observations.filter(F.col("fechaobservacion").isNotNull() & value.isNotNull()).select(
        station_key(observations).alias("estacion"),
        *[column.alias(name) for name, column in keys.items()],
        value.alias("valor"),
    )
    computed = [p.compute(F.col("valor")).alias(p.name) for p in partials]
    if fits_broadcast(stations):
        joined = readings.join(F.broadcast(known), "estacion")
        return joined.groupBy("codigo_municipio", *keys).agg(*computed)
    folded = readings.groupBy("estacion", *keys).agg(*computed)
    merged = [p.merge(F.col(p.name)).alias(p.name) for p in partials]
    return folded.join(known, "estacion").groupBy("codigo_municipio", *keys).agg(*merged)
