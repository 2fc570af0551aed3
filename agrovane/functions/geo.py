"""Planar point-in-polygon predicates over plain arrays (EPSG:4326 degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(rings: Column) -> Column:
    """All edges of all rings as ``array<struct<x1, y1, x2, y2>>``; an unclosed ring is closed."""

    def edges_of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.struct(
                a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, edges_of))


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray test to the right; a point on an edge is outside."""

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        reach = e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return F.when(straddles, x < reach).otherwise(F.lit(False))

    def touches(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (turn == 0)
            & (x >= F.least(e["x1"], e["x2"]))
            & (x <= F.greatest(e["x1"], e["x2"]))
            & (y >= F.least(e["y1"], e["y2"]))
            & (y <= F.greatest(e["y1"], e["y2"]))
        )

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)
