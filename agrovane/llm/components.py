"""Connected components of a link table by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.scale import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task replaced by stars: each node with the least node that the task's links lead to.

    Works in blocks of bounded size, so a large task gives several forests; the rounds that follow join them.
    """
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        parent.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield stars()
    yield stars()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every node hangs below one node that hangs below none."""
    above = edges.select(F.col("u").alias("x"), F.lit(1).cast("long").alias("up"), F.lit(0).alias("root"))
    below = edges.select(F.col("v").alias("x"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("root"))
    ends = above.unionByName(below).groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return ends.where("up + root != 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``links`` (u, v: binary).

    Star contraction: large stars hang each node's greater neighbours below its least one, small stars do so with the
    lesser ones; edges never grow in number, and the rounds grow with the logarithm of the size. Nothing reaches the driver
    but a yes or no per round.
    """
    edges = materialize(links.select("u", "v").mapInArrow(_forest, "u binary, v binary").distinct(), "edges")
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
