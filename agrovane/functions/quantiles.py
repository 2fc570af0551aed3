"""Exact interpolated quantiles without collecting a column into one task.

``percentile`` keeps every distinct value of a group in the memory of one task. Here a small sketch first brackets each
wanted rank; the rows below a bracket are only counted and the few distinct values inside it are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.functions.numeric import double_literal

_SKETCH_ACCURACY = 10_000


def _brackets(df: DataFrame, columns: list[str], probabilities: list[float], half_width: float) -> dict:
    """``(column, p) -> (count, low, high)``; one aggregate row, so its size depends on the columns only."""
    wanted = [v for p in probabilities for v in (max(0.0, p - half_width), min(1.0, p + half_width))]
    array = ", ".join(double_literal(w) for w in wanted)
    row = df.selectExpr(
        *[f"count(`{c}`) AS `n_{c}`" for c in columns],
        *[
            f"percentile_approx(CAST(`{c}` AS DOUBLE), array({array}), {_SKETCH_ACCURACY}) AS `q_{c}`"
            for c in columns
        ],
    ).first()
    out = {}
    for c in columns:
        n, edges = row[f"n_{c}"], row[f"q_{c}"]
        if not n:
            continue
        for i, p in enumerate(probabilities):
            # Too few rows for the sketch error to matter: rank all values.
            open_ended = n * half_width < 4
            low = -math.inf if open_ended or p <= half_width else edges[2 * i]
            high = math.inf if open_ended or p >= 1 - half_width else edges[2 * i + 1]
            out[(c, p)] = (n, low, high)
    return out


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], half_width: float = 0.001
) -> DataFrame:
    """Rows ``(feature, p, value)``: linear-interpolated quantiles over the non-null values of each column.

    Reads ``df`` twice more than a plain aggregate, so pass a stored table. A column without values has no row.
    """
    brackets = _brackets(df, columns, probabilities, half_width)
    spark = df.sparkSession
    if not brackets:
        return spark.createDataFrame([], "feature string, p double, value double")
    below, inside = [], []
    for (c, p), (n, low, high) in brackets.items():
        value, key = f"CAST(`{c}` AS DOUBLE)", f"'{c}' AS feature, {double_literal(p)} AS p"
        below.append(f"struct({key}, {n}L AS n, count_if({value} < {double_literal(low)}) AS below)")
        inside.append(
            f"CASE WHEN {value} BETWEEN {double_literal(low)} AND {double_literal(high)} "
            f"THEN struct({key}, {value} AS value) END"
        )
    offsets = df.selectExpr(f"array({', '.join(below)}) AS b").select(F.inline("b"))
    values = (
        df.selectExpr(f"explode(array_compact(array({', '.join(inside)}))) AS v")
        .groupBy("v.feature", "v.p", "v.value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return _pick_ranks(values, offsets, ["feature", "p"])


def exact_quantile_by(df: DataFrame, by: list[str], column: str, p: float, half_width: float = 0.001) -> DataFrame:
    """Rows ``(*by, n, value)``: one exact quantile per group, safe for a group that holds most of the rows."""
    value = F.col(column).cast("double")
    lo_hi = [max(0.0, p - half_width), min(1.0, p + half_width)]
    sketch = (
        df.filter(value.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(value, F.array(*map(F.lit, lo_hi)), F.lit(_SKETCH_ACCURACY)).alias("q"),
        )
        .select(
            *by,
            "n",
            F.when((F.col("n") * half_width < 4) | F.lit(p <= half_width), F.lit(-math.inf))
            .otherwise(F.col("q")[0])
            .alias("low"),
            F.when((F.col("n") * half_width < 4) | F.lit(p >= 1 - half_width), F.lit(math.inf))
            .otherwise(F.col("q")[1])
            .alias("high"),
        )
    )
    placed = df.select(*by, value.alias("value")).join(sketch, by)
    # Rows under the bracket fold into one counted null per group before the shuffle.
    counted = (
        placed.filter(F.col("value") <= F.col("high"))
        .groupBy(*by, "n", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    offsets = counted.groupBy(*by, "n").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("times"))), F.lit(0)).alias("below")
    )
    values = counted.filter(F.col("value").isNotNull()).drop("n")
    return _pick_ranks(values, offsets.withColumn("p", F.lit(p)), by, keep=["n"])


def _pick_ranks(values: DataFrame, offsets: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Turn counted bracket values into interpolated quantiles."""
    running = (
        Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = values.withColumn("upto", F.sum("times").over(running)).join(offsets, keys)
    position = F.col("p") * (F.col("n") - 1)
    low_rank = F.floor(position)
    last = F.col("below") + F.col("upto")
    first = last - F.col("times")

    def at(rank):
        return F.max(F.when((rank >= first) & (rank < last), F.col("value")))

    high_rank = F.ceil(position)
    picked = ranked.groupBy(*keys, "n").agg(
        at(low_rank).alias("low"), at(high_rank).alias("high"), F.max(position - low_rank).alias("part")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    return picked.select(*keys, *(keep or []), value.alias("value"))
