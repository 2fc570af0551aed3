"""Isolation forest over Spark: per-tree samples and trees are built in parallel, rows are scored where they are.

Follows the published algorithm (Liu, Ting and Zhou 2008). Splits are drawn uniformly between the sample extremes of a
column, so the forest does not depend on the scale of a column and no standardisation pass is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.functions.quantiles import exact_quantile_by
from agrovane.scale import small_side
from agrovane.sources.schemas import FEATURE_COLUMNS, KEY

# Fixed values.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
MIN_ROWS_PER_CROP = 30
SEED = 42
GLOBAL = "*"
EPSILON = 1e-9
ROWS_PER_CHUNK = 100_000

NODE_SCHEMA = "modelo string, tree int, node int, feature int, threshold double, lo int, hi int, path double, norm double"


def average_path(n: int) -> float:
    """Expected depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One tree as ``(feature, threshold, lo, hi, path)`` rows; ``feature`` is -1 at a leaf."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[tuple] = [()]
    open_nodes = [(0, points, 0)]
    while open_nodes:
        index, rows, depth = open_nodes.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[index] = (-1, 0.0, -1, -1, depth + average_path(len(rows)))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_low = rows[:, feature] <= threshold
        lo, hi = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[index] = (feature, threshold, lo, hi, 0.0)
        open_nodes += [(lo, rows[goes_low], depth + 1), (hi, rows[~goes_low], depth + 1)]
    return nodes


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*KEY, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def _training_rows(rows: DataFrame, scope: str) -> DataFrame:
    """Rows with ``modelo`` and the model's row count ``_n``. Crops that are too small train the global model on all rows."""
    if scope == "global":
        return rows.withColumns({"modelo": F.lit(GLOBAL), "_n": F.lit(rows.count())})
    per_crop = rows.groupBy("cultivo").agg(F.count(F.lit(1)).alias("_n"))
    own = rows.join(small_side(per_crop.filter(F.col("_n") >= MIN_ROWS_PER_CROP)), "cultivo").withColumn(
        "modelo", F.col("cultivo")
    )
    if per_crop.filter(F.col("_n") < MIN_ROWS_PER_CROP).limit(1).count() == 0:
        return own
    return own.unionByName(_training_rows(rows, "global"))


def _samples(rows: DataFrame, columns: list[str], scope: str, trees: int, sample: int, seed: int) -> DataFrame:
    """The rows of each tree: ``modelo``, ``tree``, ``_rn`` (from 1) and the columns, keys included."""
    wanted = 2 * sample + 64
    training = _training_rows(rows, scope)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY), 11)
    members = training.withColumn("_u", unit).withColumn("_keep", F.lit(float(wanted)) / F.col("_n") * float(2**53))
    hashed = "shiftrightunsigned(xxhash64(_u, t), 11)"
    # Most rows are in no tree of a large table, so structs are made only for the trees that are left.
    trees_of_row = (
        f"transform(filter(sequence(0, {trees - 1}), t -> {hashed} < _keep), t -> struct(t AS tree, {hashed} AS h))"
    )
    drawn = members.select("modelo", *KEY, *columns, F.expr(f"inline({trees_of_row})"))
    order = Window.partitionBy("modelo", "tree").orderBy("h", *KEY, *columns)
    return drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)


def fit_forest(
    df: DataFrame,
    columns: list[str] | None = None,
    scope: str = "global",
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """Node table of the forest (or of one forest per crop).

    Each tree samples the rows with the smallest hash of (row, tree) among all rows of its model, at every size: the
    same seed gives the same forest on any cluster. A threshold on that hash keeps about twice the wanted rows on the
    map side before they are ranked, so a tree never sees more than a few hundred candidates.
    ``scope="group"`` trains a crop with at least 30 rows on its own rows; ``global`` trains on all rows.
    """
    columns = columns or FEATURE_COLUMNS
    sampled = _samples(_filled(df, columns), columns, scope, trees, sample, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_rn")
        model, tree = group["modelo"].iloc[0], int(group["tree"].iloc[0])
        nodes = _grow(group[columns].to_numpy(dtype=float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "lo", "hi", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        out.insert(0, "modelo", model)
        out["norm"] = average_path(len(group))
        return out

    return sampled.select("modelo", "tree", "_rn", *columns).groupBy("modelo", "tree").applyInPandas(grow, NODE_SCHEMA)


class _Forest:
    """Node arrays of one forest, padded per tree, for vectorised descent."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree", sort=True).size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        base = np.repeat(self.roots, sizes)
        self.feature = nodes["feature"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy()
        self.lo = nodes["lo"].to_numpy() + base
        self.hi = nodes["hi"].to_numpy() + base
        self.path = nodes["path"].to_numpy()
        self.norm = nodes["norm"].to_numpy()[self.roots].mean()

    def score(self, points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        for root in self.roots:
            at = np.full(len(points), root)
            active = rows[self.feature[at] >= 0]
            while len(active):
                here = at[active]
                low = points[active, self.feature[here]] <= self.threshold[here]
                at[active] = np.where(low, self.lo[here], self.hi[here])
                active = active[self.feature[at[active]] >= 0]
            total += self.path[at]
        return -np.power(2.0, -(total / len(self.roots)) / self.norm)


def raw_scores(df: DataFrame, nodes: DataFrame, columns: list[str] | None = None, scope: str = "global") -> DataFrame:
    """Adds ``raw`` (greater is more normal) and ``modelo``.

    The global forest has at most ``trees * 2 * sample`` nodes and travels with the tasks. Forests per crop are joined
    to row chunks of bounded size, so a crop with most of the rows is spread over many tasks.
    """
    columns = columns or FEATURE_COLUMNS
    rows = _filled(df, columns)
    if scope == "global":
        forest = _Forest(nodes.filter(F.col("modelo") == GLOBAL).toPandas())
        shared = df.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in parts:
                yield pd.Series(shared.value.score(np.column_stack([s.to_numpy(dtype=float) for s in series])))

        return rows.withColumn("raw", score(*columns)).withColumn("modelo", F.lit(GLOBAL)).select(*KEY, "modelo", "raw")

    per_crop = rows.groupBy("cultivo").agg(F.count(F.lit(1)).alias("_n"))
    assigned = rows.join(small_side(per_crop), "cultivo").withColumn(
        "modelo", F.when(F.col("_n") >= MIN_ROWS_PER_CROP, F.col("cultivo")).otherwise(GLOBAL)
    )
    per_model = assigned.groupBy("modelo").agg(
        F.ceil(F.count(F.lit(1)) / ROWS_PER_CHUNK).cast("int").alias("chunks")
    )
    chunked = assigned.join(small_side(per_model), "modelo").withColumn(
        "chunk", F.pmod(F.xxhash64(*KEY), F.col("chunks")).cast("int")
    )
    copies = nodes.join(small_side(per_model), "modelo").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )

    def score_chunk(points: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if points.empty:
            return pd.DataFrame(columns=[*KEY, "modelo", "raw"])
        out = points[[*KEY, "modelo"]].copy()
        out["raw"] = _Forest(forest).score(points[columns].to_numpy(dtype=float))
        return out

    return (
        chunked.select("modelo", "chunk", *KEY, *columns)
        .groupBy("modelo", "chunk")
        .cogroup(copies.drop("chunks").groupBy("modelo", "chunk"))
        .applyInPandas(score_chunk, "codigo_municipio string, cultivo string, periodo date, modelo string, raw double")
    )


def rescale(raw: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """``anomaly_score`` (1 is the most unusual row of the crop) and ``is_anomaly`` from raw scores.

    A row is flagged below the ``contamination`` quantile of the scores of its model. Extremes per crop and the
    quantile per model are aggregates joined back, not windows.
    """
    extremes = raw.groupBy("cultivo").agg(F.min("raw").alias("_min"), F.max("raw").alias("_max"))
    cut = exact_quantile_by(raw, ["modelo"], "raw", contamination).select("modelo", F.col("value").alias("_cut"))
    scaled = 1 - (F.col("raw") - F.col("_min")) / (F.col("_max") - F.col("_min") + EPSILON)
    return (
        raw.join(small_side(extremes), "cultivo")
        .join(small_side(cut), "modelo")
        .select(*KEY, scaled.alias("anomaly_score"), (F.col("raw") < F.col("_cut")).alias("is_anomaly"))
    )
