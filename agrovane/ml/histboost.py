"""Gradient-boosted regression trees for every crop in one learner, on binned features.

MLlib fits one model per crop, each a series of Spark jobs, so the jobs grow with the crop list. Here every row carries
the model it trains (its crop when the crop has at least ``MIN_ROWS_PER_CROP`` rows; the global model ``*`` trains on
all rows when some crop has fewer) and all models grow together:

- features are binned once, against quantile edges of all rows (``BINS`` per feature), and the rows are stored as blocks
  of at most ``BLOCK_ROWS`` rows (bins, target, model), a few models per partition;
- a model of at most ``BLOCK_ROWS`` rows is one block: one job grows all trees of all such models, each in the task that
  holds its block, with the same histograms and thresholds as below;
- of the larger models, per tree level one job: every task sums residuals and counts of its sampled rows by (model, node, feature, bin) with
  NumPy, Spark adds the histograms of a node (features x bins, never rows) by key, and the reducing task takes the node's
  best threshold from cumulative sums; only the chosen splits (at most models x nodes) reach the driver;
- tasks route their rows and add up predictions themselves from the trees grown since the blocks were last stored, so a
  level rewrites no rows; every ``STORE_EVERY`` trees the blocks are stored again with their predictions, which cuts the
  lineage;
- leaf values come from the sums of the last level's splits. At the end the trees are sent to the binned rows once, for
  one prediction per row.

So a fit takes one job for all models of one block and, if there are larger ones, ``trees * depth`` small jobs whatever
their number; no task ever meets more than a block of a model's rows at once.
Squared loss, shrinkage ``STEP``, depth ``DEPTH``, a hash-drawn ``SAMPLE`` of the rows per tree; all features are
offered at every node. Importances are each feature's share of the summed gain of its model. Ties of gain go to the
smaller feature index, then the smaller bin.

Defined cases: NULL predictors are 0 (as in the supervised set); an empty table gives empty results; a model whose
rows all have one target grows no split (its prediction is the mean); repeated rows are rows like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrovane.ml.supervised import ROWS_PER_TASK
from agrovane.ml.trees import boosted_interval
from agrovane.scale import materialize, small_side
from agrovane.sources.schemas import KEY, PREDICTOR_COLUMNS

TREES = 200
DEPTH = 6
STEP = 0.05
SAMPLE = 0.8
BINS = 32
MIN_ROWS_PER_CROP = 50
SEED = 42
GLOBAL = "*"
STORE_EVERY = 20  # trees between two stored copies of the blocks; a task replays at most this many on its rows
BLOCK_ROWS = 8_192  # rows of a block, so a block's histograms stay below BLOCK_ROWS x features x bins numbers
NODES_AT_ONCE = 64  # nodes whose thresholds are searched in one step
MIN_GAIN = 1e-12
TIE = 1e-9  # share of a gain that is rounding
SPLIT_SCHEMA = "tree int, modelo string, node long, feature int, bin int, gain double"
BLOCK_SCHEMA = "n int, bins binary, mi binary, rid binary, target binary, pred binary"


@dataclass
class Boosted:
    """Fitted models: per row predictions, splits and leaves per tree, and importances."""

    predictions: DataFrame  # KEY, modelo, prediction
    splits: DataFrame  # tree, modelo, node, feature, bin, gain
    edges: list[list[float]]

    def importances(self, columns: list[str] | None = None) -> DataFrame:
        """(modelo, var, importance): each feature's share of its model's summed gain."""
        columns = columns or PREDICTOR_COLUMNS
        names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("feature") + 1)
        every = self.predictions.select("modelo").distinct().select("modelo", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("feature"))
        gains = self.splits.groupBy("modelo", "feature").agg(F.sum("gain").alias("g"))
        gains = every.join(gains, ["modelo", "feature"], "left").fillna(0.0, ["g"])
        total = gains.groupBy("modelo").agg(F.sum("g").alias("t"))
        share = F.when(F.col("t") > 0, F.col("g") / F.col("t")).otherwise(F.lit(0.0))
        return gains.join(total, "modelo").select("modelo", names.alias("var"), share.alias("importance"))


def _bins(edges: list[list[float]], columns: list[str]) -> Column:
    """Bin of every feature: the number of its edges below the value."""

    def below(column: str):
        return lambda edge: edge < F.col(column)

    return F.array(
        *[F.size(F.filter(F.array(*[F.lit(float(e)) for e in col_edges]).cast("array<double>"), below(c))) for c, col_edges in zip(columns, edges, strict=True)]
    ).alias("bins")


def quantile_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct inner quantiles of every column (at most ``bins - 1`` per column, computed in one pass)."""
    probs = [k / bins for k in range(1, bins)]
    found = rows.approxQuantile(columns, probs, 1.0 / (4 * bins)) if rows.take(1) else [[] for _ in columns]
    return [sorted(set(col)) for col in found]


def _model_of(counts: dict, minimum: int) -> tuple[Column, bool]:
    own = sorted(c for c, n in counts.items() if c is not None and n >= minimum)
    needs_global = any(n < minimum or c is None for c, n in counts.items())
    models = []
    if own:
        models.append(F.when(F.col("cultivo").isin(own), F.col("cultivo")))
    if needs_global:
        models.append(F.lit(GLOBAL))
    return F.array_compact(F.array(*models)) if models else F.array().cast("array<string>"), needs_global


def fit(
    supervised: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    step: float = STEP,
    sample: float = SAMPLE,
    bins: int = BINS,
    minimum: int = MIN_ROWS_PER_CROP,
    columns: list[str] | None = None,
) -> Boosted:
    """Boost all models of ``supervised`` (KEY, predictors, target) together."""
    columns = columns or PREDICTOR_COLUMNS
    spark = supervised.sparkSession
    counts = {r["cultivo"]: r["n"] for r in supervised.groupBy("cultivo").agg(F.count(F.lit(1)).alias("n")).collect()}
    edges = quantile_edges(supervised, columns, bins)
    models, needs_global = _model_of(counts, minimum)
    names = sorted(c for c, n in counts.items() if c is not None and n >= minimum) + ([GLOBAL] if needs_global else [])
    rows = supervised.select(*KEY, _bins(edges, columns), F.col("target").cast("double").alias("target"), F.explode(models).alias("modelo"))
    model_index = (F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("modelo")) - 1).cast("int")
    rows = rows.withColumn("rid", F.xxhash64(*KEY, "modelo")).withColumn("mi", model_index)
    base = rows.groupBy("modelo").agg(F.avg("target").alias("pred"))
    rows = materialize(rows.join(small_side(base), "modelo"), "boost-rows")

    shape = (len(names), len(columns), max((len(e) for e in edges), default=0) + 1)
    sizes = {n: counts[n] if n != GLOBAL else sum(counts.values()) for n in names}
    small = [m for m, n in enumerate(names) if sizes[n] <= BLOCK_ROWS]
    forest = [_Tree.empty(shape[0], depth) for _ in range(trees if names else 0)]
    if small and forest:
        _grow_whole(rows.where(F.col("mi").isin(small)), len(small), forest, shape, depth, step, sample)
    if len(small) < len(names):
        large = [m for m in range(len(names)) if m not in small]
        _grow_shared(rows.where(F.col("mi").isin(large)), large, forest, shape, depth, step, sample)
    found = [(tree, names[m], node, f, b, gain) for tree, grown in enumerate(forest) for m, node, f, b, gain in grown.found]
    splits = spark.createDataFrame(pd.DataFrame(found, columns=["tree", "modelo", "node", "feature", "bin", "gain"]), SPLIT_SCHEMA) if found else spark.createDataFrame([], SPLIT_SCHEMA)
    return Boosted(_predicted(rows, forest, shape), splits, edges)


@dataclass
class _Tree:
    """One tree of every model: per level the split feature (-1: none) and bin of each (model, node) slot, then the leaves."""

    features: list[np.ndarray]
    bins: list[np.ndarray]
    leaves: np.ndarray
    found: list[tuple]  # (model, node, feature, bin, gain)

    @classmethod
    def empty(cls, models: int, depth: int) -> _Tree:
        """A tree of ``depth`` levels without a split, of value 0."""
        widths = [models << level for level in range(depth)]
        return cls([np.full(w, -1, np.int16) for w in widths], [np.zeros(w, np.int16) for w in widths], np.zeros(models << depth), [])

    def place(self, other: _Tree, models: dict[int, int]) -> None:
        """Take trees of ``other``; ``models`` says which model of this tree each of them is. Other models stay as they are.

        Levels that ``other`` lacks have no splits: its leaves then stand at the left end below their nodes.
        """
        own = len(self.features[0]) if self.features else len(self.leaves)
        lacking = len(self.features) - len(other.features)
        for k, m in models.items():
            for level, (feature, threshold) in enumerate(zip(other.features, other.bins, strict=True)):
                mine, theirs = slice(m << level, (m + 1) << level), slice(k << level, (k + 1) << level)
                self.features[level][mine], self.bins[level][mine] = feature[theirs], threshold[theirs]
            have = len(other.features)
            self.leaves.reshape(own, -1)[m, :: 1 << lacking] = other.leaves[k << have : (k + 1) << have]
        self.found += [(models[m], *rest) for m, *rest in other.found]

    def slots(self, bins: np.ndarray, model: np.ndarray) -> np.ndarray:
        """The slot ``model * 2^level + position`` of every row below the levels grown so far; no split sends rows left."""
        slot = model.astype(np.int64)
        at = np.arange(len(slot))
        for feature, threshold in zip(self.features, self.bins, strict=True):
            f = feature[slot]
            slot = 2 * slot + ((f >= 0) & (bins[at, f] > threshold[slot]))
        return slot

    def values(self, bins: np.ndarray, model: np.ndarray) -> np.ndarray:
        return self.leaves[self.slots(bins, model)]


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows as NumPy blocks. Partitions follow the models, so that a task has histograms of few of them."""
    parts = max(1, -(-rows.count() // ROWS_PER_TASK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            bins = pa.concat_arrays([c.flatten() for c in table["bins"].chunks]).to_numpy().astype(np.int16)
            kinds = {"mi": np.int32, "rid": np.int64, "target": np.float64, "pred": np.float64}
            columns = [bins, *[table[c].to_numpy().astype(kind) for c, kind in kinds.items()]]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(table)], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
                names=["n", "bins", *kinds],
            )

        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                waiting.append(batch.slice(start, BLOCK_ROWS))
                table = pa.Table.from_batches(waiting)
                if len(table) >= BLOCK_ROWS:
                    yield block(table.slice(0, BLOCK_ROWS))
                    waiting = table.slice(BLOCK_ROWS).to_batches()
        if sum(map(len, waiting)):
            yield block(pa.Table.from_batches(waiting))

    placed = rows.repartitionByRange(parts, "mi", "rid").select("bins", "mi", "rid", "target", "pred")
    return placed.mapInArrow(pack, BLOCK_SCHEMA)


def _unpacked(row, features: int) -> tuple[np.ndarray, ...]:
    """(bins, model, rid, target, prediction) of a block."""
    return (
        np.frombuffer(row["bins"], np.int16).reshape(-1, features),
        np.frombuffer(row["mi"], np.int32),
        np.frombuffer(row["rid"], np.int64),
        np.frombuffer(row["target"]),
        np.frombuffer(row["pred"]),
    )


def _drawn(rid: np.ndarray, tree: int, sample: float) -> np.ndarray:
    """Rows of the tree's sample: Spark's ``pmod(xxhash64(rid, tree, SEED), 1000000)`` below the share."""
    return _xxhash64(rid, tree, SEED) % 1_000_000 < int(sample * 1_000_000)


def _xxhash64(value: np.ndarray, *more: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column followed by int constants."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    start = np.full(len(value), 42, np.uint64) + p5 + np.uint64(8)
    h = mixed(turned(start ^ (turned(value.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
    for number in more:
        word = np.full(1, number & 0xFFFFFFFF, np.uint64) * p1
        h = mixed(turned((h + p5 + np.uint64(4)) ^ word, 23) * p2 + p3)
    return h.view(np.int64)


def _grow_whole(rows: DataFrame, models: int, forest: list[_Tree], shape: tuple, depth: int, step: float, sample: float) -> None:
    """Grow every tree of the models that are one block each, in one job, into ``forest``."""
    _, features, bins = shape
    trees, alone = len(forest), (1, features, bins)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        x = table["bins"].combine_chunks().flatten().to_numpy().reshape(-1, features).astype(np.int16)
        rid, target, pred = (table[c].to_numpy() for c in ("rid", "target", "pred"))
        model, out = np.zeros(len(x), np.int32), []
        for tree in range(trees):
            keep = _drawn(rid, tree, sample)
            drawn, residual, none = x[keep], (target - pred)[keep], model[keep]
            grown = _Tree([], [], np.zeros(0), [])
            for _ in range(depth):
                grown = _deeper(grown, list(_best(_summed(drawn, none, residual, grown, alone))), 1, step)
                if (grown.features[-1] < 0).all():
                    break
            pred = pred + grown.values(x, model)
            out.append(grown)
        return pa.table({"mi": pa.array([key[0].as_py()], pa.int32()), "trees": pa.array([pickle.dumps(out)], pa.binary())})

    # One partition a model, if the range bounds fall well; they are never coalesced.
    placed = rows.select("mi", "bins", "rid", "target", "pred").repartitionByRange(models, "mi")
    for row in placed.groupBy("mi").applyInArrow(grow, "mi int, trees binary").collect():
        for tree, grown in zip(forest, pickle.loads(row["trees"]), strict=True):
            tree.place(grown, {0: row["mi"]})


def _grow_shared(rows: DataFrame, models: list[int], forest: list[_Tree], shape: tuple, depth: int, step: float, sample: float) -> None:
    """Grow every tree of the models of many blocks into ``forest``: a job per level, the blocks stored now and then."""
    blocks, fresh = materialize(_blocks(rows), "boost-blocks"), []
    for tree, whole in enumerate(forest):
        grown = _grow(blocks, fresh, tree, shape, depth, step, sample)
        fresh.append(grown)
        whole.place(grown, {m: m for m in models})
        if len(fresh) == STORE_EVERY and tree + 1 < len(forest):
            blocks, fresh = materialize(_stepped(blocks, fresh, shape), "boost-blocks"), []


def _grow(blocks: DataFrame, earlier: list[_Tree], tree: int, shape: tuple, depth: int, step: float, sample: float) -> _Tree:
    """One tree of every model: a job per level. ``earlier`` are the trees that the stored predictions lack."""
    rdd = blocks.rdd
    parts = max(1, min(rdd.getNumPartitions(), blocks.sparkSession.sparkContext.defaultParallelism))
    grown = _Tree([], [], np.zeros(0), [])
    for _ in range(depth):
        sums = rdd.flatMap(lambda row, so_far=grown: _histograms(row, earlier, so_far, tree, shape, sample))
        grown = _deeper(grown, sums.reduceByKey(np.add, parts).mapPartitions(_best).collect(), shape[0], step)
        if (grown.features[-1] < 0).all():
            break  # no model splits any further; every row of a node goes left, to the node's own mean
    return grown


def _deeper(grown: _Tree, nodes: list[tuple], models: int, step: float) -> _Tree:
    """The tree with one more level, split as ``nodes`` (from ``_best``) say; a node without a gain sends its rows left."""
    level = len(grown.features)
    width = 1 << level
    feature, threshold = np.full(models * width, -1, np.int16), np.zeros(models * width, np.int16)
    leaves, found = np.zeros(2 * models * width), []
    for slot, gain, f, b, sl, nl, st, nt in nodes:
        if gain > MIN_GAIN:
            feature[slot], threshold[slot] = f, b
            found.append((slot >> level, width + slot % width, f, b, gain))
            leaves[2 * slot], leaves[2 * slot + 1] = step * sl / nl, step * (st - sl) / (nt - nl)
        else:
            leaves[2 * slot] = step * st / nt
    return _Tree([*grown.features, feature], [*grown.bins, threshold], leaves, grown.found + found)


def _histograms(row, earlier: list[_Tree], grown: _Tree, tree: int, shape: tuple, sample: float) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, [sum of residuals, rows] x feature x bin) of every slot that a block has sampled rows of."""
    x, model, rid, target, pred = _unpacked(row, shape[1])
    keep = _drawn(rid, tree, sample)
    x, model, residual = x[keep], model[keep], target[keep] - _advanced(pred[keep], earlier, x[keep], model[keep])
    return _summed(x, model, residual, grown, shape)


def _summed(x: np.ndarray, model: np.ndarray, residual: np.ndarray, grown: _Tree, shape: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, [sum of residuals, rows] x feature x bin) of every slot that has rows."""
    _, features, bins = shape
    present, local = np.unique(grown.slots(x, model), return_inverse=True)
    cells = ((local[:, None] * features + np.arange(features)) * bins + x).ravel()
    size = len(present) * features * bins
    sums = np.bincount(cells, np.repeat(residual, features), size).reshape(-1, features, bins)
    counts = np.bincount(cells, minlength=size).reshape(-1, features, bins)
    for k, slot in enumerate(present):
        yield int(slot), np.stack([sums[k], counts[k]])


def _best(nodes: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple]:
    """The best threshold of every node: (slot, gain, feature, bin, sum and rows of the left side, of the node).

    Ties of gain go to the smaller feature, then the smaller bin; a threshold that leaves a side empty has gain -inf.
    """
    while some := list(islice(nodes, NODES_AT_ONCE)):
        slots, sums = zip(*some, strict=True)
        left_sum, left_n = np.stack(sums, axis=1).cumsum(axis=3)
        sum_all, n_all = left_sum[..., -1:], left_n[..., -1:]
        right_sum, right_n = sum_all - left_sum, n_all - left_n
        gain = left_sum * left_sum / np.maximum(left_n, 1) + right_sum * right_sum / np.maximum(right_n, 1) - sum_all * sum_all / n_all
        gain = np.where((left_n > 0) & (right_n > 0), gain, -np.inf).reshape(len(some), -1)
        most = gain.max(axis=1)
        # Sums arrive in any order: gains that differ by rounding only are a tie.
        at = np.where(most > 0, (gain >= (most - TIE * abs(most))[:, None]).argmax(axis=1), 0)
        bins, node = left_sum.shape[2], np.arange(len(some))
        f, b = at // bins, at % bins
        sides = left_sum[node, f, b], left_n[node, f, b], sum_all[node, f, 0], n_all[node, f, 0]
        columns = (gain[node, at], f, b, *sides)
        yield from zip(slots, *(c.tolist() for c in columns), strict=True)


def _advanced(pred: np.ndarray, grown: list[_Tree], bins: np.ndarray, model: np.ndarray) -> np.ndarray:
    for tree in grown:
        pred = pred + tree.values(bins, model)
    return pred


def _stepped(blocks: DataFrame, grown: list[_Tree], shape: tuple) -> DataFrame:
    """The blocks with the predictions of ``grown`` added."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, model, _, _, pred = _unpacked(row, shape[1])
                row["pred"] = _advanced(pred, grown, bins, model).tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=batch.schema)

    return blocks.mapInArrow(step, BLOCK_SCHEMA)


def _predicted(rows: DataFrame, forest: list[_Tree], shape: tuple) -> DataFrame:
    """KEY, modelo, prediction of every row; the trees (models x nodes numbers each) travel with the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def prediction(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for bins, model, pred in parts:
            x = np.stack(bins.to_numpy()).astype(np.int16) if len(bins) else np.zeros((0, shape[1]), np.int16)
            yield pd.Series(_advanced(pred.to_numpy(dtype=float), shared.value, x, model.to_numpy()))

    return materialize(rows.select(*KEY, "modelo", prediction("bins", "mi", "pred").alias("prediction")), "boosted")


def served(boosted: Boosted) -> DataFrame:
    """One prediction per supervised row: its crop's model, else the global one."""
    preference = F.when(F.col("modelo") == GLOBAL, 1).otherwise(0)
    order = Window.partitionBy(*KEY).orderBy(preference)
    return boosted.predictions.withColumn("_o", F.row_number().over(order)).where("_o = 1").drop("_o")


def predict(boosted: Boosted, columns: list[str] | None = None) -> DataFrame:
    """Served yield columns: prediction, interval of 1.96 x 0.1 x the deviation of the crop's predictions, top drivers."""
    ranked = Window.partitionBy("modelo").orderBy(F.col("importance").desc(), "var")
    top = (
        boosted.importances(columns)
        .withColumn("_k", F.row_number().over(ranked))
        .where("_k <= 3")
        .groupBy("modelo")
        .agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_k", "var", F.bround("importance", 4).alias("importance")))),
                                   lambda x: F.struct(x["var"].alias("var"), x["importance"].alias("importance")))).alias("importancia_top3"))
    )
    scored = boosted_interval(served(boosted))
    return scored.join(small_side(top), "modelo", "left").select(
        *KEY, "rendimiento_predicho", "rendimiento_ic_inf", "rendimiento_ic_sup", F.coalesce("importancia_top3", F.lit("[]")).alias("importancia_top3")
    )
