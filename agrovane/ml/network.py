"""Feed-forward yield regression trained data-parallel.

Each round every share (a block of at most ``SHARE_ROWS`` rows) takes one pass of mini-batch Adam over its own rows from
the common state; the states are averaged by row count in Spark. Rows stay distributed; the driver holds only the
parameter vector, whose size depends on the layer widths. A round is one job over the NumPy blocks, which are stored once and held by the executors between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.ml.supervised import Standardizer, sized_for_training
from agrovane.scale import materialize
from agrovane.sources.schemas import KEY, PREDICTOR_COLUMNS

# Fixed values.
HIDDEN = (64, 32)
MAX_ROUNDS = 500
VALIDATION = 0.1
PATIENCE = 20
SEED = 42
Z95 = 1.96
# Defaults of the published Adam method and of the usual mini-batch set-up.
RATE, BETA1, BETA2, TINY = 1e-3, 0.9, 0.999, 1e-8
WEIGHT_DECAY = 1e-4
BATCH = 200
TOLERANCE = 1e-4
SHARE_ROWS = 10_000
FLAT_SUM = 64  # states of up to so many partitions are added in one step, more in a tree
SHARE_SCHEMA = "n int, x binary, y binary, held binary"


def _shapes(inputs: int) -> list[tuple[int, int]]:
    widths = [inputs, *HIDDEN, 1]
    return list(zip(widths[:-1], widths[1:], strict=True))


def _unpack(flat: np.ndarray, inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, cols in _shapes(inputs):
        weights = flat[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        layers.append((weights, flat[at : at + cols]))
        at += cols
    return layers


def _forward(flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Activations of all layers; the last is the prediction column."""
    out = [x]
    layers = _unpack(flat, x.shape[1])
    for i, (weights, bias) in enumerate(layers):
        z = out[-1] @ weights + bias
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def _gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    acts = _forward(flat, x)
    layers = _unpack(flat, x.shape[1])
    delta = (acts[-1][:, 0] - y)[:, None] / len(y)
    pieces: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        weights, _ = layers[i]
        pieces = [(acts[i].T @ delta + WEIGHT_DECAY / len(y) * weights).ravel(), delta.sum(axis=0), *pieces]
        if i:
            delta = (delta @ weights.T) * (acts[i] > 0)
    return np.concatenate(pieces)


def _initial(inputs: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for rows, cols in _shapes(inputs):
        bound = np.sqrt(6.0 / (rows + cols))
        parts += [rng.uniform(-bound, bound, rows * cols), rng.uniform(-bound, bound, cols)]
    return np.concatenate(parts)


def _shares(rows: DataFrame) -> DataFrame:
    """The rows as NumPy blocks: a share is a partition's rows, cut where they are more than ``SHARE_ROWS``."""
    columns = PREDICTOR_COLUMNS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def share() -> pa.RecordBatch:
            pdf = pa.Table.from_batches(waiting).to_pandas()
            values = [pdf[columns].to_numpy(dtype=float).tobytes(), pdf["target"].to_numpy(dtype=float).tobytes(), pdf["held"].to_numpy(dtype=bool).tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(pdf)], pa.int32()), *[pa.array([v], pa.binary()) for v in values]],
                names=["n", "x", "y", "held"],
            )

        for batch in batches:
            while len(batch):
                taken = batch.slice(0, SHARE_ROWS - sum(map(len, waiting)))
                waiting.append(taken)
                batch = batch.slice(len(taken))
                if sum(map(len, waiting)) == SHARE_ROWS:
                    yield share()
                    waiting = []
        if waiting:
            yield share()

    return rows.select(*columns, "target", "held").mapInArrow(pack, SHARE_SCHEMA)


def _unpacked(row, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"]).reshape(-1, inputs), np.frombuffer(row["y"]), np.frombuffer(row["held"], bool)


def _pass(share: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, steps: int, seed: int) -> tuple:
    """One local pass from ``state`` and the validation error of ``state`` itself: (state x rows, rows, steps, held rows,
    squared error, sum and sum of squares of their target)."""
    x_all, y_all, check = share
    size = len(state) // 3
    weights, first, second = (state[i * size : (i + 1) * size].copy() for i in range(3))
    step, rng = steps, np.random.default_rng([seed, steps])
    y = y_all[check]
    miss = _forward(state[:size], x_all[check])[-1][:, 0] - y
    measured = len(y), float(miss @ miss), float(y.sum()), float(y @ y)
    x, y = x_all[~check], y_all[~check]
    order = rng.permutation(len(y))
    for start in range(0, len(y), BATCH):
        pick = order[start : start + BATCH]
        grad = _gradient(weights, x[pick], y[pick])
        step += 1
        first = BETA1 * first + (1 - BETA1) * grad
        second = BETA2 * second + (1 - BETA2) * grad * grad
        scale = RATE * np.sqrt(1 - BETA2**step) / (1 - BETA1**step)
        weights = weights - scale * first / (np.sqrt(second) + TINY)
    return (np.concatenate([weights, first, second]) * len(y), len(y), step - steps, *measured)


def _added(a: tuple, b: tuple) -> tuple:
    """Two passes together; the rounds' step count follows the longest pass."""
    return (a[0] + b[0], a[1] + b[1], max(a[2], b[2]), *(p + q for p, q in zip(a[3:], b[3:], strict=True)))


def _trained(shares: DataFrame, weights: np.ndarray, max_rounds: int, patience: int, seed: int) -> tuple:
    """(weights, rounds, validation R²): rounds until the held-out R² has not improved for ``patience`` of them.

    The arrays of the stored shares are kept by the executors between rounds (on disk where memory is short); a lost one is
    read again from the stored table.
    """
    inputs = len(PREDICTOR_COLUMNS)
    rdd = shares.rdd.map(lambda row: _unpacked(row, inputs)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rounds(rdd, weights, max_rounds, patience, seed)
    finally:
        rdd.unpersist()


def _rounds(rdd: RDD, weights: np.ndarray, max_rounds: int, patience: int, seed: int) -> tuple:
    size = len(weights)
    depth = 1 if rdd.getNumPartitions() <= FLAT_SUM else 2
    state, steps = np.concatenate([weights, np.zeros(2 * size)]), 0
    best, best_weights, stale, done = None, weights, 0, 0
    for done in range(1, max_rounds + 1):
        passed = rdd.map(lambda share, state=state, steps=steps: _pass(share, state, steps, seed))
        vector, n, took, held, sse, total, squares = passed.treeReduce(_added, depth)
        if held:
            spread = squares - total**2 / held
            score = 1 - sse / spread if spread > 0 else -sse
            improved = best is None or score > best + TOLERANCE
            stale = 0 if improved else stale + 1
            if best is None or score > best:
                best, best_weights = score, state[:size].copy()
            if stale > patience:
                break
        if n:
            state, steps = vector / n, steps + took
        if not held:
            best_weights = state[:size].copy()
    return best_weights, done, best


@dataclass(frozen=True)
class YieldNetwork:
    """Fitted network with its input standardisation."""

    scaler: Standardizer
    weights: np.ndarray
    rounds: int
    validation_r2: float | None

    @classmethod
    def fit(cls, supervised: DataFrame, max_rounds: int = MAX_ROUNDS, patience: int = PATIENCE, seed: int = SEED) -> YieldNetwork:
        """Trains until the held-out R² has not improved for ``patience`` rounds.

        Held-out rows are chosen by key hash. The standardised rows are stored once and re-read every round.
        """
        scaler = Standardizer.fit(supervised, PREDICTOR_COLUMNS)
        held = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(10_000)) < VALIDATION * 10_000
        scaled = scaler.transform(supervised).withColumn("held", held)
        shares = materialize(_shares(sized_for_training(scaled, scaled.count())), "network-shares")
        weights, rounds, score = _initial(len(PREDICTOR_COLUMNS), seed), 0, None
        if shares.take(1):
            weights, rounds, score = _trained(shares, weights, max_rounds, patience, seed)
        return cls(scaler, weights, rounds, score)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``."""
        weights = self.weights
        columns = PREDICTOR_COLUMNS

        @F.pandas_udf("double")
        def forward(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in parts:
                x = np.column_stack([s.to_numpy(dtype=float) for s in series])
                yield pd.Series(_forward(weights, x)[-1][:, 0])

        scaled = [(F.col(c) - F.lit(self.scaler.moments[c][0])) / F.lit(self.scaler.moments[c][1]) for c in columns]
        return df.withColumn("prediction", forward(*scaled))

    def save(self, spark, path: str) -> None:
        rows = [(c, m, s) for c, (m, s) in self.scaler.moments.items()]
        spark.createDataFrame(
            [(self.weights.tolist(), rows, self.rounds, self.validation_r2)],
            "weights array<double>, moments array<struct<c:string,m:double,s:double>>, rounds int, r2 double",
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> YieldNetwork:
        row = spark.read.parquet(path).first()
        moments = {r["c"]: (r["m"], r["s"]) for r in row["moments"]}
        return cls(Standardizer(moments), np.asarray(row["weights"]), row["rounds"], row["r2"])


def network_interval(predicted: DataFrame) -> DataFrame:
    """Rounded prediction and ±1.96 population deviations of all predictions (one scalar aggregate)."""
    deviation = predicted.agg(F.stddev_pop("prediction")).first()[0] or 0.0
    margin = F.lit(deviation * Z95)
    return predicted.select(
        *KEY,
        F.bround("prediction", 3).alias("rendimiento_nnet"),
        F.bround(F.col("prediction") - margin, 3).alias("nnet_ic_inf"),
        F.bround(F.col("prediction") + margin, 3).alias("nnet_ic_sup"),
    )


def predict(supervised: DataFrame, network: YieldNetwork) -> DataFrame:
    """Predictions with interval; scored once and stored, as the deviation of all of them comes first."""
    return network_interval(materialize(network.transform(supervised).select(*KEY, "prediction"), "network-scores"))
