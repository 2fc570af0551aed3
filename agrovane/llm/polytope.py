"""Approximate nearest neighbours by inner product with cross-polytope hashing, multiprobe tables and exact reranking.

Inner product search is turned into angular search: a data vector x becomes (x / M, sqrt(1 - |x|^2 / M^2)) with M the
largest norm of its dimension, a query q becomes (q / |q|, 0); the cosine of the two is q.x / (M |q|), so the order of
inner products is the order of angles. Each of ``TABLES`` hash tables pads vectors to a power of two D and applies a
pseudo-rotation, three rounds of random signs and a fast Hadamard transform; the bucket is the nearest signed axis (2D
buckets). Data rows go to one bucket per table; every query probes the ``PROBES`` signed axes with the largest
magnitudes in each table. Candidates are all data rows of the probed buckets; every candidate is scored exactly.

Buckets never meet in one unbounded group: a bucket is split into ``ceil(rows / MEMBERS)`` parts by hash of the row, and
the queries that probe it into ``ceil(probes / QUERIES)`` parts; each part of one side meets every part of the other, so
a group holds at most ``MEMBERS`` rows and ``QUERIES`` queries, whatever the skew. A group keeps its best ``K`` per
query; the best ``K`` over all groups of a query are the answer. Scores are inner products in double precision, summed
in component order over the original vectors.

Nothing is fitted: the rotations are drawn from ``SEED`` and the table number, the same in every task; M is an
aggregate over all rows. Measured recall of the top 20 against brute force: 0.96 on sf0.1, 0.98 on check_s (README).

Defined cases: vectors that are NULL, empty, all zero, or hold a NULL, NaN or infinite component take no part, neither
as query nor as candidate; vectors of different lengths only meet their own length; rows with equal ids are one
candidate with the best score of their vectors (and one query), and a query never meets a row with its own id; ties are broken to the smaller
vec_id; a query with fewer than ``K`` candidates returns all of them; an empty table gives an empty result; columns
other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrovane.scale import small_side

TABLES = 12
PROBES = 14
K = 20
QUERY_EVERY = 20
MEMBERS = 2048  # data rows of one group
QUERIES = 512  # queries of one group
SEED = 1009
PRESELECT = 8  # extra rows a group keeps per query before the exact, ordered sum decides

_BUCKETS = "vec_id long, dim int, vec array<double>, table int, bucket int"


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, vec as doubles) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists(vec, lambda v: v != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & nonzero).select("vec_id", F.size("vec").alias("dim"), "vec")


def _padded(dim: int) -> int:
    return 1 << int(np.ceil(np.log2(dim + 1)))


def _hadamard(y: np.ndarray) -> np.ndarray:
    h, n = 1, y.shape[1]
    while h < n:
        y = y.reshape(len(y), -1, 2, h)
        a, b = y[:, :, 0, :].copy(), y[:, :, 1, :]
        y = np.concatenate([(a + b)[:, :, None, :], (a - b)[:, :, None, :]], axis=2).reshape(len(y), n)
        h *= 2
    return y / np.sqrt(n)


def rotate(vectors: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of the rows of ``vectors`` (already padded to a power of two) for one table."""
    rng = np.random.default_rng([seed, table, vectors.shape[1]])
    y = vectors
    for _ in range(3):
        y = _hadamard(y * rng.choice([-1.0, 1.0], vectors.shape[1]))
    return y


def signed_axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """Bucket ids (2 * axis + sign) of the ``probes`` signed axes nearest to each row, nearest first."""
    order = np.argsort(-np.abs(rotated), axis=1, kind="stable")[:, :probes]
    negative = np.take_along_axis(rotated, order, 1) < 0
    return order * 2 + negative


def _hasher(role: str, tables: int, probes: int, seed: int):
    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for dim, part in pdf.groupby("dim", sort=False):
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(x, axis=1)
                extra = np.zeros(len(x)) if role == "query" else np.sqrt(np.maximum(0.0, 1.0 - (norms / part["scale"].to_numpy()) ** 2))
                unit = x / (norms if role == "query" else part["scale"].to_numpy())[:, None]
                padded = np.zeros((len(x), _padded(int(dim))))
                padded[:, : int(dim)] = unit
                padded[:, int(dim)] = extra
                for table in range(tables):
                    axes = signed_axes(rotate(padded, table, seed), 1 if role == "data" else probes)
                    yield pd.DataFrame(
                        {
                            "vec_id": np.repeat(part["vec_id"].to_numpy(), axes.shape[1]),
                            "dim": np.int32(dim),
                            "vec": np.repeat(part["vec"].to_numpy(), axes.shape[1]),
                            "table": np.int32(table),
                            "bucket": axes.reshape(-1).astype(np.int32),
                        }
                    )

    return run


def _best_of_group(k: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if members.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = np.stack(members["vec"].to_numpy())
        ids = members["vec_id"].to_numpy()
        out = []
        for start in range(0, len(queries), 128):
            chunk = queries.iloc[start : start + 128]
            q = np.stack(chunk["vec"].to_numpy())
            qids = chunk["vec_id"].to_numpy()
            rough = q @ x.T
            rough[qids[:, None] == ids[None, :]] = -np.inf
            keep = min(k + PRESELECT, len(ids))
            top = np.argpartition(-rough, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
            for row in range(len(q)):
                cols = top[row][np.isfinite(rough[row, top[row]])]
                if len(cols) == 0:
                    continue
                # Component order, one addition at a time: the same sum wherever the pair is scored.
                exact = np.cumsum(x[cols] * q[row][None, :], axis=1)[:, -1]
                order = np.lexsort((ids[cols], -exact))[:k]
                out.append(pd.DataFrame({"query_id": qids[row], "vec_id": ids[cols][order], "score": exact[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(
    data: DataFrame,
    queries: DataFrame,
    k: int = K,
    tables: int = TABLES,
    probes: int = PROBES,
    members: int = MEMBERS,
    per_group: int = QUERIES,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ``k`` best candidates of every query row; both inputs are :func:`valid`."""
    scale = data.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v * v))).alias("scale"))
    data_rows = data.join(small_side(scale), "dim").mapInPandas(_hasher("data", tables, probes, seed), _BUCKETS)
    probe_rows = queries.withColumn("scale", F.lit(1.0)).mapInPandas(_hasher("query", tables, probes, seed), _BUCKETS)

    key = ["dim", "table", "bucket"]
    sizes = (
        data_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"))
        .join(probe_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_q")), key)
        .select(*key, F.ceil(F.col("_m") / members).cast("int").alias("_ms"), F.ceil(F.col("_q") / per_group).cast("int").alias("_qs"))
    )
    sizes = small_side(sizes)
    sides = F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)).alias("_qpart")
    data_rows = data_rows.join(sizes, key).select(
        "vec_id", "vec", *key, F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("_ms")).cast("int").alias("_mpart"), sides
    )
    probe_rows = probe_rows.join(sizes, key).select(
        "vec_id", "vec", *key, F.explode(F.sequence(F.lit(0), F.col("_ms") - 1)).alias("_mpart"),
        F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.col("_qs")).cast("int").alias("_qpart"),
    )
    group = [*key, "_mpart", "_qpart"]
    found = (
        data_rows.groupBy(*group)
        .cogroup(probe_rows.groupBy(*group))
        .applyInPandas(_best_of_group(k), "query_id long, vec_id long, score double")
    )
    # A pair found in several tables is one candidate.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12(embeddings: DataFrame) -> DataFrame:
    """Registered query: the 20 nearest rows of every row whose vec_id is divisible by 20, among all rows."""
    rows = valid(embeddings)
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
