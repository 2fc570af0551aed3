"""Size-checked broadcasts and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

_probed: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def fits_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """True when a bounded probe proves that ``df`` is small enough to broadcast.

    The probe reads at most ``max_rows + 1`` rows and sums the length of their JSON text, which is an upper estimate
    of the in-memory width for the column types used here. A frame is probed once.
    """
    key = (max_rows, max_bytes)
    seen = _probed.setdefault(df, {})
    if key not in seen:
        width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        rows, size = (
            df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
        )
        seen[key] = rows <= max_rows and size <= max_bytes
    return seen[key]


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it passed the size probe, else unchanged (shuffle join, AQE skew splitting)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one on a local master only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="agrovane-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several jobs need the same frame (quantile passes, iterative fits). Unlike a cache it survives executor
    loss, and the readers still get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
