"""Layered Parquet tables, serving snapshots and run status."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrovane.operators.assembly import latest_run_status

# The five tables a serving snapshot must hold.
SERVING_TABLES = [
    "ira_resultados",
    "estaciones_municipio",
    "municipios_geom",
    "features_deforestacion",
    "features_ndvi",
]

RUNS_SCHEMA = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("detail", T.StringType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)


class Lakehouse:
    """Named tables under one root folder on any Hadoop file system.

    A table version is an immutable folder; a small pointer file names the current one. Publishing writes the new
    folder completely and then the pointer, so a reader never sees a half-written table and an update may read the
    table it replaces.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _read_pointer(self, path: str) -> str | None:
        fs, target = self._fs(path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _write_pointer(self, path: str, value: str) -> None:
        """Write to a side file, then rename over the old pointer in one step."""
        _, target = self._fs(path)
        _, side = self._fs(f"{path}.{uuid.uuid4().hex}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        fs, _ = self._fs(path)
        stream = fs.create(side, True)
        stream.writeUTF(value)
        stream.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(side), fs.makeQualified(target), options)

    def exists(self, name: str) -> bool:
        return self._read_pointer(f"{self.root}/{name}/_current") is not None

    def read(self, name: str) -> DataFrame:
        version = self._read_pointer(f"{self.root}/{name}/_current")
        if version is None:
            raise ValueError(f"table {name!r} does not exist under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Create or replace a table; returns the row count, taken from the written files."""
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        df.write.partitionBy(*(partition_by or [])).parquet(path)
        rows = self.spark.read.parquet(path).count()
        self._write_pointer(f"{self.root}/{name}/_current", version)
        return rows

    def materialize(self, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """Build and write a table unless it exists already (or ``force``); returns the stored table."""
        if force or not self.exists(name):
            self.write(name, build())
        return self.read(name)

    def run_step(self, name: str, build: Callable[[], DataFrame], force: bool = False) -> bool:
        """Materialise one step and append its outcome to ``pipeline_runs``; a failure is recorded, not raised."""
        started = time.monotonic()
        rows, ok, detail = None, True, ""
        try:
            rows = self.materialize(name, build, force).count()
        except Exception as error:  # noqa: BLE001 - the outcome is the result of this call
            ok, detail = False, str(error)
        record = (name, ok, rows, time.monotonic() - started, detail, dt.datetime.now())
        self.spark.createDataFrame([record], RUNS_SCHEMA).write.mode("append").parquet(f"{self.root}/pipeline_runs")
        return ok

    def status(self) -> DataFrame:
        """Latest outcome per step."""
        runs = self.spark.read.schema(RUNS_SCHEMA).parquet(f"{self.root}/pipeline_runs")
        return latest_run_status(runs)

    def export_snapshot(self, target: str, tables: list[str] | None = None) -> str:
        """Copy the serving tables into a new snapshot and switch ``<target>/_current`` to it.

        Fails before anything becomes visible if a table is missing.
        """
        tables = tables or SERVING_TABLES
        missing = [t for t in tables if not self.exists(t)]
        if missing:
            raise RuntimeError(f"missing tables: {missing}")
        snapshot = f"s-{uuid.uuid4().hex}"
        manifest = {}
        for table in tables:
            manifest[table] = f"{target}/{snapshot}/{table}"
            self.read(table).write.parquet(manifest[table])
        self._write_pointer(f"{target}/_current", json.dumps(manifest))
        return snapshot

    def _manifest(self, target: str) -> dict[str, str]:
        current = self._read_pointer(f"{target}/_current")
        if current is None:
            raise RuntimeError(f"no snapshot under {target}")
        return json.loads(current)

    def refresh_snapshot(self, target: str, table: str, df: DataFrame) -> str:
        """Publish a snapshot with one table rebuilt; the others are carried over by path, not copied."""
        manifest = self._manifest(target)
        snapshot = f"s-{uuid.uuid4().hex}"
        path = f"{target}/{snapshot}/{table}"
        df.write.parquet(path)
        self._write_pointer(f"{target}/_current", json.dumps({**manifest, table: path}))
        return snapshot

    def read_snapshot(self, target: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self._manifest(target)[table])
