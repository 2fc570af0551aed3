"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrovane.scale import materialize
from agrovane.session import configure

# A word is a run of characters other than blank, tab, newline, vertical tab, form feed and carriage return.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Rows and bytes of the batches that go to Python; a batch of very long texts stays small.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: Seconds until the JVM knows what Python has let go, and between its two collections.
RELEASED_S = (1.2, 0.3)


def prepare(spark: SparkSession) -> SparkSession:
    """Session options that the operators are written for."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return configure(spark)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array, without a Python step; NULL text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are one of ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_go(spark: SparkSession) -> None:
    """Asks both garbage collectors to run, so that Spark removes the shuffle files of steps whose result is stored.

    What Python lets go is let go in the JVM by a thread that looks once a second, so the JVM is asked only after that; what a
    finished step holds is found free by its second collection, not by the first.
    """
    gc.collect()
    for pause in RELEASED_S:
        time.sleep(pause)
        spark.sparkContext._jvm.System.gc()


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, ``_doc``, so that none of them clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` next to the whole row."""
    return docs.select(*columns, whole_row(docs))


def in_files(docs: DataFrame) -> DataFrame:
    """``docs`` if Spark reads it from files, else what it gives when it is written to the shared folder once."""
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018  the missing column shows here
    except pyspark.errors.AnalysisException:
        return materialize(docs, "rows")
    return docs


def with_row_key(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` (see :func:`in_files`) plus ``fid`` and ``rix``, a key of each row that is the same in every scan.

    Document ids may be NULL or repeated, so they can't tell rows apart; file and row number do.
    """
    kept = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    place = F.xxhash64(F.col("_metadata.file_path")).alias("fid"), F.col("_metadata.row_index").alias("rix")
    return docs.select(*kept, *place)
