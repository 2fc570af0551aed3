"""Incremental landing, daily totals and refresh of dependent months with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrovane.functions.text import station_key
from agrovane.scale import materialize, small_side

WATERMARK = "1 day"


def observation_stream(spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet", **options) -> DataFrame:
    """Stream over files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).format(file_format).load(folder)


def deduplicated(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """One row per station and time. State older than the watermark is dropped, so it does not grow with history.

    The event time must be a TIMESTAMP; a time-zone-free one is cast.
    """
    return (
        stream.withColumn("fechaobservacion", F.col("fechaobservacion").cast("timestamp"))
        .withWatermark("fechaobservacion", delay)
        .dropDuplicatesWithinWatermark(["codigoestacion", "fechaobservacion"])
    )


def daily_totals(stream: DataFrame, stations: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Daily total per zone. Appended, a day is written once it is older than the watermark; upserted, with every batch.

    Over the same rows the days equal the batch result.
    """
    known = stations.filter(F.col("codigo_municipio").isNotNull()).select(
        station_key(stations).alias("estacion"), "codigo_municipio"
    )
    return (
        stream.filter(F.col("fechaobservacion").isNotNull() & F.col("valorobservado").isNotNull())
        .withColumn("fechaobservacion", F.col("fechaobservacion").cast("timestamp"))
        .withWatermark("fechaobservacion", delay)
        .withColumn("estacion", station_key(stream))
        .join(small_side(known), "estacion")
        .groupBy(F.window("fechaobservacion", "1 day").alias("w"), "codigo_municipio")
        .agg(F.sum("valorobservado").alias("precip_dia"))
        .select("codigo_municipio", F.col("w.start").cast("date").alias("fecha"), "precip_dia")
    )


def append_available(stream: DataFrame, target: str, checkpoint: str, partition_by: list[str] | None = None) -> DataFrame:
    """Append everything that has arrived to a Parquet table, exactly once, and return the table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*(partition_by or []))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def upsert_available(stream: DataFrame, target: str, checkpoint: str, keys: list[str], partition: str) -> DataFrame:
    """Merge the latest rows of an aggregated stream into a Parquet table by key, open groups included.

    Only the partitions that a batch touches are read and replaced, from a stored copy, so a batch that runs again after a
    failure gives the same table.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = materialize(batch, "upserts")
        if number > 0 and new.isEmpty():
            return
        merged = new
        if number > 0:
            old = spark.read.schema(batch.schema).parquet(target)
            old = old.join(small_side(new.select(partition).distinct()), partition, "left_semi")
            merged = materialize(new.unionByName(old.join(new.select(*keys), keys, "left_anti")), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(target)

    query = (
        stream.writeStream.foreachBatch(merge)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def refresh_months(
    spark: SparkSession,
    landed: str,
    schema: T.StructType,
    build: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> DataFrame:
    """Recompute the calendar months that new rows touch, in every year, from all landed rows of those months.

    ``build`` maps observations to a table with a ``periodo`` column. A feature may be measured against the same month of all
    years, so a new January row changes every January; no other month depends on it. Only the partitions of
    these months are replaced, so a batch that runs again after a failure gives the same table.
    """
    calendar_month = F.month(F.col("fechaobservacion").cast("date"))

    def refresh(batch: DataFrame, _: int) -> None:
        # At most twelve values, so they can be literals of the scan's filter.
        touched = [r["m"] for r in batch.select(calendar_month.alias("m")).distinct().collect() if r["m"] is not None]
        rows = batch.sparkSession.read.schema(schema).parquet(landed).where(calendar_month.isin(touched))
        build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("periodo").parquet(target)

    query = (
        spark.readStream.schema(schema)
        .parquet(landed)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
