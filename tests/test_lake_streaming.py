import datetime as dt

import pytest
from pyspark.sql import functions as F

from agrovane.operators import climate
from agrovane.scale import fits_broadcast, materialize, shared_folder, small_side
from agrovane.sources.lake import SERVING_TABLES, Lakehouse
from agrovane.sources.schemas import OBSERVATION
from agrovane.streaming import incremental


def test_tables_versions_and_force(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path))
    assert not lake.exists("t")
    with pytest.raises(ValueError):
        lake.read("t")
    assert lake.write("t", spark.range(3)) == 3
    # A table may be replaced from its own current version.
    assert lake.write("t", lake.read("t").union(spark.range(1))) == 4
    assert lake.materialize("t", lambda: spark.range(9)).count() == 4
    assert lake.materialize("t", lambda: spark.range(9), force=True).count() == 9


def test_status_keeps_failures(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path))
    assert lake.run_step("a", lambda: spark.range(2)) is True
    assert lake.run_step("b", lambda: spark.range(2).select("missing")) is False
    assert lake.run_step("b", lambda: spark.range(5)) is True
    got = {r["step"]: r for r in lake.status().collect()}
    assert got["a"]["rows"] == 2 and got["b"]["ok"] and got["b"]["rows"] == 5


def test_snapshot_is_complete_or_invisible(spark, tmp_path):
    lake = Lakehouse(spark, str(tmp_path / "lake"))
    target = str(tmp_path / "served")
    for name in SERVING_TABLES[:-1]:
        lake.write(name, spark.range(1))
    with pytest.raises(RuntimeError, match="features_ndvi"):
        lake.export_snapshot(target)
    with pytest.raises(RuntimeError):
        lake.read_snapshot(target, SERVING_TABLES[0])
    lake.write("features_ndvi", spark.range(4))
    lake.export_snapshot(target)
    held = lake.read_snapshot(target, "features_ndvi")
    lake.refresh_snapshot(target, "features_deforestacion", spark.range(7))
    assert lake.read_snapshot(target, "features_deforestacion").count() == 7
    assert lake.read_snapshot(target, "features_ndvi").count() == 4 == held.count()


def test_size_probe(spark):
    small, wide = spark.range(10), spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert fits_broadcast(small) and not fits_broadcast(small, max_rows=5) and not fits_broadcast(wide, max_bytes=5000)
    plan = spark.range(100).join(small_side(small), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_materialized_tables_live_in_the_shared_folder(spark):
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and shared_folder(spark).removeprefix("file:").lstrip("/") in df.inputFiles()[0]


def _files(spark, folder, batches):
    for i, batch in enumerate(batches):
        data = [(s, dt.datetime(2024, 1, d, h), v) for s, d, h, v in batch]
        spark.createDataFrame(data, OBSERVATION).coalesce(1).write.mode("append").parquet(folder)


BATCHES = [
    [("1", 1, 1, 2.0), ("1", 1, 1, 2.0), ("02", 1, 5, 3.0), ("9", 2, 1, 1.0)],
    [("1", 2, 2, 4.0), ("1", 3, 2, 5.0), ("2", 3, 3, 6.0)],
    [("1", 6, 0, 7.0), ("1", 6, 0, 7.0)],
]


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("1", "a"), ("2", "b")], "codigoestacion string, codigo_municipio string")


def test_landing_drops_repeats_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in BATCHES:
        _files(spark, source, [batch])
        stream = incremental.deduplicated(incremental.observation_stream(spark, source, OBSERVATION))
        landed = incremental.append_available(stream, target, str(tmp_path / "state"))
    assert landed.count() == 7


def test_stream_days_equal_batch_days_once_closed(spark, tmp_path, known, rows):
    source = str(tmp_path / "in")
    _files(spark, source, BATCHES)
    stream = incremental.observation_stream(spark, source, OBSERVATION)
    got = incremental.append_available(incremental.daily_totals(stream, known), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = climate.rain_daily(spark.read.schema(OBSERVATION).parquet(source), known)
    # The newest reading is at 2024-01-06 00:00, so days that end by the 5th are closed.
    assert rows(got) == rows(batch.filter(F.col("fecha") <= dt.date(2024, 1, 4)))


def test_refresh_recomputes_only_touched_months(spark, tmp_path, known, rows):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    build = lambda df: climate.wind_monthly(df, known)
    january = [("1", dt.datetime(2024, 1, 3), 2.0), ("2", dt.datetime(2024, 2, 3), 8.0)]
    spark.createDataFrame(january, OBSERVATION).write.parquet(source)
    incremental.refresh_months(spark, source, OBSERVATION, build, target, state)
    before = set((tmp_path / "out" / "periodo=2024-02-01").iterdir())
    spark.createDataFrame([("1", dt.datetime(2024, 1, 9), 4.0)], OBSERVATION).write.mode("append").parquet(source)
    out = incremental.refresh_months(spark, source, OBSERVATION, build, target, state)
    assert rows(out.select("codigo_municipio", "viento_media_30d")) == [("a", 3.0), ("b", 8.0)]
    assert set((tmp_path / "out" / "periodo=2024-02-01").iterdir()) == before


def test_refresh_keeps_baselines_over_all_years(spark, tmp_path, known, rows):
    """A feature measured against the same month of other years: a new January changes every January."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    build = lambda df: climate.tmax_monthly(df, known)
    past = [("1", dt.datetime(2023, 1, 3), 20.0), ("1", dt.datetime(2023, 2, 3), 8.0)]
    spark.createDataFrame(past, OBSERVATION).write.parquet(source)
    incremental.refresh_months(spark, source, OBSERVATION, build, target, state)
    spark.createDataFrame([("1", dt.datetime(2024, 1, 9), 30.0)], OBSERVATION).write.mode("append").parquet(source)
    out = incremental.refresh_months(spark, source, OBSERVATION, build, target, state)
    got = out.selectExpr("CAST(periodo AS STRING)", "tmax_anomalia_30d")
    assert rows(got) == [("2023-01-01", -5.0), ("2023-02-01", 0.0), ("2024-01-01", 5.0)]


def test_upserted_days_are_complete_after_every_run(spark, tmp_path, known, rows):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    runs = [[("1", dt.datetime(2024, 1, 3, 1), 2.0), ("2", dt.datetime(2024, 1, 3, 2), 8.0)], [("1", dt.datetime(2024, 1, 3, 9), 4.0), ("1", dt.datetime(2024, 1, 4), 1.0)]]
    expected = [[("a", "2024-01-03", 2.0), ("b", "2024-01-03", 8.0)], [("a", "2024-01-03", 6.0), ("a", "2024-01-04", 1.0), ("b", "2024-01-03", 8.0)]]
    for new, whole in zip(runs, expected, strict=True):
        spark.createDataFrame(new, OBSERVATION).write.mode("append").parquet(source)
        totals = incremental.daily_totals(incremental.observation_stream(spark, source, OBSERVATION), known)
        out = incremental.upsert_available(totals, target, state, ["codigo_municipio", "fecha"], "fecha")
        assert rows(out.selectExpr("codigo_municipio", "CAST(fecha AS STRING)", "precip_dia")) == whole
