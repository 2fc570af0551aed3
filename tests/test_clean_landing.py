import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from agrovane.operators import clean
from agrovane.sources import landing
from agrovane.sources.schemas import OBSERVATION, RAW_TABLES


def test_missing_source_is_a_typed_empty_frame(spark, tmp_path):
    assert len(RAW_TABLES) == 13
    df = landing.read_raw(spark, str(tmp_path), "raw_ndvi")
    assert df.count() == 0 and df.columns == ["PCODE", "date", "adm_level", "vim", "vim_avg", "viq"]
    assert clean.clean_ndvi(df).count() == 0
    spark.createDataFrame([("1", "2", "3")], RAW_TABLES["raw_estaciones"]).write.parquet(f"{tmp_path}/raw_estaciones.parquet")
    assert landing.read_raw(spark, str(tmp_path), "raw_estaciones").count() == 1


def test_csv_and_json_landing(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("codigoestacion,fechaobservacion,valorobservado\n0012,2021-01-02 03:04:05, 1.5 \n7,bad,x\n")
    got = landing.read_csv_text(spark, str(csv), OBSERVATION).collect()
    assert got[0]["codigoestacion"] == "0012" and got[0]["valorobservado"] == 1.5
    assert got[1]["fechaobservacion"] is None and got[1]["valorobservado"] is None
    records = tmp_path / "a.json"
    records.write_text(json.dumps([{"cultivo": "Maíz", "x": 1}, {"cultivo": None}]))
    df = landing.read_json_records(spark, str(records), RAW_TABLES["raw_eva_calendario"])
    assert [r["cultivo"] for r in df.collect()] == ["Maíz", None]


def test_geojson_layer(spark, tmp_path):
    feature = {
        "type": "Feature",
        "properties": {"MPIO_CDPMP": "05001", "mpio_cnmbr": "Medellín", "DPTO_CCDGO": "05", "dpto_cnmbr": "Antioquia", "z": 3},
        "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
    }
    document = tmp_path / "doc.geojson"
    document.write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    lines = tmp_path / "lines.geojson"
    lines.write_text(json.dumps(feature) + "\n" + json.dumps(feature) + "\n")
    for path in (document, lines):
        got = landing.read_geojson_zones(spark, str(path)).collect()
        assert len(got) == 2
        assert (got[0]["codigo_municipio"], got[0]["nombre_departamento"]) == ("05001", "Antioquia")
        assert got[0]["rings"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
        assert json.loads(got[0]["geom"])["type"] == "Polygon"


def test_cutoff_is_pushed_to_the_scan(spark, tmp_path):
    df = spark.range(10).select(F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("f"))
    df.write.parquet(f"{tmp_path}/o")
    kept = landing.since(spark.read.parquet(f"{tmp_path}/o"), "f", dt.date(2025, 1, 3), 5)
    assert kept.count() == 6
    assert "GreaterThanOrEqual(f,2020-01-05)" in kept._jdf.queryExecution().executedPlan().toString()


def test_column_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Total int, ` NBI ` int, Latitud_N int")
    assert landing.resolve_column(df, ["nbi", "total"]) == " NBI "
    assert landing.resolve_column(df, ["latit"], mode="contains") == "Latitud_N"
    assert landing.resolve_column(df, ["none"], required=False) is None
    with pytest.raises(ValueError):
        landing.resolve_column(df, ["none"])
    both = spark.createDataFrame([("1", "2")], "mpio_cdpmp string, mpio_ccnct string")
    with pytest.raises(ValueError, match="both"):
        landing.rename_synonyms(both, landing.ZONE_SYNONYMS)


def test_socioeconomic_takes_what_is_there(spark):
    full = spark.createDataFrame(
        [(" 5001", "medellin ", "x", "30", "0")], "divipola string, municipio string, nbi string, rural string, total string"
    )
    row = clean.socioeconomic(full).first()
    assert row["codigo_municipio"] == "05001" and row["nombre_municipio"] == "MEDELLIN"
    assert row["nbi_total"] is None and row["poblacion_rural"] == 30.0 and row["pct_rural"] is None
    bare = clean.socioeconomic(full.select("divipola", "nbi"))
    assert bare.columns == ["codigo_municipio", "nbi_total"]


def test_footer_and_required(spark):
    df = spark.createDataFrame([(None, None, "note"), ("a", None, "x"), ("a", "b", None)], "c string, d string, e string")
    assert clean.drop_footer(df, ["c", "d"]).count() == 2
    assert clean.require(df, ["c", "d"]).count() == 1


def test_poverty_codes_are_never_truncated(spark):
    df = spark.createDataFrame([("5", "1", "1.5"), ("123", "4567", "x"), (None, "1", "2")], "cod_depto string, cod_mun string, nbi_total string")
    got = sorted(tuple(r) for r in clean.poverty_by_zone(df).collect())
    assert got == [("05001", 1.5), ("1234567", None)]


def test_first_per_key_orders_nulls_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "z", 2), ("a", "b", 3), ("c", None, 4)], "k string, o string, v int")
    got = sorted(tuple(r) for r in clean.first_per_key(df, ["k"], ["o"]).collect())
    assert got == [("a", "b", 3), ("c", None, 4)]


def test_profile_ignores_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-05",), ("bad",), (None,)], "fechaobservacion string")
    assert tuple(clean.landing_profile(df, "x").first()) == ("x", 3, dt.date(2020, 1, 5), dt.date(2020, 1, 5))


def test_newest(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (3, "a"), (None, "c")], "t int, s string")
    assert [tuple(r) for r in landing.newest(df, "t", 2, ["s"]).collect()] == [(3, "a"), (3, "b")]
