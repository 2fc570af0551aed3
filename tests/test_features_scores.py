import datetime as dt

import pytest
from pyspark.sql import functions as F

from agrovane.operators import agents, forest, master, production, scoring
from agrovane.sources.schemas import FEATURE_COLUMNS, KEY, SPC_COLUMNS

D = dt.date


def test_yield_variation_edge_cases(spark):
    df = spark.createDataFrame(
        [("a", "x", 2.0, 1.0, 1.0), ("a", "y", 0.0, 2.0, 1.0), ("a", "y", 0.0, 1.0, 1.0), ("a", "z", None, 9.0, 9.0)],
        "cultivo string, codigo_municipio string, rendimiento double, area_sembrada double, area_cosechada double",
    )
    got = {r["codigo_municipio"]: r for r in production.crop_share(production.yield_stats(df)).collect()}
    assert set(got) == {"x", "y"}
    assert got["x"]["rendimiento_cv"] is None and got["y"]["rendimiento_cv"] == 0
    assert got["y"]["participacion_municipal"] == 0.75


def test_crop_without_area_has_no_share(spark):
    df = spark.createDataFrame([("a", "x", 0.0), ("b", "x", None)], "cultivo string, codigo_municipio string, area_sembrada double")
    assert [r["participacion_municipal"] for r in production.crop_share(df).collect()] == [None, None]


def test_prices_short_series_duplicates_and_bad_dates(spark):
    raw = spark.createDataFrame(
        [(f"2021-{m:02d}-15", str(m)) for m in range(1, 8)] + [("2021-07-20", "9"), ("bad", "1"), ("2021-08-01", "n/a")],
        "Mes string, Valor string",
    )
    got = production.price_features(raw).orderBy("periodo", "insumos_nivel").collect()
    assert len(got) == 8
    assert [r["insumos_anomalia_12m"] for r in got[:5]] == [None] * 5
    assert got[5]["insumos_anomalia_12m"] == pytest.approx(6 - 3.5)
    assert got[3]["insumos_delta_3m"] == 3.0
    merged = production.price_features(raw, average_month=True)
    assert merged.count() == 7 and merged.filter(F.col("periodo") == D(2021, 7, 1)).first()["insumos_nivel"] == 8.0


def test_prices_by_series(spark):
    raw = spark.createDataFrame([("p", "2021-01-01", "1"), ("q", "2021-01-01", "5"), ("p", "2021-02-01", "2")], "s string, fecha string, indice string")
    assert production.price_features(raw, series="s").count() == 3
    with pytest.raises(ValueError):
        production.price_features(raw.drop("fecha"))


def _master(spark, socio):
    climate = spark.createDataFrame([("z", D(2021, 3, 1)), ("z", D(2021, 4, 1)), (None, D(2021, 4, 1))], "codigo_municipio string, periodo date")
    climate = climate.withColumns({c: F.lit(1.0) for c in SPC_COLUMNS})
    crops = spark.createDataFrame(
        [("z", "maiz", 3, 9), ("z", "yuca", None, None), ("y", "maiz", 3, 9)],
        "codigo_municipio string, cultivo string, mes_siembra int, mes_cosecha int",
    ).withColumns({c: F.lit(1.0) for c in ("area_sembrada", "area_cosechada", "rendimiento_promedio", "rendimiento_cv", "participacion_municipal")})
    prices = spark.createDataFrame([(D(2021, 3, 1), 1.0), (D(2021, 3, 1), 2.0)], "periodo date, insumos_nivel double").withColumns(
        {"insumos_anomalia_12m": F.lit(None).cast("double"), "insumos_delta_3m": F.lit(0.5)}
    )
    return master.master_features(climate, crops, prices, socio)


def test_master_fan_out_flags_and_optional_socio(spark):
    got = _master(spark, None).collect()
    # Two crops, two months, and the doubled price month.
    assert len(got) == 6
    flags = {(r["cultivo"], r["periodo"].month): r["fase_fenologica"] for r in got}
    assert flags == {("maiz", 3): 1, ("maiz", 4): 0, ("yuca", 3): 0, ("yuca", 4): 0}
    assert {r["insumos_nivel"] for r in got} == {1.0, 2.0, None} and {r["nbi_total"] for r in got} == {None}
    assert _master(spark, None).columns == [*KEY, *FEATURE_COLUMNS]
    socio = spark.createDataFrame([("z", 4.0, 5.0, 6.0)], "codigo_municipio string, nbi_total double, poblacion_rural double, pct_rural double")
    assert {r["pct_rural"] for r in _master(spark, socio).collect()} == {6.0}


def test_scaler_constant_empty_absent_and_outliers(spark):
    df = spark.range(201).select(
        F.col("id").cast("double").alias("area_sembrada"),
        F.lit(3.0).alias("area_cosechada"),
        F.lit(None).cast("double").alias("nbi_total"),
        F.when(F.col("id") > 100, F.col("id").cast("double")).alias("pct_rural"),
    )
    scaler = scoring.RobustScaler.fit(df)
    assert scaler.bounds["area_sembrada"] == (2.0, 198.0)
    got = scaler.transform(df).orderBy("id" if "id" in df.columns else "area_sembrada").collect()
    assert {r["area_cosechada"] for r in got} == {0.0} == {r["nbi_total"] for r in got} == {r["viento_media_30d"] for r in got}
    assert min(r["area_sembrada"] for r in got) == 0.0 and max(r["area_sembrada"] for r in got) == 1.0
    assert sum(r["pct_rural"] is None for r in got) == 101


def test_level_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (None,), (0.2499,)], "s double")
    got = [r[0] for r in df.select(scoring.risk_level(F.col("s"))).collect()]
    assert got == ["Bajo", "Medio", "Alto", "Crítico", "Crítico", "Crítico", "Bajo"]
    assert df.filter("s is null").select(scoring.risk_level(F.col("s"), None)).first()[0] is None


def test_score_of_missing_group_is_null(spark):
    df = spark.createDataFrame([(0.5,)], "x double").withColumns(
        {**{c: F.lit(0.4) for c in FEATURE_COLUMNS}, **{k: F.lit("k") for k in KEY}}
    ).withColumns({c: F.lit(None).cast("double") for c in FEATURE_COLUMNS[21:]})
    row = scoring.risk_scores(df).first()
    assert row["spc"] == pytest.approx(0.4) and row["sve"] is None and row["ira_score"] is None and row["ira_nivel"] == "Crítico"


def _losses(spark, values):
    return spark.createDataFrame(
        [(z, y, float(h), 0.0) for z, y, h in values], "codigo_municipio string, year int, tc_loss_ha double, primary_loss_ha double"
    )


def test_loss_trend_limits(spark):
    rising = [("up", 2020 + i, 100 + 50 * i) for i in range(5)]
    steeper = [("steep", 2020 + i, 100 + 51 * i) for i in range(5)]
    falling = [("down", 2020 + i, 400 - 50 * i) for i in range(5)]
    short = [("short", 2023, 1), ("short", 2024, 900), ("old", 2001, 5), (None, 2030, 1)]
    got = {r["codigo_municipio"]: r for r in forest.loss_features(_losses(spark, rising + steeper + falling + short)).collect()}
    assert got["up"]["deforestacion_tendencia"] == pytest.approx(50) and got["up"]["deforestacion_tendencia_label"] == "Estable"
    assert got["steep"]["deforestacion_tendencia_label"] == "Aumentando"
    assert got["down"]["deforestacion_tendencia_label"] == "Disminuyendo"
    assert got["short"]["deforestacion_tendencia"] == 0.0 and got["short"]["n_anos_datos"] == 2
    assert got["short"]["deforestacion_2024"] == 900 and got["old"]["deforestacion_total_10y"] == 0.0
    assert got["old"]["deforestacion_ha_promedio"] == 5.0


def test_wide_and_long_are_inverse(spark):
    names = spark.createDataFrame([("COL.1.2_1", "Dep", "Mun"), ("bad", "a", "b"), ("COL.1.3_1", None, "Sin")], "gid_2 string, name_1 string, name_2 string")
    long = spark.createDataFrame(
        [("COL", "1", "2", "2001", 5.0), ("COL", "1", "2", "2003", 0.0), ("COL", "x", "2", "2001", 1.0), ("COL", "9", "9", "2001", 1.0), ("COL", "1", "3", "2002", None)],
        "iso string, adm1 string, adm2 string, year string, ha double",
    )
    unit = forest.unit_names(names)
    named = forest.name_units(long, unit)
    assert named.count() == 3 and forest.unnamed_units(long, unit).count() == 1
    wide = forest.loss_wide(named)
    assert wide.columns[-3:] == ["tc_loss_ha_2001", "tc_loss_ha_2002", "tc_loss_ha_2003"]
    assert [tuple(r) for r in forest.loss_long(wide).collect()] == [("Dep", "Mun", 2001, 5.0)]
    assert forest.loss_long(wide, start_year=2002).count() == 0
    assert forest.with_primary(forest.loss_long(wide), None).first()["primary_loss_ha"] == 0.0


def test_agents(spark):
    df = spark.createDataFrame(
        [("maíz", 0.25, 0.76, None, 4.9), (None, 0.5, 0.5, 0.51, 5.0), ("x", 0.1, 0.2, 0.0, None)],
        "cultivo string, spc double, sep double, sve double, rendimiento_predicho double",
    )
    a, b, c = agents.analyze(df).collect()
    assert [x["nivel"] for x in a["agentes"]] == ["bajo", "crítico", "bajo"]
    assert a["agentes"][1]["hallazgos"] == [
        "Alta dependencia productiva en maíz", "Baja diversificación agrícola", "Rendimiento esperado bajo"
    ]
    assert a["prioridad"] == "crítico" and len(a["recomendaciones_sintetizadas"]) == 3
    assert [x["nivel"] for x in b["agentes"]] == ["medio", "medio", "alto"]
    assert b["agentes"][1]["hallazgos"] == ["Dependencia moderada en desconocido"]
    assert len(b["recomendaciones_sintetizadas"]) == 5
    assert b["recomendaciones_sintetizadas"][0] == "Mantener calendario de monitoreo climático"
    assert c["prioridad"] == "bajo" and c["recomendaciones_sintetizadas"] == []
    assert c["resumen"].startswith("Condiciones favorables")


def test_composite_does_not_depend_on_the_order_of_weights(spark):
    row = spark.createDataFrame([(0.2, 0.6, 0.7)], "spc double, sep double, sve double")
    for weights in ({"sep": 0.3, "spc": 0.5, "sve": 0.2}, {"spc": 0.5, "sep": 0.3, "sve": 0.2}):
        assert abs(row.select(scoring.composite(weights)).first()[0] - 0.42) < 1e-12
