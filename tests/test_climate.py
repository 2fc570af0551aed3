import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agrovane.operators import climate, stations
from agrovane.sources.landing import zones_from_features

D = dt.date


def daily(spark, values, zone="z"):
    return spark.createDataFrame([(zone, d, float(v)) for d, v in values], "codigo_municipio string, fecha date, precip_dia double")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(
        [("1", "a", "A"), ("02", "a", "A"), ("3", "b", "B"), ("4", None, None)],
        "codigoestacion string, codigo_municipio string, nombre_municipio string",
    )


@pytest.fixture(scope="module")
def readings(spark):
    random.seed(1)
    data = [
        (str(random.choice(["1", "001", "2", "3", "4", "9"])), dt.datetime(2020, 1, 1) + dt.timedelta(hours=random.randint(0, 24 * 500)),
         float(random.randint(0, 50)))
        for _ in range(2000)
    ] + [("1", None, 5.0), ("1", dt.datetime(2020, 1, 1), None)]
    return spark.createDataFrame(data, "codigoestacion string, fechaobservacion timestamp, valorobservado double")


def test_streaks_break_at_month_ends_and_count_rows(spark):
    days = [(D(2021, 1, 29), 0), (D(2021, 1, 30), 0), (D(2021, 1, 31), 0), (D(2021, 2, 1), 0.5), (D(2021, 2, 2), 1),
            (D(2021, 2, 3), 0), (D(2021, 2, 9), 0), (D(2021, 3, 1), 4), (D(2021, 3, 2), 5), (D(2021, 4, 1), 3), (D(2021, 4, 2), 0)]
    got = {r["periodo"]: r["dias_secos_consecutivos"] for r in climate.dry_streaks(daily(spark, days)).collect()}
    # A missing day does not end a run; a month without dry days has no row.
    assert got == {D(2021, 1, 1): 3, D(2021, 2, 1): 2, D(2021, 4, 1): 1}


def test_rolling_counts_rows_not_days(spark):
    days = [(D(2021, 1, 1) + dt.timedelta(days=10 * i), 1) for i in range(9)]
    assert [r["precip_7d"] for r in climate.rain_rolling(daily(spark, days)).orderBy("fecha").collect()] == [1, 2, 3, 4, 5, 6, 7, 7, 7]


def test_extreme_days_are_strictly_above(spark):
    days = [(D(2021, 1, i + 1), 7) for i in range(20)]
    row = climate.rain_monthly(daily(spark, days)).first()
    assert row["dias_lluvia_extrema"] == 0 and row["dias_secos_consecutivos"] is None
    assert row["precip_acum_30d"] == 140 and row["precip_anomalia_30d"] == 0


def test_station_keys_match_across_landings(readings, known, rows):
    counted = stations.attach_zone(readings, known).groupBy("codigo_municipio").count()
    expected = readings.filter("fechaobservacion is not null and valorobservado is not null").withColumn(
        "k", F.col("codigoestacion").cast("int")
    )
    assert rows(counted) == [("a", expected.filter("k in (1, 2)").count()), ("b", expected.filter("k = 3").count())]


def test_folded_path_equals_broadcast_path(readings, known, rows, monkeypatch):
    build = lambda: [
        rows(climate.rain_daily(readings, known)),
        rows(climate.tmax_monthly(readings, known)),
        rows(climate.ambient_monthly(readings, known)),
    ]
    direct = build()
    monkeypatch.setattr(stations, "fits_broadcast", lambda df: False)
    assert build() == direct


def test_one_pass_features_equal_the_outer_chain(readings, known, rows):
    part = lambda low: readings.filter(F.col("fechaobservacion") >= low)
    rain, tmax, hum, pres, amb, wind = (part(f"2020-{m:02d}-01") for m in (3, 1, 2, 5, 7, 9))
    frames = [
        climate.rain_monthly(climate.rain_daily(rain, known)),
        climate.tmax_monthly(tmax, known),
        climate.humidity_monthly(hum, known),
        climate.pressure_monthly(pres, known),
        climate.ambient_monthly(amb, known),
        climate.wind_monthly(wind, known),
    ]
    chain = frames[0]
    for f in frames[1:]:
        chain = chain.join(f, climate.ZONE_MONTH, "full")
    built = climate.climate_features(rain, tmax, hum, pres, amb, wind, known)
    shape = lambda df: rows(df.select(*[F.round(c, 6) if c.endswith(("d", "a")) and c not in climate.ZONE_MONTH else c for c in built.columns]))
    assert shape(built) == shape(chain)
    assert rows(climate.outer_merge(frames, climate.ZONE_MONTH).select("codigo_municipio", "periodo")) == rows(
        chain.select("codigo_municipio", "periodo")
    )


def test_stations_to_zones_against_brute_force(spark):
    random.seed(7)
    boxes = [(f"{i:05d}", x, y, x + w, y + h) for i, (x, y, w, h) in enumerate([(0, 0, 4, 4), (4, 0, 3, 9), (2, 2, 4, 4), (-5, -5, 2, 1)])]
    features = [
        (
            {"mpio_cdpmp": code, "mpio_cnmbr": code, "dpto_ccdgo": "1", "dpto_cnmbr": "d"},
            f'{{"type":"Polygon","coordinates":[[[{a},{b}],[{c},{b}],[{c},{d}],[{a},{d}],[{a},{b}]]]}}',
        )
        for code, a, b, c, d in boxes
    ]
    zones = zones_from_features(spark.createDataFrame(features, "properties map<string,string>, geometry string"))
    points = [(str(i), random.uniform(-6, 10), random.uniform(-6, 10)) for i in range(200)] + [("edge", 1.0, 0.0), ("corner", 4.0, 4.0)]
    df = spark.createDataFrame(points, "codigoestacion string, latitud double, longitud double")
    for cell in (0.5, 3.0):
        got = {r["codigoestacion"]: r["codigo_municipio"] for r in stations.stations_to_zones(df, zones, cell).collect()}
        for name, lat, lon in points:
            inside = [code for code, a, b, c, d in boxes if a < lon < c and b < lat < d]
            assert got[name] == (min(inside) if inside else None), (name, lat, lon)
