import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrovane.functions import geo, numeric, quantiles, text
from agrovane.sources.landing import geometry_rings


def one(df):
    return df.first()[0]


def test_zone_and_station_keys(spark):
    df = spark.createDataFrame([(" 5 ", "0007", "12", "1234567", "000", 70)], "a string, b string, c string, d string, z string, i int")
    row = df.select(
        text.zone_code(F.col("a")),
        text.station_key(df, "b"),
        text.composite_zone_code(F.col("a"), F.col("c")),
        text.zfill(F.col("d"), 5),
        text.zone_code(F.col("d")),
        text.station_key(df, "z"),
        text.station_key(df, "i"),
    ).first()
    assert tuple(row) == ("00005", "7", "05012", "1234567", "12345", "0", "70")


@pytest.mark.parametrize("alphabet", ["spanish", "unicode"])
def test_normalize_name(spark, alphabet):
    names = ["Piendamó", "Mirití - Paraná", "  San   José\tdel  Guaviare ", "Ñ'ü (x)", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.normalize_name(F.col("n"), alphabet)).collect()]
    assert got == ["PIENDAMO", "MIRITI PARANA", "SAN JOSE DEL GUAVIARE", "NU X", "", None]


def test_search_wildcards_and_accents(spark):
    df = spark.createDataFrame([("Bogotá",), ("bogota",), ("a\\b",)], "n string")
    hits = lambda *a, **k: [r[0] for r in df.filter(text.contains_text(F.col("n"), *a, **k)).collect()]
    assert hits("GOTÁ") == ["Bogotá"]
    assert hits("bo_ot") == ["Bogotá", "bogota"]
    assert hits("gota", accent_insensitive=True) == ["Bogotá", "bogota"]
    assert hits("a\\b") == ["a\\b"]


def test_numbers(spark):
    df = spark.createDataFrame([(" 1.5 ", "x"), ("  ", ""), (None, "2021-03-09")], "a string, b string")
    assert [r[0] for r in df.select(numeric.strict_number(F.col("a"))).collect()] == [1.5, None, None]
    assert [r[0] for r in df.select(numeric.lenient_number(F.col("b"))).collect()] == [None, None, None]
    assert [str(r[0]) for r in df.select(numeric.lenient_month(F.col("b"))).collect()] == ["None", "None", "2021-03-01"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(numeric.strict_number(F.col("b"))).collect()


def test_row_mean_and_clip_keep_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(numeric.mean_of_present(["a", "b"])).collect()] == [1.0, None, 4.0]
    assert [r[0] for r in df.select(numeric.clip_unit(F.col("b"))).collect()] == [None, None, 1.0]


def test_double_literal_round_trip(spark):
    for value in (0.1, -1e-17, 1e300, 5.0, math.inf, -math.inf):
        assert spark.sql(f"SELECT {numeric.double_literal(value)}").first()[0] == value


@pytest.mark.parametrize("size", [1, 7, 3000, 60000])
def test_exact_quantiles_match_sorting(spark, size):
    rng = np.random.default_rng(size)
    heavy = np.where(rng.random(size) < 0.6, 0.0, rng.normal(size=size))
    long_tail = rng.lognormal(0, 3, size)
    data = [(float(a), float(b), 4.0, None) for a, b in zip(heavy, long_tail)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(3)
    got = {(r["feature"], r["p"]): r["value"] for r in quantiles.exact_quantiles(df, list("abcd"), [0.01, 0.5, 0.99]).collect()}
    assert {k[0] for k in got} == {"a", "b", "c"}
    for (feature, p), value in got.items():
        expected = np.quantile({"a": heavy, "b": long_tail, "c": np.full(size, 4.0)}[feature], p)
        assert value == pytest.approx(expected, rel=1e-12, abs=1e-15)


def test_exact_quantile_by_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    groups = np.where(rng.random(40000) < 0.9, "hot", rng.integers(0, 5, 40000).astype(str))
    values = rng.normal(size=40000).round(3)
    df = spark.createDataFrame([(str(g), float(v)) for g, v in zip(groups, values)], "g string, v double")
    for r in quantiles.exact_quantile_by(df, ["g"], "v", 0.05).collect():
        mine = values[groups == r["g"]]
        assert r["n"] == len(mine)
        assert r["value"] == pytest.approx(np.quantile(mine, 0.05), rel=1e-12)


def test_point_in_polygon_with_hole_and_border(spark):
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    hole = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
    far = [[20, 0], [25, 0], [22, 5], [20, 0]]
    polygon = f'{{"type":"Polygon","coordinates":[{ring},{hole}]}}'
    multi = f'{{"type":"MultiPolygon","coordinates":[[{ring},{hole}],[{far}]]}}'
    points = {
        (1.0, 1.0): (True, True),
        (5.0, 5.0): (False, False),
        (0.0, 5.0): (False, False),
        (10.0, 10.0): (False, False),
        (4.0, 5.0): (False, False),
        (22.0, 1.0): (False, True),
        (30.0, 1.0): (False, False),
    }
    df = spark.createDataFrame([(x, y, polygon, multi) for x, y in points], "x double, y double, p string, m string")
    got = df.select(
        "x", "y", *[geo.strictly_inside(F.col("x"), F.col("y"), geo.ring_edges(geometry_rings(F.col(c)))) for c in "pm"]
    ).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == points
