import itertools
import random

import pytest

from agrovane.operators import names

ZONES = [
    ("05002", "Caldas", "Antioquia"),
    ("17001", "Caldas", "Boyacá"),
    ("05761", "Sopetrán", "Antioquia"),
    ("70678", "San Benito Abad", "Sucre"),
    ("19548", "Piendamó", "Cauca"),
    ("25001", "Agua de Dios", "Cundinamarca"),
    ("13001", "Tierra Alta Cordoba", "Bolívar"),
]


def resolve(spark, pairs, **options):
    zones = spark.createDataFrame(ZONES, "codigo_municipio string, nombre_municipio string, nombre_departamento string")
    df = spark.createDataFrame(pairs, "departamento string, municipio string")
    return {(r["departamento"], r["municipio"]): (r["codigo_municipio"], r["via"]) for r in names.resolve_names(df, zones, **options).collect()}


def test_cascade(spark):
    got = resolve(
        spark,
        [
            ("Antioquia", "CALDAS"),
            ("Antioquia", "El Sopetran"),
            ("Sucre", "San Benito"),
            ("Cauca", "Piendamá"),
            ("Cordoba", "Tierra Alta"),
            ("Cundinamarca", "Dios de  Agua"),
            ("X", "Nowhere"),
            ("X", "!!"),
        ],
    )
    # Two zones share the bare name: the greatest code, although the department is known.
    assert got[("Antioquia", "CALDAS")] == ("17001", "directo")
    assert got[("Antioquia", "El Sopetran")] == ("05761", "alias")
    assert got[("Sucre", "San Benito")] == ("70678", "alias")
    assert got[("Cauca", "Piendamá")] == ("19548", "alias")
    assert got[("Cordoba", "Tierra Alta")] == ("13001", "departamento")
    assert got[("Cundinamarca", "Dios de  Agua")] == ("25001", "palabras")
    assert got[("X", "Nowhere")] == (None, None)
    assert got[("X", "!!")] == (None, None)


def test_department_first_option(spark):
    assert resolve(spark, [("Antioquia", "Caldas")], prefer_department=True)[("Antioquia", "Caldas")] == ("05002", "departamento")


@pytest.mark.parametrize("enumerated", [0, 2, 8])
def test_fuzzy_equals_brute_force(spark, enumerated):
    random.seed(4)
    words = ["SAN", "DE", "LA", "RIO", "ALTO", "SUR", "VILLA"]
    make = lambda: " ".join(random.choices(words, k=random.randint(1, 5)))
    keys, candidates = sorted({make() for _ in range(60)} | {""}), sorted({make() for _ in range(60)} | {""})
    got = names.match_fuzzy(
        spark.createDataFrame([(k,) for k in keys], "clave string"),
        spark.createDataFrame([(c,) for c in candidates], "nombre string"),
        enumerated,
    )
    expected = {}
    for k, c in itertools.product(keys, candidates):
        a, b = set(k.split()), set(c.split())
        if a and b and len(a & b) >= min(len(a), len(b)):
            expected[k] = min(expected.get(k, c), c)
    assert {r["clave"]: r["nombre"] for r in got.collect()} == expected


def test_report_counts_rows_and_names(spark):
    zones = spark.createDataFrame(ZONES, "codigo_municipio string, nombre_municipio string, nombre_departamento string")
    facts = spark.createDataFrame([("Cauca", "Piendamo")] * 3 + [("X", "Nope"), ("Y", "Nope")], "departamento string, municipio string")
    resolved = names.resolve_names(facts, zones)
    assert tuple(names.match_report(facts, resolved).first()) == (3, 5, 1)
    assert [r[0] for r in names.unmatched_names(resolved).collect()] == ["Nope"]
    assert names.attach_codes(facts, resolved).count() == 5


def test_facts_without_a_department_keep_their_code(spark):
    """NULL departments join NULL departments."""
    facts = spark.createDataFrame([(None, "Uno"), (None, "Uno"), ("D", "Uno"), (None, "Nadie")], "departamento string, municipio string")
    resolved = spark.createDataFrame(
        [(None, "Uno", "00001", "exacto"), ("D", "Uno", "00001", "exacto"), (None, "Nadie", None, None)],
        "departamento string, municipio string, codigo_municipio string, via string",
    )
    coded = names.attach_codes(facts, resolved)
    assert sorted(map(repr, (r["codigo_municipio"] for r in coded.collect()))) == ["'00001'"] * 3 + ["None"]
    assert coded.columns == ["departamento", "municipio", "codigo_municipio"]
    assert tuple(names.match_report(facts, resolved).first()) == (3, 4, 1)


def test_fuzzy_reads_its_input_once(spark):
    """The facts behind the keys are read when the distinct names are stored, not again by every way of matching."""
    keys = spark.range(6).selectExpr("concat('SAN ', element_at(array('LUIS', 'JOSE'), int(id % 2) + 1)) AS clave")
    found = names.match_fuzzy(keys, spark.createDataFrame([("LUIS",), ("SAN JOSE DEL MONTE",)], "nombre string"))
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("SAN JOSE", "SAN JOSE DEL MONTE"), ("SAN LUIS", "LUIS")]
