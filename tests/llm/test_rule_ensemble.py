import random
import zlib

import pytest
from pyspark.sql import functions as F

from agrovane.llm import rule_ensemble as m

LABELS = "doc_id long, quality int, toxic int, text string"


def text(k):
    rng = random.Random(k)
    words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60 + k % 90)]
    good = k % 3 > 0
    if not good:
        words = [w + "###" for w in words] if k % 2 else words[:3] * 40
    return " ".join(words), int(good)


@pytest.fixture
def tables(spark, frame):
    rows = [(k, text(k)[0]) for k in range(400)] + [(None, text(4)[0]), (900, None), (901, ""), (902, "w " * 100_000), (7, text(7)[0])]
    labels = [(k, text(k)[1], 0, "x") for k in range(0, 400)] + [(901, None, 0, "x"), (None, 1, 0, "x"), (1, 0, 0, "x"), (902, 7, 0, "x")]
    return frame(rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_form(tables):
    docs, labels = tables
    out = m.op6(docs, labels).collect()
    assert len(out) == docs.count()
    right = [r["predicted"] == text(r["doc_id"])[1] for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(right) > 50 and sum(right) / len(right) >= 0.95
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_held_out_labels_change_nothing(tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(m.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(repr, m.op6(docs, labels).collect())) == sorted(map(repr, m.op6(docs, other).collect()))


def test_weights_are_sparse_and_compile(tables):
    docs, labels = tables
    features = m.statistics(docs)
    model = m.fit(m.training_rows(features, labels))
    assert 0 < len(model.weights) < 60
    row = features.select("*", model.score().alias("score")).first()
    total = model.intercept
    for rule, weight in model.weights:
        total += weight * all((row[c.feature] > c.threshold) == c.above for c in rule)
    assert abs(row["score"] - 1 / (1 + 2.718281828459045**-total)) < 1e-9


def test_bound_on_training_rows(tables):
    docs, labels = tables
    features = m.statistics(docs)
    assert m.training_rows(features, labels).count() > 250 > 150 > m.training_rows(features, labels, 100).count() > 50


def test_no_or_one_label(spark, frame, tables):
    docs, labels = tables
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in m.op6(docs, none).collect()} == {0.5}
    ones = m.op6(docs, labels.where("quality = 1 AND doc_id > 1")).collect()
    assert len({r["score"] for r in ones}) == 1 and ones[0]["score"] > 0.9
    assert m.op6(frame([]), labels).collect() == []


def test_paths_of_a_description():
    lines = "Model\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 0 <= 0.5)\n      Predict: 0.0\n     Else (feature 0 > 0.5)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    at = lambda above, t: m.Condition("a", above, t)
    assert m.paths(lines, ["a"]) == {frozenset([at(False, 1.5)]), frozenset([at(False, 0.5)]), frozenset([at(False, 1.5), at(True, 0.5)]), frozenset([at(True, 1.5)])}
