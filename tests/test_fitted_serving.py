"""Serving reads the results of the fitted models."""

import __spark_entry__ as entry
from agrovane.ml import trees
from agrovane.plans import pipeline, queries
from agrovane.sources.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


def test_serving_reads_the_fitted_table(spark, monkeypatch):
    """The fit is replaced by one of two trees and one round, to see that its rows, and no others, are served."""
    whole, asked = pipeline.full_results, []

    def small(scored, **options):
        asked.append(options)
        return whole(scored, trees.boosted_trees(2), "global", 1)

    monkeypatch.setattr(pipeline, "full_results", small)
    monkeypatch.setattr(queries, "_stored", {})
    known = entry.queries()
    results = {(r["codigo_municipio"], r["cultivo"], str(r["periodo"])): r for r in known["full_results"](spark, FOLDER).collect()}
    page = entry.entry(spark).collect()
    assert asked == [{}] and len(page) == 50
    for r in page:
        fitted = results[r["codigo_municipio"], r["cultivo"], r["periodo"]]
        for name in ("anomaly_score", "rendimiento_predicho"):
            assert (fitted[name] is None and r[name] is None) or abs(fitted[name] - r[name]) < 1e-4
    assert {f"fitted_{n}" for n in ("ranking_page", "ranking_search", "map_layer", "general_summary")} <= set(known)
    assert {r["importancia_top3"] for r in results.values()} != {'[{"var":"area_sembrada","importance":0.5}]', "{broken", None}
    scores = {r["anomaly_score"] for r in results.values()}
    assert scores != {r["anomaly_score"] for r in known["result_assembly"](spark, FOLDER).collect()}
