"""The registered model queries fit what the library fits by default."""

import pytest

from agrovane.ml import evaluation, histboost, isolation, network, trees
from agrovane.plans import queries

FOLDER = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.fixture
def asked(spark, monkeypatch):
    """What a query asks to be fitted; nothing is fitted."""

    def of(name):
        def fit_models(rows, estimator, *args, **options):
            raise Seen(estimator)

        def fit_network(rows, max_rounds=network.MAX_ROUNDS):
            raise Seen(max_rounds)

        def evaluate(rows, tree_estimator=None, max_rounds=network.MAX_ROUNDS):
            raise Seen((tree_estimator, max_rounds))

        def fit_forest(df, columns=None, scope="global", trees=isolation.TREES, **options):
            raise Seen(trees)

        def boost(rows, trees=histboost.TREES, **options):
            raise Seen(trees)

        monkeypatch.setattr(trees, "fit_models", fit_models)
        monkeypatch.setattr(network.YieldNetwork, "fit", staticmethod(fit_network))
        monkeypatch.setattr(queries, "evaluate_models", evaluate)
        monkeypatch.setattr(isolation, "fit_forest", fit_forest)
        monkeypatch.setattr(histboost, "fit", boost)
        with pytest.raises(Seen) as seen:
            queries.QUERIES[name](spark, FOLDER)
        return seen.value.args[0]

    return of


def test_queries_fit_whole_models(asked):
    assert asked("yield_tree").getMaxIter() == trees.TREES == 200
    # All crops are boosted together, with as many trees as MLlib fits per crop.
    assert asked("yield_drivers") == histboost.TREES == trees.TREES
    assert asked("yield_tree_forest").getNumTrees() == trees.TREES
    assert asked("yield_mlp") == network.MAX_ROUNDS == 500
    estimator, rounds = asked("model_evaluation")
    assert (estimator or evaluation.boosted_trees()).getMaxIter() == trees.TREES and rounds == network.MAX_ROUNDS
    assert asked("anomaly_forest") == asked("anomaly_forest_by_crop") == isolation.TREES == 100
