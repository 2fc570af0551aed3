"""The stages from observations to served results, as plain functions over data frames."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from agrovane.ml import histboost, isolation, network, trees
from agrovane.ml.supervised import supervised_set
from agrovane.operators.assembly import assemble_results
from agrovane.operators.clean import socioeconomic
from agrovane.operators.climate import climate_features
from agrovane.operators.master import master_features
from agrovane.operators.production import price_features, production_features, socio_features
from agrovane.operators.scoring import RobustScaler, risk_scores
from agrovane.scale import materialize
from agrovane.sources.fixtures import Fixtures


def climate(fx: Fixtures) -> DataFrame:
    return climate_features(
        *[
            fx.observations(kind)
            for kind in ("precipitacion", "temperatura", "humedad", "presion", "tambiente", "viento")
        ],
        fx.stations(),
    )


def master(fx: Fixtures) -> DataFrame:
    """Master feature table of the fixture tables."""
    return master_features(
        climate(fx),
        production_features(fx.production(), fx.crop_calendar()),
        price_features(fx.input_prices()),
        socio_features(socioeconomic(fx.socio())),
    )


@dataclass(frozen=True)
class Scored:
    """A stored master table with its scaler; the scores stay lazy."""

    master: DataFrame
    scaler: RobustScaler

    @property
    def normalized(self) -> DataFrame:
        return self.scaler.transform(self.master)

    @property
    def scores(self) -> DataFrame:
        return risk_scores(self.normalized)


def score(master_table: DataFrame, stored: bool = False) -> Scored:
    """Fit the bounds and score. The master is written once unless it is a stored table already."""
    table = master_table if stored else materialize(master_table, "master")
    return Scored(table, RobustScaler.fit(table))


def full_results(scored: Scored, estimator=None, scope: str = "crop", max_rounds: int = network.MAX_ROUNDS) -> DataFrame:
    """Scores with fitted anomaly and yield models: the served result table."""

    def anomalies() -> DataFrame:
        normalized = scored.normalized
        nodes = materialize(isolation.fit_forest(normalized), "forest")
        return isolation.rescale(materialize(isolation.raw_scores(normalized, nodes), "raw-scores"))

    def yields() -> DataFrame:
        supervised = materialize(supervised_set(scored.master), "supervised")
        # The default learner boosts all crops together; an MLlib estimator fits one model per crop.
        if estimator is None:
            return histboost.predict(histboost.fit(supervised))
        return trees.predict(supervised, trees.fit_models(supervised, estimator, scope))

    def network_yields() -> DataFrame:
        unfiltered = supervised_set(scored.master, require_current=False)
        return network.predict(unfiltered, network.YieldNetwork.fit(unfiltered, max_rounds))

    # The three fits read the stored master only; the network's short rounds leave room for the other two.
    with ThreadPoolExecutor(3) as pool:
        fits = [pool.submit(inheritable_thread_target(scored.master.sparkSession)(fit)) for fit in (anomalies, yields, network_yields)]
        return assemble_results(scored.scores, *[fit.result() for fit in fits])
