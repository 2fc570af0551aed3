"""Result tables put together from their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrovane.sources.schemas import KEY

RESULT_COLUMNS = [
    *KEY,
    "spc",
    "sep",
    "sve",
    "ira_score",
    "ira_nivel",
    "anomaly_score",
    "is_anomaly",
    "rendimiento_predicho",
    "rendimiento_ic_inf",
    "rendimiento_ic_sup",
    "importancia_top3",
    "rendimiento_nnet",
    "nnet_ic_inf",
    "nnet_ic_sup",
]


def assemble_results(scores: DataFrame, anomalies: DataFrame, trees: DataFrame, network: DataFrame) -> DataFrame:
    """Scores with anomaly and yield columns, by the three-part key.

    All four sides are hashed on the same key, so each is shuffled once and the joins need no further exchange.
    """
    out = scores
    for side in (anomalies, trees, network):
        out = out.join(side, KEY, "left")
    return out.select(*RESULT_COLUMNS)


def latest_run_status(runs: DataFrame) -> DataFrame:
    """Latest outcome of each pipeline step."""
    return (
        runs.groupBy("step")
        .agg(F.max_by(F.struct("ok", "rows", "seconds", "detail"), "finished_at").alias("r"),
             F.max("finished_at").alias("finished_at"))
        .select("step", "r.*", "finished_at")
    )
