"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from agrovane.plans import pipeline, queries
from agrovane.session import local_session
from agrovane.sources.fixtures import Fixtures

# Built from the raw tables in this order: later entries read the stored layers of earlier ones, like a pipeline run.
HEADLINE = [
    "rain_daily",
    "rain_monthly",
    "climate_outer",
    "yield_stats",
    "clean_production",
    "name_match_cascade",
    "station_zone_spatial",
    "master_features",
    "risk_scores",
    "result_assembly",
    "ranking",
    "general_summary",
    "map_layer",
    "agent_levels",
    "loss_features",
    "anomaly_forest",
    "stream_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    # One small run, so that class loading and code generation are not charged to the first query.
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        pipeline.score(pipeline.master(Fixtures(spark, warm))).scores.write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        started = time.monotonic()
        queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": seconds, "sf": folder}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
