"""Robust normalisation, sub-indices and the composite risk score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrovane.functions.numeric import clip_unit, double_literal, mean_of_present
from agrovane.functions.quantiles import exact_quantiles
from agrovane.sources.schemas import FEATURE_COLUMNS, KEY, SEP_COLUMNS, SPC_COLUMNS, SVE_COLUMNS

# Weights of the sub-indices and half-open level bands.
WEIGHTS = {"spc": 0.5, "sep": 0.3, "sve": 0.2}
LEVELS = [("Bajo", 0.00, 0.25), ("Medio", 0.25, 0.50), ("Alto", 0.50, 0.75), ("Crítico", 0.75, 1.01)]
LOW_P, HIGH_P = 0.01, 0.99


def robust_bounds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(feature, p1, p99)`` over the whole table; a column without values has no row."""
    columns = [c for c in (columns or FEATURE_COLUMNS) if c in df.columns]
    quantiles = exact_quantiles(df, columns, [LOW_P, HIGH_P])
    return quantiles.groupBy("feature").agg(
        F.max(F.when(F.col("p") == LOW_P, F.col("value"))).alias("p1"),
        F.max(F.when(F.col("p") == HIGH_P, F.col("value"))).alias("p99"),
    )


@dataclass(frozen=True)
class RobustScaler:
    """Fitted bounds of the 27 features; applying them is a projection of literals, with no join."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame) -> RobustScaler:
        """``df`` should be a stored table: the exact quantiles read it more than once."""
        return cls({r["feature"]: (r["p1"], r["p99"]) for r in robust_bounds(df).collect()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled features; an absent, empty or constant column is 0 in every row, a NULL stays NULL."""
        present = set(df.columns)
        scaled = {c: self._scaled(c) if c in present else F.lit(0.0) for c in FEATURE_COLUMNS}
        return df.withColumns(scaled)

    def _scaled(self, column: str) -> Column:
        low, high = self.bounds.get(column, (0.0, 0.0))
        if high == low:
            return F.lit(0.0)
        scaled = f"(`{column}` - {double_literal(low)}) / {double_literal(high - low)}"
        return F.expr(f"CASE WHEN `{column}` IS NOT NULL THEN greatest(0D, least(1D, {scaled})) END")


def subindices(normalized: DataFrame) -> DataFrame:
    """Row means of the three feature groups."""
    groups = {"spc": SPC_COLUMNS, "sep": SEP_COLUMNS, "sve": SVE_COLUMNS}
    return normalized.withColumns({name: mean_of_present(cs) for name, cs in groups.items()})


def composite(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the three sub-indices, whatever the order in which their weights are given."""
    weights = weights or WEIGHTS
    return clip_unit(F.col("spc") * weights["spc"] + F.col("sep") * weights["sep"] + F.col("sve") * weights["sve"])


def risk_level(score: Column, null_level: str | None = "Crítico") -> Column:
    """Level by half-open bands; a score outside all bands, or NULL, gets ``null_level``."""
    out = None
    for name, low, high in LEVELS:
        hit = (score >= low) & (score < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(null_level).cast("string"))


def risk_scores(normalized: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Key, sub-indices, composite score and level from normalised features."""
    return (
        subindices(normalized)
        .withColumn("ira_score", composite(weights))
        .withColumn("ira_nivel", risk_level(F.col("ira_score")))
        .select(*KEY, "spc", "sep", "sve", "ira_score", "ira_nivel")
    )


def level_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.coalesce("ira_nivel", F.lit("Sin dato")).alias("ira_nivel")).agg(
        F.count(F.lit(1)).alias("filas")
    )
