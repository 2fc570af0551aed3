"""Numeric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_number(column: Column) -> Column:
    """Trimmed text to double; blank is NULL, any other bad text is an error."""
    return F.nullif(F.trim(column), F.lit("")).cast("double")


def lenient_number(column: Column) -> Column:
    """Text to double; bad text is NULL."""
    return F.trim(column.cast("string")).try_cast("double")


def lenient_month(column: Column) -> Column:
    """Text or date to the first day of its month; an unreadable date is NULL."""
    return F.trunc(F.trim(column.cast("string")).try_cast("timestamp").cast("date"), "month")


def mean_of_present(columns: list[str]) -> Column:
    """Row mean over the non-null columns; NULL if all are NULL.

    Written as SQL text: one expression instead of several driver calls per column.
    """
    total = " + ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0D)" for c in columns)
    present = " + ".join(f"CAST(`{c}` IS NOT NULL AS INT)" for c in columns)
    return F.expr(f"({total}) / nullif({present}, 0)")


def double_literal(value: float) -> str:
    """SQL text of a double, exact to the last bit."""
    if math.isinf(value):
        return f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
    return f"({value!r}D)"


def clip_unit(column: Column) -> Column:
    """Clip to [0, 1]; NULL stays NULL (``greatest`` and ``least`` would skip it)."""
    return F.when(column.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), column)))
