"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of the Spanish alphabet (and common neighbours) and what is left of them after a
# compatibility decomposition without its combining marks.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿªº"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyyao"


def zfill(column: Column, width: int) -> Column:
    """Zero-pad on the left; unlike ``lpad`` a longer text is kept whole."""
    return F.when(F.length(column) >= width, column).otherwise(F.lpad(column, width, "0"))


def zone_code(column: Column) -> Column:
    """Five-digit zone key: trimmed, zero-padded."""
    return F.lpad(F.trim(column), 5, "0")


def composite_zone_code(department: Column, municipality: Column) -> Column:
    """Two-digit department plus three-digit municipality."""
    return F.concat(zfill(F.trim(department), 2), zfill(F.trim(municipality), 3))


def station_key(df: DataFrame, name: str = "codigoestacion") -> Column:
    """Canonical station key: text, trimmed, without leading zeros.

    CSV landing infers integers and so loses the zeros that JSON landing keeps; an integer needs only the cast.
    """
    column = df[name]
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return column.cast("string")
    text = F.trim(column.cast("string"))
    stripped = F.ltrim(text, F.lit("0"))
    return F.when((stripped == "") & (text != ""), "0").otherwise(stripped)


@F.pandas_udf(T.StringType())
def _fold_to_ascii(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def fold_ascii(column: Column, alphabet: str = "spanish") -> Column:
    """Drop accents. ``spanish`` stays in the JVM; ``unicode`` decomposes any script with an Arrow-batched UDF."""
    if alphabet == "unicode":
        return _fold_to_ascii(column)
    return F.regexp_replace(F.translate(column, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def normalize_name(column: Column, alphabet: str = "spanish") -> Column:
    """Match key of a place name: ASCII, upper case, letters, digits and single blanks only."""
    upper = F.upper(fold_ascii(column, alphabet))
    kept = F.regexp_replace(upper, r"[^A-Z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def contains_text(column: Column, pattern: str, accent_insensitive: bool = False) -> Column:
    """Case-insensitive substring search; ``%`` and ``_`` in the pattern stay wildcards."""
    if accent_insensitive:
        column = fold_ascii(column)
        pattern = unicodedata.normalize("NFKD", pattern).encode("ascii", "ignore").decode("ascii")
    escaped = pattern.replace("\\", "\\\\")
    return column.ilike(f"%{escaped}%")


def period_text(column: Column) -> Column:
    """``YYYY-MM-DD``."""
    return F.date_format(column, "yyyy-MM-dd")
