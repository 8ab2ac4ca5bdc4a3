"""Unknown values are NULL: helpers that keep NaN, infinity and bad divisions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c: Column | str) -> Column:
    """NULL for NaN and both infinities, the value otherwise."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_div(num: Column | str, den: Column | str, eps: float = TINY) -> Column:
    """Quotient, or NULL where the denominator is (almost) zero."""
    d = col(den)
    return F.when(F.abs(d) > eps, col(num) / d)


def printed(c: Column | str, digits: int) -> Column:
    """Text of a figure as printf of a rounded value gives it: halves away from zero, and a negative figure that rounds to zero keeps its sign."""
    x = col(c)
    shown = F.round(F.abs(x) * 10.0**digits, 0) / 10.0**digits
    return F.format_string(f"%.{digits}f", F.when(x < 0, -shown).otherwise(shown))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Raise when a required column is absent; return the frame otherwise."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def drop_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows where all ``columns`` are known: not NULL, NaN or infinite.

    One condition per column (not one expression over all of them) keeps the optimizer's list of
    inferred constraints linear in the number of columns.
    """
    for c in columns:
        df = df.filter(clean_double(c).isNotNull())
    return df
