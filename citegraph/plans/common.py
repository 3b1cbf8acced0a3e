"""Shared helpers for catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_half_away(c, digits: int = DIGITS):
    """round(x * 10^d) / 10^d in binary floating point, halves away from zero.

    Spark's ``round`` rounds the decimal form of the double, so a product
    that lands just below .5 in binary (0.0640625 * 1e6) rounds differently
    from the float rule used by the SQL oracle; this keeps both identical.
    """
    m = float(10 ** digits)
    y = c.cast("double") * F.lit(m)
    t = F.abs(y)
    # |y| >= 1e15: doubles there have no fractional digits left to round
    fl = F.floor(F.when(t < 1e15, t).otherwise(F.lit(0.0))).cast("double")
    r = F.when(t - fl >= 0.5, fl + 1.0).otherwise(fl)
    return (
        F.when(y.isNull() | F.isnan(y), c.cast("double"))
        .when(t >= 1e15, c.cast("double"))
        .otherwise(F.signum(y) * r / F.lit(m))
    )


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (the oracle rounds the same way)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_half_away(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
