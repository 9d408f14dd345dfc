"""Number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed2(value: Column) -> Column:
    """Two decimals by the exact binary value, ties away from zero.

    Spark's own ``round`` rounds the shortest decimal text of a double (1.005 gives
    1.01); prices are compared on the exact value (1.005 gives 1.00).  Real ties only
    occur on multiples of 1/8, where ``round`` is exact.
    """
    hundredths = value * 100
    whole = (hundredths == F.rint(hundredths)) & (F.abs(value) < 1e12)
    is_tie = value * 8 == F.floor(value * 8)
    # Amounts read from a page have two decimals already, so the first branch is the usual one.
    return (
        F.when(whole, hundredths / 100)
        .when(is_tie, F.round(value, 2))
        .otherwise(F.call_function("format_number", value, F.lit("0.00")).cast("double"))
    )


def unit_interval2(value: Column) -> Column:
    """Clamp to [0, 1] and keep two decimals."""
    return fixed2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
