"""Rounding to decimal places from a double's exact binary value, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a fraction is cut: both parts times 10^4 or less are exact doubles.
_CUT = float(1 << 30)
#: Doubles of this size and more stay as they are; a double here has at most 13 bits after the point.
_LARGE = float(1 << 39)


def rounded(value: Column, places: int) -> Column:
    """value at 1 to 4 decimal places, halves to even: 2.675 is below its half in binary and gives 2.67.

    Spark's round() looks at the shortest decimal that spells the double, and so gives 2.68. Nulls, NaN,
    infinities and values of 2^39 and more stay as they are.
    """
    if not 1 <= places <= 4:
        raise ValueError("places must be 1 to 4")
    scale = float(10**places)
    x = F.abs(value.cast("double"))
    below = F.floor(x).cast("double")
    high = F.floor((x - below) * _CUT).cast("double") / _CUT
    whole = F.floor(high * scale).cast("double")
    over = (high * scale - whole - 0.5) + (x - below - high) * scale
    up = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)
    result = (below * scale + whole + up) / scale
    signed = F.when(value < 0, -result).otherwise(result)
    return F.when((x < _LARGE) & (x != below), signed).otherwise(value.cast("double"))
