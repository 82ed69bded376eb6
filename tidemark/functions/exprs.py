"""Expressions that the daily tables share. Means and ratios are taken in decimals, so no order of summation can move a value over a tie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holds counts, milliseconds and values of up to six decimals.
DECIMAL = "decimal(20,6)"


def exact(x: Column) -> Column:
    return x.cast("double").cast(DECIMAL)


def rounded(x: Column, scale: int = 2) -> Column:
    """Rounded half up, as a double."""
    return F.round(x, scale).cast("double")


def mean(x: Column, scale: int = 2) -> Column:
    """Rounded mean; nulls don't count."""
    return rounded(F.avg(exact(x)), scale)


def share(condition: Column, scale: int = 2) -> Column:
    """Rounded share of all rows; where the condition is null it counts as false."""
    return mean(F.when(condition, 1.0).otherwise(0.0), scale)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, rounded; 0.0 where whole is not positive."""
    return F.when(whole > 0, rounded(F.try_divide(exact(part), exact(whole)))).otherwise(F.lit(0.0))


def any_of(condition: Column) -> Column:
    """Whether the condition holds in any row; null counts as false."""
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))
