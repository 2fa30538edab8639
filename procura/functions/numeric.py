"""Numeric rules shared by all operators: rounding, coercion, null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.schema import AMOUNT

# Plain decimal or scientific notation. A bare cast would also accept '12d', 'nan' and 'Infinity'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def half_even(x: Column, digits: int = 2) -> Column:
    """Round half to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def coerce_number(x: Column) -> Column:
    """Text to double; anything that is not a finite number becomes null."""
    number = F.when(F.trim(x).rlike(NUMBER_PATTERN), x.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_amount(x: Column) -> Column:
    """Double to exact money. Null when it does not fit 18 digits."""
    return half_even(x, 2).try_cast(AMOUNT)


def total(column: str = "VALOR") -> Column:
    """Exact sum, 0 for no rows, exposed as double."""
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def mean(column: str = "VALOR") -> Column:
    """Mean as one division of the exact sum, so it does not depend on row order."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def sample_std(column: str = "VALOR") -> Column:
    """Sample deviation, 0 for a single row."""
    return F.coalesce(F.stddev_samp(F.col(column).cast("double")), F.lit(0.0))


def ratio_or(num: Column, den: Column, default: float | None) -> Column:
    """num / den where den is positive, else the default."""
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(default).cast("double"))


def growth(current: Column, previous: Column, finite_only: bool = False) -> Column:
    """Relative change. From 0 it is infinite (null with finite_only); from 0 to 0 it is null."""
    step = F.try_divide(current, previous) - F.lit(1.0)
    if finite_only:
        return F.when(previous != 0, step)
    jump = F.when(current > 0, F.lit(float("inf"))).when(current < 0, F.lit(float("-inf")))
    return F.when(previous != 0, step).when(previous == 0, jump)


def without_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with no null in the columns; plain IS NOT NULL filters reach the Parquet scan."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def grouped(df: DataFrame, *keys: str):
    """groupBy without null keys."""
    return without_nulls(df, *keys).groupBy(*keys)
