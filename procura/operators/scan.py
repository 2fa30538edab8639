"""Running computations over an ordered series that may be too long for one task.

A plain window puts each series into one task. That is right when a series has a
bounded length (one row per calendar month). For a global order, or for a key that
may hold a large share of all rows, the series is cut by value range first:

1. range-partition on (series, order): the ranges cut long series and ties evenly;
2. run the window inside each (series, range) and make the result durable, because
   range borders come from sampling and must not move between two reads;
3. carry count, sum and last value over from earlier ranges. Only series that span
   several ranges need it, at most two rows per range, so the carry is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.sources.tables import durable

_RANGE = "_range"
WANT = ("POS", "ACUM", "ANTERIOR")


def bounded_scan(df: DataFrame, series: list[str], order: list[Column], value: str, want: tuple = WANT) -> DataFrame:
    """Adds POS (0-based), ACUM (running sum) and ANTERIOR (previous value) per series, as wanted."""
    ordered = Window.partitionBy(*series).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {
        "POS": F.row_number().over(ordered).cast("long") - 1,
        "ACUM": F.sum(value).over(running),
        "ANTERIOR": F.lag(value).over(ordered),
    }
    return df.withColumns({c: added[c] for c in WANT if c in want})


def ranged_scan(df: DataFrame, series: list[str], order: list[Column], value: str, want: tuple = WANT) -> DataFrame:
    """Same columns as bounded_scan, for series of any length. `order` must be total."""
    cut = df.repartitionByRange(*[F.col(c) for c in series], *order).withColumn(_RANGE, F.spark_partition_id())
    local = durable(bounded_scan(cut, [*series, _RANGE], order, value, (*want, "POS")))

    in_series = Window.partitionBy(*series)
    earlier = in_series.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*series, _RANGE)
        .agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.max_by(value, "POS").alias("_last"))
        .withColumn("_ranges", F.count("*").over(in_series))
        .filter(F.col("_ranges") > 1)
        .select(
            *series,
            _RANGE,
            F.sum("_n").over(earlier).alias("_n0"),
            F.sum("_s").over(earlier).alias("_s0"),
            F.lag("_last").over(in_series.orderBy(_RANGE)).alias("_last0"),
        )
    )
    first = F.col("POS") == 0
    carried = {
        "POS": F.col("POS") + F.coalesce("_n0", F.lit(0)),
        "ACUM": F.when(F.col("_s0").isNull(), F.col("ACUM")).otherwise(F.coalesce("ACUM", F.lit(0)) + F.col("_s0")),
        "ANTERIOR": F.when(first, F.col("_last0")).otherwise(F.col("ANTERIOR")),
    }
    return local.join(F.broadcast(carry), [*series, _RANGE], "left").select(
        *df.columns, *[carried[c].alias(c) for c in WANT if c in want]
    )


def scan(
    df: DataFrame, series: list[str], order: list[Column], value: str, bounded: bool, want: tuple = WANT
) -> DataFrame:
    return (bounded_scan if bounded else ranged_scan)(df, series, order, value, want)
