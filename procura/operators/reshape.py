"""Wide to long, and pivots with a fixed list of output columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.labels import month_number
from procura.functions.numeric import coerce_number, grouped, half_even, to_amount
from procura.schema import FACT_COLUMNS, ID_COLUMNS, MONTHS


def unpivot_months(wide: DataFrame) -> DataFrame:
    """One row per sheet row and month with a numeric VALOR; rows without a number are dropped."""
    long = wide.unpivot(ID_COLUMNS, MONTHS, "MES", "VALOR")
    return (
        long.withColumn("MES_NUM", month_number(F.col("MES")))
        .withColumn("VALOR", coerce_number(F.col("VALOR").cast("string")))
        .dropna(subset=["VALOR"])
    )


def drop_empty_months(long: DataFrame) -> DataFrame:
    """Drop every (ANO, MES) whose grand total is not positive: the month has not happened yet.

    The list of such months is at most 12 per year, so it is broadcast.
    """
    empty = grouped(long, "ANO", "MES").agg(F.sum(F.col("VALOR").cast("decimal(38,6)")).alias("_total")).filter(F.col("_total") <= 0)
    return long.join(F.broadcast(empty.select("ANO", "MES")), ["ANO", "MES"], "left_anti")


def to_fact(wide: DataFrame) -> DataFrame:
    """Wide table to the long fact."""
    long = drop_empty_months(unpivot_months(wide))
    return (
        long.withColumn("VALOR", to_amount(F.col("VALOR")))
        .withColumn("DATA", F.make_date("ANO", "MES_NUM", F.lit(1)))
        .select(*FACT_COLUMNS)
    )


def pivot_supplier_year(fact: DataFrame, years: list[int]) -> DataFrame:
    """CODFORNEC by year, TOTAL_<year>, 0 where a supplier has no rows."""
    sums = grouped(fact, "CODFORNEC").pivot("ANO", years).agg(F.sum("VALOR"))
    return sums.select(
        "CODFORNEC", *[F.coalesce(F.col(str(y)).cast("double"), F.lit(0.0)).alias(f"TOTAL_{y}") for y in years]
    )


def pivot_year_branch(fact: DataFrame, branches: list[int]) -> DataFrame:
    """Year by branch, FILIAL_<n>, null where there is nothing."""
    sums = grouped(fact, "ANO").pivot("FILIAL", branches).agg(F.sum("VALOR"))
    return sums.select("ANO", *[half_even(F.col(str(b))).alias(f"FILIAL_{b}") for b in branches])


def pivot_branch_month(fact: DataFrame) -> DataFrame:
    """Branch by month, sums under the month names."""
    sums = grouped(fact, "FILIAL").pivot("MES", MONTHS).agg(F.sum("VALOR"))
    return sums.select("FILIAL", *[F.col(m).cast("double").alias(m) for m in MONTHS])
