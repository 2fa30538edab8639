"""Partial states of the fact by year, from which the derived tables and checks follow.

The state has one row per year, branch, supplier and names: counts, sum, exact sum of squares, lowest and highest amount.
States of different years are disjoint and everything here merges by addition, so a refresh computes the states of the
years that came in and keeps the others; the fact of earlier years is not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.numeric import half_even, without_nulls
from procura.operators import summary
from procura.schema import FACT_KEY, ID_COLUMNS
from procura.sources.tables import dealt, dealt_by_rows, tasks_by_key

_COUNTS = ["LINHAS", "NULOS", "NEGATIVOS", "REPETIDAS", "REPETIDAS_PLANILHA"]


def state(fact: DataFrame, rows: int = 0) -> DataFrame:
    """One pass over the fact. Null keys form groups, so nothing is lost. rows: how many there are at most; up to MANY_ROWS are
    combined before the shuffle, more are dealt by group in tasks of about TASK_ROWS, for few of them share a group."""
    value = F.col("VALOR")
    # without the buyer, who follows the supplier: a constant among the keys would be left out of the groups, not of the deal
    return dealt_by_rows(fact, rows, *ID_COLUMNS[:-1]).groupBy(*ID_COLUMNS).agg(
        F.count("*").alias("N"),
        F.count(value).alias("N_VALOR"),
        F.sum(value).alias("SOMA"),
        F.sum((value * value).cast("decimal(38,4)")).alias("QUADRADOS"),
        F.min(value).alias("MENOR"),
        F.max(value).alias("MAIOR"),
    )


def line_counts(wide: DataFrame, fact: DataFrame) -> DataFrame:
    """Per year: rows of the fact, without amount, below zero, beyond the first of their key, and rows of the sheets
    beyond the first of their supplier and branch. Null keys compare equal."""
    value = F.col("VALOR")
    keys = fact.groupBy(*FACT_KEY).agg(F.count("*").alias("n"), F.count_if(value.isNull()).alias("nulls"), F.count_if(value < 0).alias("below"))
    sheet_keys = wide.groupBy("ANO", "FILIAL", "CODFORNEC").agg((F.count("*") - 1).alias("extra"))
    zero = F.lit(0).cast("long")
    rows = keys.select("ANO", F.col("n").alias("LINHAS"), F.col("nulls").alias("NULOS"), F.col("below").alias("NEGATIVOS"),
                       (F.col("n") - 1).alias("REPETIDAS"), zero.alias("REPETIDAS_PLANILHA"))
    rows = rows.unionByName(sheet_keys.select("ANO", *[zero.alias(c) for c in _COUNTS[:-1]], F.col("extra").alias("REPETIDAS_PLANILHA")))
    return rows.groupBy("ANO").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def total_counts(counts: DataFrame) -> DataFrame:
    """line_counts of all years as one row."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS])


def consolidate(states: DataFrame) -> DataFrame:
    """summary.consolidate from states.

    The deviation comes from exact decimal sums about the rounded mean, so large equal amounts have deviation 0.
    """
    about = F.col("_c")
    around = F.col("QUADRADOS") - 2 * about * F.col("SOMA") + F.col("N_VALOR").cast("decimal(10,0)") * (about * about)
    shift = (F.col("SOMA") - F.col("N_VALOR").cast("decimal(10,0)") * about).cast("double")
    n = F.col("N_VALOR").cast("double")
    variance = F.when(n > 1, F.greatest((around.cast("double") - shift * shift / n) / (n - 1), F.lit(0.0)))
    rows = without_nulls(states, *ID_COLUMNS).withColumn("_c", F.when(F.col("N_VALOR") > 0, F.col("SOMA") / F.col("N_VALOR")).cast("decimal(18,2)"))
    return rows.select(
        *ID_COLUMNS,
        half_even(F.coalesce(F.col("SOMA").cast("double"), F.lit(0.0))).alias("TOTAL_TRI"),
        half_even(F.try_divide(F.col("SOMA").cast("double"), n)).alias("MEDIA_MENSAL"),
        half_even(F.coalesce(F.sqrt(variance), F.lit(0.0))).alias("DESVIO"),
        half_even(F.col("MENOR")).alias("MIN_MES"),
        half_even(F.col("MAIOR")).alias("MAX_MES"),
        (F.coalesce(F.col("SOMA"), F.lit(0)) == 0).alias("INATIVO_TRIMESTRE"),
    )


def supplier_dim(states: DataFrame) -> DataFrame:
    """summary.supplier_dim from states, which are read from storage."""
    rows = without_nulls(states, "CODFORNEC")
    rows = dealt(rows, tasks_by_key(rows.select("CODFORNEC"), rows.count()), "CODFORNEC")  # one shuffle for all groups
    names = rows.groupBy("CODFORNEC", "FORNECEDOR", "FANTASIA").agg(F.sum("N").alias("n"))
    return summary.most_frequent_names(names)


def annual_comparison(states: DataFrame, year_a: int, year_b: int, years: list[int] | None = None) -> DataFrame:
    """summary.annual_comparison from states: sums of sums."""
    return summary.annual_comparison(states.select("ANO", "CODFORNEC", F.col("SOMA").alias("VALOR")), year_a, year_b, years)
