"""Rankings and top-k. Every order ends in the key, so ties are decided the same way each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions.numeric import grouped, mean, ratio_or, sample_std, total
from procura.operators.summary import with_names
from procura.schema import OTHERS


def top_suppliers(fact: DataFrame, dim: DataFrame, n: int = 10) -> DataFrame:
    sums = grouped(fact, "CODFORNEC").agg(total().alias("VALOR"))
    return with_names(_first(sums, n, F.desc("VALOR"), F.asc("CODFORNEC")), dim)


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their POSICAO from 1; only these n rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn("POSICAO", F.row_number().over(Window.orderBy(*order)))


def supplier_ranking(fact: DataFrame) -> DataFrame:
    stats = grouped(fact, "CODFORNEC", "FANTASIA").agg(
        total().alias("TOTAL"),
        mean().alias("MEDIA_MENSAL"),
        sample_std().alias("DESVIO"),
        F.count("*").alias("N_REGISTROS"),
    )
    cv = ratio_or(F.col("DESVIO"), F.col("MEDIA_MENSAL"), 0.0) * 100
    return stats.withColumn("CV_PCT", cv)


def top_n(ranking: DataFrame, n: int) -> DataFrame:
    return ranking.orderBy(F.desc("TOTAL"), "CODFORNEC", "FANTASIA").limit(n)


def top_n_total(fact: DataFrame, n: int) -> DataFrame:
    """How many suppliers are shown, of how many, and their total."""
    sums = grouped(fact, "CODFORNEC", "FANTASIA").agg(F.sum("VALOR").alias("TOTAL"))
    shown = top_n(sums, n).agg(F.count("*").alias("EXIBIDOS"), F.sum("TOTAL").cast("double").alias("TOTAL"))
    return shown.withColumn("DE", sums.agg(F.count("*")).scalar()).select("EXIBIDOS", "DE", "TOTAL")


def extremes(comparison: DataFrame, dim: DataFrame, n: int = 5, falls: bool = False) -> DataFrame:
    """The n largest rises (or falls) in VAR_ABS, with names."""
    order = F.asc("VAR_ABS") if falls else F.desc("VAR_ABS")
    return with_names(_first(comparison, n, order, F.asc("CODFORNEC")), dim)


def branch_composition(fact: DataFrame, n: int = 10) -> DataFrame:
    """Branch totals of the n largest names; all other names form one group."""
    sums = grouped(fact, "FILIAL", "FANTASIA").agg(F.sum("VALOR").alias("VALOR"))
    top = sums.groupBy("FANTASIA").agg(F.sum("VALOR").alias("t")).orderBy(F.desc("t"), "FANTASIA").limit(n)
    marked = sums.join(F.broadcast(top.select("FANTASIA", F.lit(True).alias("top"))), "FANTASIA", "left")
    group = F.when(F.col("top"), F.col("FANTASIA")).otherwise(OTHERS)
    return (
        marked.groupBy(F.concat(F.lit("Filial "), F.col("FILIAL").cast("string")).alias("FILIAL_LBL"), group.alias("GRUPO"))
        .agg(total().alias("VALOR"))
    )


def top_series(fact: DataFrame, n: int = 8) -> DataFrame:
    """Monthly series of the n largest suppliers."""
    sums = grouped(fact, "CODFORNEC").agg(F.sum("VALOR").alias("t"))
    top = sums.orderBy(F.desc("t"), "CODFORNEC").limit(n).select("CODFORNEC")
    rows = fact.join(F.broadcast(top), "CODFORNEC", "left_semi")
    return grouped(rows, "DATA", "FANTASIA").agg(total().alias("VALOR"))
