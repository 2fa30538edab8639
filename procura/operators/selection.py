"""Filters and the lists a user picks from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.labels import month_label, month_name
from procura.functions.numeric import grouped, total
from procura.schema import STATUS_LOST, STATUS_NEW


def filter_fact(
    fact: DataFrame,
    years: list[int],
    branches: list[int],
    buyers: list[str],
    months: list[str],
    suppliers: list[int] = (),
) -> DataFrame:
    """Rows in all lists. An empty supplier list means all; any other empty list means no rows.

    The predicates are plain IN lists: the year prunes folders, the others reach the Parquet scan.
    """
    chosen = fact
    for column, values in (("ANO", years), ("FILIAL", branches), ("CODCOMPRADOR", buyers), ("MES", months)):
        chosen = chosen.filter(F.col(column).isin(list(values)) if values else F.lit(False))
    return chosen.filter(F.col("CODFORNEC").isin(list(suppliers))) if suppliers else chosen


def filter_options(fact: DataFrame) -> DataFrame:
    """Distinct years, branches and buyers as (FILTRO, OPCAO)."""
    parts = [
        fact.select(F.lit(c).alias("FILTRO"), F.col(c).cast("string").alias("OPCAO")).dropna().distinct()
        for c in ("ANO", "FILIAL", "CODCOMPRADOR")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("FILTRO", "OPCAO")


def supplier_labels(dim: DataFrame) -> DataFrame:
    """Picker labels: name, two spaces, dot, two spaces, code."""
    label = F.concat(F.col("FANTASIA"), F.lit("  ·  "), F.col("CODFORNEC").cast("string"))
    return dim.select("CODFORNEC", label.alias("LABEL"))


def chosen_suppliers(dim: DataFrame, labels: list[str]) -> DataFrame:
    return supplier_labels(dim).filter(F.col("LABEL").isin(list(labels))).select("CODFORNEC")


def calendar_activity(fact: DataFrame) -> DataFrame:
    """The twelve months with their label and whether any row falls in them."""
    months = fact.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("MES_NUM"))
    active = fact.select("MES_NUM").distinct().withColumn("ATIVO", F.lit(True))
    return months.join(active, "MES_NUM", "left").select(
        "MES_NUM",
        month_name(F.col("MES_NUM")).alias("MES"),
        month_label(F.col("MES_NUM")).alias("MES_LBL"),
        F.coalesce("ATIVO", F.lit(False)).alias("ATIVO"),
    )


def activity_by_year(fact: DataFrame) -> DataFrame:
    """Every year of the fact with its twelve months: rows, total, and whether any row falls in the month."""
    sums = grouped(fact, "ANO", "MES_NUM").agg(F.count("*").alias("N"), total().alias("VALOR"))
    months = sums.select("ANO").distinct().select("ANO", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("MES_NUM"))
    return months.join(sums, ["ANO", "MES_NUM"], "left").select(
        "ANO",
        "MES_NUM",
        month_label(F.col("MES_NUM")).alias("MES_LBL"),
        F.coalesce("N", F.lit(0)).alias("N"),
        F.coalesce("VALOR", F.lit(0.0)).alias("VALOR"),
        F.col("N").isNotNull().alias("ATIVO"),
    )


def new_and_lost(comparison: DataFrame) -> DataFrame:
    return comparison.filter(F.col("STATUS").isin(STATUS_NEW, STATUS_LOST)).select("CODFORNEC", "STATUS")
