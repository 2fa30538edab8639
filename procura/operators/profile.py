"""Table profile: columns, types, row and null counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column (COLUNA, TIPO, N_LINHAS, N_NULOS), from a single pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(c).alias("COLUNA"),
            F.lit(t).alias("TIPO"),
            F.col("n").alias("N_LINHAS"),
            (F.col("n") - F.col(f"c{i}")).alias("N_NULOS"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def head(df: DataFrame, n: int = 8) -> DataFrame:
    return df.limit(n)
