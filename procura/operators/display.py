"""Tables as shown to a user: selected, renamed and formatted columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.functions.labels import branch_label, detector_label, fmt_brl, percent_label, period_label
from procura.functions.numeric import half_even


def _money(df: DataFrame, **columns: str) -> list:
    return [fmt_brl(F.col(c)).alias(name) for name, c in columns.items()]


def ranking_table(ranking: DataFrame) -> DataFrame:
    return ranking.select(
        "CODFORNEC", "FANTASIA",
        fmt_brl(F.col("TOTAL")).alias("TOTAL_BRL"),
        fmt_brl(half_even(F.col("MEDIA_MENSAL"))).alias("MEDIA_BRL"),
        fmt_brl(half_even(F.col("DESVIO"))).alias("DESVIO_BRL"),
        percent_label(F.col("CV_PCT"), 1).alias("CV_TEXTO"),
        F.col("N_REGISTROS").alias("N_LINHAS"),
    )


def abc_table(curve: DataFrame) -> DataFrame:
    return curve.select(
        "CODFORNEC", "FANTASIA",
        fmt_brl(F.col("VALOR")).alias("VALOR_BRL"),
        percent_label(F.col("PARTICIPACAO_PCT"), 2).alias("PARTE_TEXTO"),
        percent_label(F.col("ACUM_PCT"), 2).alias("SOMA_TEXTO"),
        "CLASSE",
    )


def comparison_table(comparison: DataFrame, dim: DataFrame, year_a: int, year_b: int, suppliers: list[int] = ()) -> DataFrame:
    """Sorted by VAR_ABS; only the supplier filter applies."""
    view = comparison.join(dim.select("CODFORNEC", "FANTASIA"), "CODFORNEC")
    if suppliers:
        view = view.filter(F.col("CODFORNEC").isin(list(suppliers)))
    return view.orderBy("VAR_ABS", "CODFORNEC").select(
        "CODFORNEC", "FANTASIA",
        fmt_brl(F.col(f"TOTAL_{year_a}")).alias(f"BRL_{year_a}"),
        fmt_brl(F.col(f"TOTAL_{year_b}")).alias(f"BRL_{year_b}"),
        fmt_brl(F.col("VAR_ABS")).alias("DIF_BRL"),
        percent_label(F.col("VAR_PCT"), 2).alias("DIF_TEXTO"),
        "STATUS",
    )


def forecast_table(forecast: DataFrame) -> DataFrame:
    """Money columns that are absent (no forest has run) are left out."""
    shown = ["naive", "media", "tendencia", "ensemble", "ic_inf", "ic_sup", "RF_PREDICAO", "PREDICAO_FINAL"]
    money = [fmt_brl(half_even(F.col(c))).alias(f"{c.upper()}_BRL") for c in shown if c in forecast.columns]
    return forecast.select(branch_label(F.col("FILIAL")).alias("FILIAL_LBL"), "CODFORNEC", "FANTASIA", *money)


def cluster_table(clustered: DataFrame) -> DataFrame:
    """Members by cluster, largest total first."""
    return clustered.orderBy("CLUSTER", F.desc("TOTAL"), "CODFORNEC").select(
        "CLUSTER", "CLUSTER_ROTULO", "CODFORNEC", "FANTASIA",
        fmt_brl(F.col("TOTAL")).alias("TOTAL_BRL"),
        fmt_brl(F.col("MEDIA")).alias("MEDIA_BRL"),
        half_even(F.col("CV")).alias("CV"),
        percent_label(F.col("GROWTH_YOY") * 100, 1).alias("CRESC_TEXTO"),
    )


def anomaly_table(top: DataFrame) -> DataFrame:
    """Top rows with period and the detector that found them."""
    by_forest = F.col("ANOMALIA_ISO") if "ANOMALIA_ISO" in top.columns else F.lit(False)
    return top.select(
        branch_label(F.col("FILIAL")).alias("FILIAL_LBL"),
        period_label(F.col("DATA")).alias("PERIODO"),
        "CODFORNEC", "FANTASIA",
        fmt_brl(F.col("VALOR")).alias("VALOR_BRL"),
        fmt_brl(half_even(F.col("MEDIA_FORN"))).alias("MEDIA_BRL"),
        half_even(F.col("Z_SCORE")).alias("Z"),
        detector_label(F.col("ANOMALIA_Z"), by_forest).alias("DETECTOR"),
    )


def concentration_table(measures: DataFrame) -> DataFrame:
    return measures.select(
        "ESCOPO", "CHAVE",
        fmt_brl(F.col("TOTAL")).alias("TOTAL_BRL"),
        "N_FORNECEDORES",
        percent_label(F.col("TOP5_PCT"), 1).alias("TOP5_TEXTO"),
        percent_label(F.col("TOP10_PCT"), 1).alias("TOP10_TEXTO"),
        F.rint("HHI").cast("long").alias("HHI"),
        half_even(F.col("GINI"), 3).alias("GINI"),
        percent_label(F.col("CRESC_MEDIO_MOM_PCT"), 2).alias("CRESC_TEXTO"),
    )
