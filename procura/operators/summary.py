"""Aggregations over the fact: consolidation, dimension, comparison, indicators, seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.functions.labels import branch_label, month_label
from procura.functions.numeric import grouped, half_even, mean, ratio_or, sample_std, total, without_nulls
from procura.functions.text import first_two_words
from procura.operators.joins import join_per_key
from procura.schema import (
    BLANK_NAMES,
    ID_COLUMNS,
    STABLE_PCT,
    STATUS_DOWN,
    STATUS_LOST,
    STATUS_NEW,
    STATUS_STABLE,
    STATUS_UNDEFINED,
    STATUS_UP,
)


def consolidate(fact: DataFrame) -> DataFrame:
    """Total, mean, deviation, lowest and highest month per year, branch and supplier."""
    return grouped(fact, *ID_COLUMNS).agg(
        half_even(total()).alias("TOTAL_TRI"),
        half_even(mean()).alias("MEDIA_MENSAL"),
        half_even(sample_std()).alias("DESVIO"),
        half_even(F.min("VALOR")).alias("MIN_MES"),
        half_even(F.max("VALOR")).alias("MAX_MES"),
        (F.coalesce(F.sum("VALOR"), F.lit(0)) == 0).alias("INATIVO_TRIMESTRE"),
    )


def supplier_dim(fact: DataFrame) -> DataFrame:
    """One row per supplier with its most frequent names; the smallest name wins a tie.

    Counts per (supplier, names) come first, so the second step sees one row per spelling.
    """
    return most_frequent_names(
        without_nulls(fact, "CODFORNEC").groupBy("CODFORNEC", "FORNECEDOR", "FANTASIA").agg(F.count("*").alias("n"))
    )


def most_frequent_names(spellings: DataFrame) -> DataFrame:
    """The dimension from (CODFORNEC, FORNECEDOR, FANTASIA, n)."""
    by_name = spellings.select(
        "CODFORNEC",
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("F").alias("field"), F.col("FORNECEDOR").alias("name")),
                F.struct(F.lit("T").alias("field"), F.col("FANTASIA").alias("name")),
            )
        ),
    )
    counted = by_name.groupBy("CODFORNEC", "field", "name").agg(F.sum("n").alias("n"))

    def most_frequent(field: str) -> Column:
        wanted = (F.col("field") == field) & F.col("name").isNotNull()
        best = F.min(F.when(wanted, F.struct((-F.col("n")).alias("rank"), F.col("name").alias("name"))))
        return F.coalesce(best["name"], F.lit(""))

    dim = counted.groupBy("CODFORNEC").agg(
        most_frequent("F").alias("FORNECEDOR"),
        most_frequent("T").alias("FANTASIA"),
        F.sum(F.when(F.col("field") == "F", F.col("n"))).alias("N_REGISTROS"),
    )
    blank = F.col("FANTASIA").isin(BLANK_NAMES)
    return dim.withColumn("FANTASIA", F.when(blank, first_two_words(F.col("FORNECEDOR"))).otherwise(F.col("FANTASIA")))


def with_names(df: DataFrame, dim: DataFrame, *names: str) -> DataFrame:
    """Inner join with the supplier dimension. Spark broadcasts it only while it is small."""
    return df.join(dim.select("CODFORNEC", *(names or ("FANTASIA",))), "CODFORNEC")


def canonical_names(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """The fact under the names of the dimension, which counts the rows of each supplier."""
    names = dim.select("CODFORNEC", "FANTASIA", "FORNECEDOR", "N_REGISTROS")
    return join_per_key(fact.drop("FANTASIA", "FORNECEDOR"), names, "CODFORNEC", "N_REGISTROS")


def status(old: Column, new: Column, pct: Column) -> Column:
    return (
        F.when((old == 0) & (new > 0), STATUS_NEW)
        .when((new == 0) & (old > 0), STATUS_LOST)
        .when(pct.isNull(), STATUS_UNDEFINED)
        .when(F.abs(pct) < STABLE_PCT, STATUS_STABLE)
        .when(pct > 0, STATUS_UP)
        .otherwise(STATUS_DOWN)
    )


def annual_comparison(fact: DataFrame, year_a: int, year_b: int, years: list[int] | None = None) -> DataFrame:
    """Totals per supplier and year with VAR_ABS, VAR_PCT and STATUS between two years.

    One conditional aggregation; suppliers without rows in either year are kept with zeros.
    """
    years = years or [year_a, year_b]

    def of_year(year: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ANO") == year, F.col("VALOR"))).cast("double"), F.lit(0.0))

    sums = grouped(without_nulls(fact, "ANO"), "CODFORNEC").agg(*[of_year(y).alias(f"TOTAL_{y}") for y in years])
    old, new = F.col(f"TOTAL_{year_a}"), F.col(f"TOTAL_{year_b}")
    pct = F.when(old > 0, (F.try_divide(new, old) - 1) * 100)
    return sums.select(
        "CODFORNEC",
        *[half_even(F.col(f"TOTAL_{y}")).alias(f"TOTAL_{y}") for y in years],
        half_even(new - old).alias("VAR_ABS"),
        half_even(pct).alias("VAR_PCT"),
        status(old, new, pct).alias("STATUS"),
    )


def year_stats(fact: DataFrame, dim: DataFrame, year: int) -> DataFrame:
    """Mean, total and deviation per supplier in one year, with names."""
    stats = grouped(fact.filter(F.col("ANO") == year), "CODFORNEC").agg(
        half_even(mean()).alias("MEDIA_MENSAL"),
        half_even(total()).alias("TOTAL"),
        # one row has no deviation here: it stays null
        half_even(F.stddev_samp(F.col("VALOR").cast("double"))).alias("DESVIO"),
    )
    return with_names(stats, dim)


def kpis(fact: DataFrame) -> DataFrame:
    """Total, distinct suppliers, mean of supplier totals, mean of (year, month, branch) totals.

    A mean of group totals is the total over the number of groups, so one pass is enough.
    """
    have_supplier = F.col("CODFORNEC").isNotNull()
    have_cell = F.col("ANO").isNotNull() & F.col("MES").isNotNull() & F.col("FILIAL").isNotNull()
    sums = fact.agg(
        total().alias("TOTAL_GERAL"),
        F.count_distinct("CODFORNEC").alias("N_FORNECEDORES"),
        F.sum(F.when(have_supplier, F.col("VALOR"))).cast("double").alias("_by_supplier"),
        F.count_distinct(F.when(have_cell, F.struct("ANO", "MES", "FILIAL"))).alias("_cells"),
        F.sum(F.when(have_cell, F.col("VALOR"))).cast("double").alias("_by_cell"),
    )
    return sums.select(
        "TOTAL_GERAL",
        "N_FORNECEDORES",
        F.try_divide("_by_supplier", F.col("N_FORNECEDORES").cast("double")).alias("MEDIA_FORNECEDOR"),
        F.try_divide("_by_cell", F.col("_cells").cast("double")).alias("TICKET_MEDIO"),
    )


def yoy_headline(fact: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """Change of the grand total between two years and its direction."""
    sums = fact.filter(F.col("ANO").isin(year_a, year_b)).agg(
        F.coalesce(F.sum(F.when(F.col("ANO") == year_a, F.col("VALOR"))).cast("double"), F.lit(0.0)).alias("TOTAL_A"),
        F.coalesce(F.sum(F.when(F.col("ANO") == year_b, F.col("VALOR"))).cast("double"), F.lit(0.0)).alias("TOTAL_B"),
    )
    pct = F.when(F.col("TOTAL_A") != 0, (F.try_divide("TOTAL_B", "TOTAL_A") - 1) * 100)
    return sums.select(
        "TOTAL_A",
        "TOTAL_B",
        half_even(pct).alias("VAR_PCT"),
        F.when(pct >= 0, "up").when(pct < 0, "down").otherwise("neutral").alias("DIRECAO"),
        F.when(pct.isNotNull(), F.concat(F.format_string("%+.1f", pct), F.lit(f"% vs {year_a}"))).alias("TEXTO"),
    )


def sums_by(fact: DataFrame, *keys: str) -> DataFrame:
    """Sum of VALOR by keys, with display labels for branch and month keys."""
    out = grouped(fact, *keys).agg(total().alias("VALOR"))
    if "FILIAL" in keys:
        out = out.withColumn("FILIAL_LBL", branch_label(F.col("FILIAL")))
    if "MES_NUM" in keys:
        out = out.withColumn("MES_LBL", month_label(F.col("MES_NUM")))
    return out


def seasonality(fact: DataFrame) -> DataFrame:
    """Month total over the mean of the branch's months that have rows."""
    sums = grouped(fact, "FILIAL", "MES_NUM").agg(total().alias("VALOR"))
    branch = Window.partitionBy("FILIAL")  # at most 12 rows
    base = F.sum("VALOR").over(branch) / F.count("VALOR").over(branch)
    return sums.withColumn("INDICE", F.try_divide(F.col("VALOR"), base)).select(
        "FILIAL",
        branch_label(F.col("FILIAL")).alias("FILIAL_LBL"),
        "MES_NUM",
        month_label(F.col("MES_NUM")).alias("MES_LBL"),
        "VALOR",
        "INDICE",
    )


def first_names(fact: DataFrame) -> DataFrame:
    """The earliest non-null FANTASIA per supplier in the fact order."""
    moment = (
        F.col("ANO").cast("long") * F.lit(1 << 40) + F.col("FILIAL").cast("long") * F.lit(16) + F.col("MES_NUM")
    )
    spellings = grouped(fact.dropna(subset=["ANO", "FILIAL", "MES_NUM"]), "CODFORNEC", "FANTASIA").agg(F.min(moment).alias("moment"))
    return spellings.groupBy("CODFORNEC").agg(F.min(F.struct("moment", "FANTASIA"))["FANTASIA"].alias("FANTASIA"))


def supplier_features(fact: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """One row per supplier: volume, dispersion, growth and monthly seasonality.

    Month sums and counts are conditional aggregates of one pass. Names come from a second,
    narrow aggregate on the same key: string buffers would turn the wide one into a sort.
    """
    months = range(1, 13)
    month_means = {
        m: F.coalesce(
            F.try_divide(
                F.sum(F.when(F.col("MES_NUM") == m, F.col("VALOR"))).cast("double"),
                F.count(F.when(F.col("MES_NUM") == m, F.col("VALOR"))).cast("double"),
            ),
            F.lit(0.0),
        )
        for m in months
    }

    def of_year(year: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ANO") == year, F.col("VALOR"))).cast("double"), F.lit(0.0))

    base = grouped(fact, "CODFORNEC").agg(
        total().alias("TOTAL"),
        mean().alias("MEDIA"),
        sample_std().alias("DESVIO"),
        F.count_distinct("FILIAL").alias("N_FILIAIS"),
        F.count("*").alias("N_OBS"),
        of_year(year_a).alias("T_A"),
        of_year(year_b).alias("T_B"),
        # columns for months with no rows at all are absent from a pivot, so they do not count in its mean
        *[month_means[m].alias(f"_m{m}") for m in months],
    )
    in_use = fact.agg(*[F.max(F.col("MES_NUM") == m).alias(f"u{m}") for m in months])
    used = in_use.select(sum((F.coalesce(F.col(f"u{m}"), F.lit(False)).cast("int") for m in months), F.lit(0))).scalar()
    average = sum((F.col(f"_m{m}") for m in months), F.lit(0.0)) / used.cast("double")
    divisor = F.when(average == 0, F.lit(1.0)).otherwise(average)
    return (
        base.join(first_names(fact), "CODFORNEC", "left")
        .withColumn("_avg", divisor)
        .select(
            "CODFORNEC", "FANTASIA", "TOTAL", "MEDIA", "DESVIO", "N_FILIAIS", "N_OBS",
            ratio_or(F.col("DESVIO"), F.col("MEDIA"), 0.0).alias("CV"),
            F.col("T_A").alias(f"T{year_a}"),
            F.col("T_B").alias(f"T{year_b}"),
            F.when(F.col("T_A") > 0, F.try_divide("T_B", "T_A") - 1).otherwise(F.lit(0.0)).alias("GROWTH_YOY"),
            *[F.try_divide(F.col(f"_m{m}"), F.col("_avg")).alias(f"SAZ_M{m}") for m in months],
        )
    )
