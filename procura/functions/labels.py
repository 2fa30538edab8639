"""Labels and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.functions.numeric import half_even
from procura.schema import GINI_HIGH, HHI_HIGH, HHI_MODERATE, MONTH_LABELS, MONTHS


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def month_name(number: Column) -> Column:
    return F.try_element_at(_strings(MONTHS), number.cast("int"))


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(_strings(MONTHS), name), F.lit(0)).cast("int")


def month_label(number: Column) -> Column:
    return F.try_element_at(_strings(MONTH_LABELS), number.cast("int"))


def branch_label(branch: Column) -> Column:
    return F.concat(F.lit("Filial "), branch.cast("string"))


def period_label(date: Column) -> Column:
    return F.date_format(date, "MMM/yyyy")


def target_label(year: Column, month: Column) -> Column:
    return F.concat(month_label(month), F.lit("/"), year.cast("string"))


def percent_label(x: Column, digits: int = 1) -> Column:
    """Rounded number with one trailing zero at most, then '%'; 'nan%' for null."""
    number = half_even(x, digits).cast("decimal(38,2)").cast("string")
    return F.concat(F.coalesce(F.regexp_replace(number, r"(\.\d)0$", "$1"), F.lit("nan")), F.lit("%"))


def fmt_brl(x: Column) -> Column:
    money = F.concat(F.lit("R$ "), F.translate(F.format_number(x.cast("double"), 2), ",.", ".,"))
    return F.coalesce(money, F.lit("—"))


def fmt_brl_compact(x: Column) -> Column:
    x = x.cast("double")

    def scaled(unit: float, digits: int, suffix: str) -> Column:
        number = F.translate(F.format_number(x / F.lit(unit), digits), ".", ",")
        return F.concat(F.lit("R$ "), number, F.lit(suffix))

    return (
        F.when(F.abs(x) >= 1e6, scaled(1e6, 2, " mi"))
        .when(F.abs(x) >= 1e3, scaled(1e3, 1, " mil"))
        .otherwise(fmt_brl(x))
    )


def hhi_band(hhi: Column) -> Column:
    return F.when(hhi > HHI_HIGH, "alto").when(hhi > HHI_MODERATE, "moderado").otherwise("baixo")


def gini_band(gini: Column) -> Column:
    return F.when(gini > GINI_HIGH, "alta").otherwise("moderada")


def detector_label(by_z: Column, by_forest: Column) -> Column:
    return F.when(by_z & by_forest, "Z+ISO").when(by_z, "Z").when(by_forest, "ISO").otherwise("")
