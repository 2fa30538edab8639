"""The written tables as one bundle, and the exports a user takes from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procura.operators.selection import filter_fact
from procura.operators.summary import canonical_names
from procura.sources.tables import optional_table, read_table, write_csv

REQUIRED = {
    "fato": "fato_compras", "cons": "consolidado_trimestre", "comp": "comparativo_anual", "dim": "dim_fornecedor",
}
OPTIONAL = {
    "forecast": "forecast", "forecast_total": "forecast_total", "clusters": "clusters", "anomalias": "anomalias",
    "metricas": "metricas_avancadas",
}


def load(spark: SparkSession, staging: str) -> dict[str, DataFrame | None]:
    """Lazy tables by short name. Analytics tables that were not written are None."""
    tables: dict[str, DataFrame | None] = {k: read_table(spark, staging, name) for k, name in REQUIRED.items()}
    tables.update({k: optional_table(spark, staging, name) for k, name in OPTIONAL.items()})
    return tables


def has_analytics(tables: dict[str, DataFrame | None]) -> bool:
    return all(tables.get(k) is not None for k in OPTIONAL)


def named_fact(tables: dict[str, DataFrame | None]) -> DataFrame:
    """The fact under the names of the supplier dimension."""
    return canonical_names(tables["fato"], tables["dim"])


def export_filtered(tables: dict[str, DataFrame | None], path: str, **filters: list) -> None:
    """Filtered fact as CSV; filters as for filter_fact."""
    write_csv(filter_fact(named_fact(tables), **filters), path)
