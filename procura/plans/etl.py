"""Sheets to fact and its derived tables, checked and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.operators import partials, quality, reshape, summary
from procura.sources import sheets
from procura.sources.tables import drop_durable, durable, in_fact_order, write_fact, write_tables, write_text
from procura.sources.versions import Version


def build_tables(wide: DataFrame, year_a: int, year_b: int) -> dict[str, DataFrame]:
    """Fact, consolidation, comparison, dimension and findings. The fact is staged once."""
    fact = durable(reshape.to_fact(wide))
    return {"fato": fact, **derived_tables(fact, year_a, year_b), "validacoes": quality.check(wide, fact)}


def derived_tables(fact: DataFrame, year_a: int, year_b: int) -> dict[str, DataFrame]:
    return {
        "cons": summary.consolidate(fact),
        "comp": summary.annual_comparison(fact, year_a, year_b),
        "dim": summary.supplier_dim(fact),
    }


def main(
    spark: SparkSession,
    workbooks: dict[int, str],
    staging: str,
    outputs: str,
    year_a: int,
    year_b: int,
    refresh: bool = False,
    plain: bool = True,
    publish_failed: bool = False,
) -> int:
    """Run the whole load; 1 if any check failed. refresh replaces only the years that came in; the derived tables and
    the checks follow the partial states of all years, and only the new years are read for it.

    Fact, states and derived tables are published as one version after the checks: a load that fails, or whose checks
    fail, leaves what was published (publish_failed shows it all the same). plain: the four tables are copied to plain
    folders too, for readers that know nothing of versions. The sheets are scanned once, into a staged table; a branch
    that contradicts its sheet fails there, before any output is written.
    """
    wide = durable(sheets.scan_workbooks(spark, workbooks))
    version = Version(spark, staging)
    new = version.write("fato_compras", in_fact_order(reshape.to_fact(wide)), by_year=True, carry=refresh)
    new_states = version.write("estado_compras", partials.state(new, new.count()), by_year=True, carry=refresh)
    version.write("estado_linhas", partials.line_counts(wide, new), by_year=True, carry=refresh)
    version.write("consolidado_trimestre", partials.consolidate(new_states), by_year=True, carry=refresh)
    states, counts = version.read("estado_compras"), version.read("estado_linhas")
    version.write("comparativo_anual", partials.annual_comparison(states, year_a, year_b))
    version.write("dim_fornecedor", partials.supplier_dim(states))
    findings = durable(quality.findings_of(counts))
    report = quality.report_of(states, counts, year_a, year_b, findings)
    write_text(
        report.withColumn("LINHA", F.concat_ws(": ", "SECAO", "ITEM", "VALOR")), f"{outputs}/qa_report", ["SECAO", "ITEM"]
    )
    status = quality.exit_status(findings)
    if status == 0 or publish_failed:
        version.publish()
        if plain:
            write_fact(new, f"{staging}/fato_compras.parquet", refresh)
            write_tables({name: version.read(name) for name in ("consolidado_trimestre", "comparativo_anual", "dim_fornecedor")}, staging)
    drop_durable(wide, findings)
    return status
