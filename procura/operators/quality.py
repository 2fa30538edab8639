"""Data checks on the fact and the wide table, and the quality report."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions.numeric import grouped, half_even
from procura.operators import partials
from procura.schema import ID_COLUMNS, STATUS_LOST, STATUS_NEW
from procura.sources.tables import durable


def check(wide: DataFrame, fact: DataFrame) -> DataFrame:
    """Findings (ORDEM, NIVEL, N, MENSAGEM); a single OK row when nothing is wrong."""
    return findings_of(partials.line_counts(wide, fact))


def findings_of(counts: DataFrame) -> DataFrame:
    """Findings from the counts per year."""
    listed = F.array(
        _finding(1, F.col("NULOS"), "linhas sem valor"),
        _finding(2, F.col("NEGATIVOS"), "linhas com valor abaixo de zero"),
        _finding(3, F.col("REPETIDAS"), "linhas a mais por chave do fato"),
        _finding(4, F.col("REPETIDAS_PLANILHA"), "linhas a mais por fornecedor e filial"),
    )
    passed = F.struct(
        F.lit(0).alias("ORDEM"),
        F.lit("OK").alias("NIVEL"),
        F.lit(0).cast("long").alias("N"),
        F.lit("nada a corrigir").alias("MENSAGEM"),
    )
    faults = partials.total_counts(counts).select(F.filter(listed, lambda r: r["N"] > 0).alias("f"))
    return faults.select(F.inline(F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(passed))))


def _finding(order: int, n: Column, text: str) -> Column:
    n = n.cast("long")
    return F.struct(
        F.lit(order).alias("ORDEM"),
        F.lit("ERRO").alias("NIVEL"),
        n.alias("N"),
        F.concat(n.cast("string"), F.lit(f" {text}")).alias("MENSAGEM"),
    )


def exit_status(findings: DataFrame) -> int:
    return 0 if findings.filter(F.col("NIVEL") == "ERRO").isEmpty() else 1


def report(wide: DataFrame, fact: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """Quality report as rows (SECAO, ITEM, VALOR text). The fact is scanned twice: for its state and for its keys."""
    states, counts = durable(partials.state(fact)), durable(partials.line_counts(wide, fact))
    return report_of(states, counts, year_a, year_b)


def report_of(states: DataFrame, counts: DataFrame, year_a: int, year_b: int, findings: DataFrame | None = None) -> DataFrame:
    """The report from partial states alone. findings: those of findings_of() if they are known already."""

    def rows(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("SECAO"), item.cast("string").alias("ITEM"), value.cast("string").alias("VALOR"))

    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ID_COLUMNS])
    sizes = states.agg(
        F.coalesce(F.sum("N"), F.lit(0)).alias("linhas_fato"),
        F.count_distinct("CODFORNEC").alias("fornecedores"),
        F.count_if(whole).alias("linhas_consolidado"),
    ).unpivot([], ["linhas_fato", "fornecedores", "linhas_consolidado"], "ITEM", "VALOR")
    # Few distinct values each: branches, years and buyers are the report's own list items.
    listed = [
        rows(states.select(c).distinct().dropna(), section, F.col(c), F.lit(None).cast("string"))
        for section, c in (("FILIAIS", "FILIAL"), ("ANOS", "ANO"), ("COMPRADORES", "CODCOMPRADOR"))
    ]
    sums = grouped(states, "ANO", "FILIAL").agg(F.sum("SOMA").alias("v"))
    status = partials.annual_comparison(states, year_a, year_b).filter(F.col("STATUS").isin(STATUS_NEW, STATUS_LOST))
    findings = findings_of(counts) if findings is None else findings
    parts = [
        *listed,
        rows(sums, "TOTAIS", F.concat_ws("/", "ANO", "FILIAL"), F.format_number(half_even(F.col("v")), 2)),
        rows(findings, "VALIDACOES", F.col("NIVEL"), F.col("MENSAGEM")),
        rows(status, "STATUS", F.col("CODFORNEC"), F.col("STATUS")),
    ]
    return functools.reduce(DataFrame.unionByName, parts, rows(sizes, "CONTAGENS", F.col("ITEM"), F.col("VALOR")))
