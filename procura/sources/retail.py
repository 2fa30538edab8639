"""Fact table from an order star schema: lineitem, orders, customer, nation, supplier, part.

The big joins shuffle on the order and customer keys. Amounts are summed to the monthly
grain before any name is joined, so the wide columns never travel with the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.functions.labels import month_name
from procura.functions.text import clean_text, first_two_words
from procura.schema import AMOUNT, FACT_COLUMNS, MONTHS
from procura.sources.tables import dealt, dealt_by_rows, in_fact_order, read_table, staged, tasks_by_key


def order_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, FILIAL): the branch is the customer's region."""
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1).alias("FILIAL")
    )
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = tasks_by_key(orders.select("o_custkey"), orders.count())
    return dealt(orders, n, "o_custkey").join(dealt(customer.join(nation, "c_nationkey"), n, "o_custkey"), "o_custkey").select("o_orderkey", "FILIAL")


def purchase_lines(spark: SparkSession, sf_dir: str, key: str = "l_suppkey", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per order line: ANO, MES_NUM, FILIAL, CODFORNEC, VALOR."""
    n = line_count(spark, sf_dir)
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.year("l_shipdate").alias("ANO"),
        F.month("l_shipdate").alias("MES_NUM"),
        F.col(key).alias("CODFORNEC"),
        F.col("l_extendedprice").cast(AMOUNT).alias("VALOR"),
        *extra,
    )
    branches = order_branches(spark, sf_dir)
    return dealt_by_rows(lines, n, "o_orderkey").join(dealt_by_rows(branches, n, "o_orderkey"), "o_orderkey").drop("o_orderkey")


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Order lines, from the file footers."""
    return read_table(spark, sf_dir, "lineitem").count()


def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    supplier = read_table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    name = clean_text(F.col("s_name"))
    return supplier.select(
        F.col("s_suppkey").alias("CODFORNEC"),
        name.alias("FORNECEDOR"),
        first_two_words(name).alias("FANTASIA"),
        clean_text(F.col("n_name")).alias("CODCOMPRADOR"),
    )


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = clean_text(F.concat_ws(" ", "p_name", "p_type"))
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("CODFORNEC"),
        name.alias("FORNECEDOR"),
        first_two_words(name).alias("FANTASIA"),
        clean_text(F.col("p_brand")).alias("CODCOMPRADOR"),
    )


def build_fact(spark: SparkSession, sf_dir: str, by: str = "supplier") -> DataFrame:
    """Long fact at year x branch x supplier x month; `by` is 'supplier' or 'part'."""
    key, names = ("l_suppkey", supplier_names) if by == "supplier" else ("l_partkey", part_names)
    n = line_count(spark, sf_dir)
    months = ["ANO", "MES_NUM", "FILIAL", "CODFORNEC"]
    tasks = tasks_by_key(read_table(spark, sf_dir, "lineitem").select(key), n)
    lines = purchase_lines(spark, sf_dir, key)
    # one shuffle by the key serves the sums and the names; a hot key is cut by month and branch for the sums
    lines = dealt(lines, tasks, "CODFORNEC") if tasks else dealt_by_rows(lines, n, *months)
    monthly = lines.groupBy(*months).agg(F.sum("VALOR").cast(AMOUNT).alias("VALOR"))
    named = names(spark, sf_dir)
    if not tasks:  # a key has one row per month and branch left
        monthly, named = dealt_by_rows(monthly, n, "CODFORNEC"), dealt_by_rows(named, n, "CODFORNEC")
    return (
        monthly.join(dealt(named, tasks, "CODFORNEC"), "CODFORNEC")
        .withColumn("MES", month_name(F.col("MES_NUM")))
        .withColumn("DATA", F.make_date("ANO", "MES_NUM", F.lit(1)))
        .select(*FACT_COLUMNS)
    )


def fact(spark: SparkSession, sf_dir: str, by: str = "supplier") -> DataFrame:
    """The fact, written once per application by year; queries then read and prune it."""
    build = lambda: in_fact_order(build_fact(spark, sf_dir, by), line_count(spark, sf_dir))
    table = staged(spark, sf_dir, f"fact-{by}", build, ["ANO"])
    return table.select(*FACT_COLUMNS)


def wide(spark: SparkSession, sf_dir: str, by: str = "supplier") -> DataFrame:
    """The fact turned back into the sheet layout: one text column per month."""
    ids = ["ANO", "FILIAL", "CODFORNEC", "FORNECEDOR", "FANTASIA", "CODCOMPRADOR"]
    rows = fact(spark, sf_dir, by)
    return (
        dealt_by_rows(rows, rows.count(), "ANO", "FILIAL", "CODFORNEC")  # a month has one row
        .groupBy(*ids)
        .pivot("MES", MONTHS)
        .agg(F.sum("VALOR"))
        .select(*ids, *[F.col(m).cast("string").alias(m) for m in MONTHS])
    )
