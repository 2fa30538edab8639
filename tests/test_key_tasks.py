"""Joins and groups of large tables get tasks by the rows of their key; a hot key is left to map-side sums and skew joins."""

import re

import pytest
from pyspark.sql import functions as F

from procura.operators import partials, summary
from procura.sources import retail, tables


@pytest.fixture
def few_rows_a_task(monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    monkeypatch.setattr(tables, "MANY_ROWS", 100)


def exchanges(df):
    """Tasks of every shuffle by hash in the plan."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def star(spark, tmp_path):
    """5 nations and suppliers, 20 customers and parts, 400 orders of two lines; the last customer and supplier have no key."""
    key = lambda n: F.when(F.col("id") % n < n - 1, F.col("id") % n)
    made = {
        "nation": spark.range(5).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), (F.col("id") % 3).cast("int").alias("n_regionkey")),
        "customer": spark.range(20).select(key(20).alias("c_custkey"), (F.col("id") % 5).cast("int").alias("c_nationkey")),
        "supplier": spark.range(5).select(key(5).alias("s_suppkey"), F.concat(F.lit("s "), "id").alias("s_name"), F.col("id").cast("int").alias("s_nationkey")),
        "part": spark.range(20).select(F.col("id").alias("p_partkey"), F.concat(F.lit("p "), "id").alias("p_name"), F.lit("T").alias("p_type"), F.lit("B").alias("p_brand")),
        "orders": spark.range(400).select(F.col("id").alias("o_orderkey"), key(20).alias("o_custkey")),
        "lineitem": spark.range(800).select(
            (F.col("id") % 400).alias("l_orderkey"), key(5).alias("l_suppkey"), (F.col("id") % 20).alias("l_partkey"), (F.col("id") * 1.25).alias("l_extendedprice"),
            F.make_timestamp(F.lit(1999), (F.col("id") % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("l_shipdate"),
        ),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_tasks_by_key(spark, few_rows_a_task):
    keys = spark.range(1000).select((F.col("id") % 100).alias("k"))
    assert tables.tasks_by_key(keys, 1000) == 20
    assert tables.tasks_by_key(keys, 100) == 0
    assert tables.tasks_by_key(keys.select(F.when(F.col("k") < 60, F.lit(1)).otherwise(F.col("k")).alias("k")), 1000) == 0
    assert tables.tasks_by_key(keys.select(F.when(F.col("k") >= 60, F.col("k")).alias("k")), 1000) == 20


@pytest.mark.parametrize("by", ["supplier", "part"])
def test_fact_of_many_lines(spark, star, monkeypatch, by):
    """Suppliers are hot here, parts are not: both deal every join and sum of the fact, with the same rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = rows_of(retail.build_fact(spark, star, by))
        monkeypatch.setattr(tables, "TASK_ROWS", 50)
        monkeypatch.setattr(tables, "MANY_ROWS", 100)
        fact = retail.build_fact(spark, star, by)
        tasks = exchanges(fact)
        assert rows_of(fact) == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # customer, nation and supplier names are small and joined before; all others are dealt: 400 orders, 800 lines
    assert tasks.count(8) >= 2 and tasks.count(16) >= 4


def test_states_and_dimension_of_many_rows(spark, make_fact, few_rows_a_task, monkeypatch):
    fact = make_fact([(y, b, s, f"N{m % 3}", m, str(s * m + b)) for y in (2025, 2026) for b in (1, 2) for s in range(1, 11) for m in range(1, 13)])
    fact = fact.withColumn("CODCOMPRADOR", F.lit("C"))
    states = partials.state(fact, 480)
    assert exchanges(states) == [10] and rows_of(states) == rows_of(partials.state(fact))
    dim = partials.supplier_dim(states)
    assert 3 in exchanges(dim) and rows_of(dim) == rows_of(summary.supplier_dim(fact))
    hot = partials.supplier_dim(states.withColumn("CODFORNEC", F.lit(1).cast("long") + F.col("CODFORNEC") * 0))
    assert hot.first().N_REGISTROS == 480
