"""Ranged scans against brute force: hot series, ties, global order."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from procura.operators import anomalies, concentration
from procura.operators.scan import bounded_scan, ranged_scan


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles apart, so series really span ranges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def brute(rows):
    out, state = {}, {}
    for key, order, value in sorted(rows):
        pos, total, last = state.get(key, (0, Decimal(0), None))
        out[key, order] = (pos, total + value, last)
        state[key] = (pos + 1, total + value, value)
    return out


def test_hot_series_spans_ranges(spark, many_partitions):
    rows = [("hot", i, Decimal(i % 17) + Decimal("0.25")) for i in range(3000)]
    rows += [(f"k{i % 500}", i, Decimal(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v decimal(18,2)").repartition(7)
    got = ranged_scan(df, ["k"], [F.asc("o")], "v")
    want = brute(rows)
    assert {(r.k, r.o): (r.POS, r.ACUM, r.ANTERIOR) for r in got.collect()} == want
    spread = df.repartitionByRange("k", "o").withColumn("p", F.spark_partition_id()).filter("k = 'hot'")
    assert spread.select("p").distinct().count() > 4  # the hot series is not one task


def test_ranged_equals_bounded_on_descending_global_order(spark, many_partitions):
    rows = [(i, Decimal(1 if i % 3 else i)) for i in range(4000)]  # two thirds share one value
    df = spark.createDataFrame(rows, "k long, v decimal(18,2)")
    order = [F.desc("v"), F.asc("k")]
    a = ranged_scan(df, [], order, "v").select("k", "POS", "ACUM", "ANTERIOR")
    b = bounded_scan(df.withColumn("s", F.lit(1)), ["s"], order, "v").select("k", "POS", "ACUM", "ANTERIOR")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_nulls_in_the_value(spark, many_partitions):
    rows = [("a", i, None if i % 2 else Decimal(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v decimal(18,2)")
    a = ranged_scan(df, ["k"], [F.asc("o")], "v").select("o", "POS", "ACUM", "ANTERIOR")
    b = bounded_scan(df, ["k"], [F.asc("o")], "v").select("o", "POS", "ACUM", "ANTERIOR")
    assert sorted(a.collect()) == sorted(b.collect())


def test_abc_and_lorenz_over_ranges(spark, make_fact, many_partitions):
    amounts = {s: Decimal((s * 7919) % 1000 + 1) for s in range(1, 1501)}
    fact = make_fact([(2025, 1, s, "N", 1, str(v)) for s, v in amounts.items()])
    total, run, want = sum(amounts.values()), Decimal(0), {}
    for s, v in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        run += v
        want[s] = float(run) / float(total) * 100
    got = {r.CODFORNEC: r.ACUM_PCT for r in concentration.abc_curve(fact).collect()}
    assert got == want
    points = sorted((r.CUM_POP, r.CUM_VAL) for r in concentration.lorenz_curve(fact).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == 1501
    assert all(v <= p + 1e-12 for p, v in points) and all(a[1] <= b[1] for a, b in zip(points, points[1:]))
    n, ordered = len(amounts), sorted(map(float, amounts.values()))
    gini = (n + 1 - 2 * sum((n - i) * v for i, v in enumerate(ordered)) / sum(ordered)) / n
    row = concentration.concentration(fact).filter("ESCOPO = 'GERAL'").first()
    assert row.GINI == round(gini, 2)
    assert row.HHI == round(sum((100 * v / sum(ordered)) ** 2 for v in ordered), 2)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.333, 1.0])
def test_percentile_is_exact(spark, many_partitions, p):
    import numpy as np

    data = [((i * 7907) % 9973) / 100 if i % 3 else 5.0 for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(data)), "k long, v double")
    assert anomalies.percentile_of(df, "v", p, ["k"]) == pytest.approx(float(np.percentile(data, p * 100)))
