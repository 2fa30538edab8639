"""Joins on a key that holds most rows, and the sample of the isolation forest."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procura.functions import isolation
from procura.operators import anomalies, forest, joins, summary

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SMALL_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def conf(spark):
    old = {}

    def apply(**settings):
        for key, value in settings.items():
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield lambda settings: apply(**settings)
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_fact(spark):
    """Four fifths of the rows belong to supplier 7, which has very many branches."""
    i = F.col("id")
    return spark.range(40_000).select(
        F.lit(2025).alias("ANO"), (i % 5000).cast("int").alias("FILIAL"),
        F.when(i % 5 < 4, F.lit(7)).otherwise(100 + i % 400).cast("long").alias("CODFORNEC"),
        F.concat(F.lit("Forn "), F.sha2(i.cast("string"), 256)).alias("FORNECEDOR"), F.lit("F").alias("FANTASIA"), F.lit("C").alias("CODCOMPRADOR"),
        F.lit("JANEIRO").alias("MES"), (1 + i % 12).cast("int").alias("MES_NUM"),
        ((i * 37) % 1000 + 1).cast("decimal(18,2)").alias("VALOR"), F.make_date(F.lit(2025), (1 + i % 12).cast("int"), F.lit(1)).alias("DATA"),
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["z_scores", "lag_features", "canonical_names"])
def test_adaptive_execution_splits_the_hot_supplier(spark, conf, hot_fact, name):
    conf(NO_BROADCAST | SMALL_SKEW)
    if name == "z_scores":
        df = anomalies.z_scores(hot_fact)
    elif name == "lag_features":
        df = forest.lag_features(hot_fact, bounded=True)
    else:
        df = summary.canonical_names(hot_fact, summary.supplier_dim(hot_fact))
    assert "skew=true" in final_plan(df)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pieces_give_the_rows_of_a_plain_join(spark, conf, how):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), i % 50, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, v long, c string")
    counts = Counter(k for k, _, _ in rows if k is not None)
    per_key = spark.createDataFrame([(k, n, f"s{k}") for k, n in counts.items() if k != 4], "k long, n long, s string")
    conf(NO_BROADCAST)
    got = joins.join_per_key(df, per_key, "k", "n", how, piece_rows=100)
    assert got.columns == ["k", "v", "c", "s"]
    plain = df.join(per_key.drop("n"), "k", how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
    # without any skew handling of Spark's, no task holds most of the hot key
    conf({"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "20"})
    sizes = [r["count"] for r in joins.join_per_key(df, per_key, "k", "n", how, piece_rows=100).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.25 * sum(sizes) and len(sizes) > 10


def test_every_tree_draws_on_its_own(spark):
    rows = spark.range(30_000).select(
        F.lit(1).alias("FILIAL"), (F.col("id") * 7919 % 30011).cast("decimal(18,2)").alias("VALOR"), (1 + F.col("id") % 12).cast("int").alias("MES_NUM"),
        F.lit(2025).alias("ANO"), F.col("id").alias("CODFORNEC"),
    )
    drawn = anomalies.sample_for_trees(rows, 30_000, 60).select("tree", "VALOR").toPandas()
    assert (drawn.groupby("tree").size() == anomalies.SAMPLE).all() and drawn.tree.nunique() == 60
    again = anomalies.sample_for_trees(rows.repartition(17, "VALOR"), 30_000, 60).select("tree", "VALOR").toPandas()
    order = ["tree", "VALOR"]
    assert drawn.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    # two trees share as many rows as independent draws do: 256 * 256 / 30000, and rows come from everywhere
    sets = {t: set(g.VALOR) for t, g in drawn.groupby("tree")}
    shared = [len(sets[a] & sets[b]) for a in sets for b in sets if a < b]
    expected = anomalies.SAMPLE**2 / 30_000
    assert abs(np.mean(shared) - expected) < 5 * math.sqrt(expected / len(shared))
    assert abs(drawn.VALOR.astype(float).mean() / 15_005 - 1) < 0.02
    small = anomalies.sample_for_trees(rows.limit(100), 100, 5).groupBy("tree").count().collect()
    assert {r["count"] for r in small} == {100} and len(small) == 5


def descend(nodes, point):
    at = 0
    while nodes[at].feature >= 0:
        at = 2 * at + 1 + (point[int(nodes[at].feature)] > nodes[at].threshold)
    return nodes[at].path


def test_scorer_equals_a_plain_descent():
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(256, 4)), 1)
    points[:40] = points[0]
    trees = [pd.DataFrame(isolation.grow_tree(points[rng.permutation(256)[:100]], t, 8, 1), columns=isolation.NODE_COLUMNS) for t in range(12)]

    class Shared:
        value = [isolation.pack_tree(t, 8) for t in trees]

    score = isolation.forest_scorer(Shared, 8, 5.0)
    batch = tuple(pd.Series(points[:, i]) for i in range(4))
    got = next(score(iter([batch])))
    tables = [{n.node: n for n in t.itertuples(index=False)} for t in trees]
    for point, value in zip(points, got):
        mean = sum(descend(t, point) for t in tables) / len(tables)
        assert value == pytest.approx(-(2.0 ** (-mean / 5.0)), rel=1e-12)
