"""Tasks of large tables follow the rows, not the session's partitions."""

import pytest

from procura.operators import forest, joins, quality
from procura.sources import tables


@pytest.fixture
def few_rows_a_task(monkeypatch):
    for module in (tables, joins):
        monkeypatch.setattr(module, "TASK_ROWS", 50)
        monkeypatch.setattr(module, "MANY_ROWS", 100)


def test_dealt_by_rows(spark, few_rows_a_task):
    many, few = spark.range(1000), spark.range(100)
    assert tables.dealt_by_rows(many, 1000, "id").rdd.getNumPartitions() == 20
    assert tables.dealt_by_rows(few, 100, "id") is few


def test_large_tables_give_the_same_features(make_fact, monkeypatch):
    fact = make_fact([(y, b, s, f"N{s}", m, str(s * m + b)) for y in (2025, 2026) for b in (1, 2) for s in range(1, 11) for m in range(1, 13)])
    pick = lambda df: sorted(tuple(r) for r in df.collect())
    want = pick(forest.lag_features(fact, bounded=True))
    for module in (tables, joins):
        monkeypatch.setattr(module, "TASK_ROWS", 50)
        monkeypatch.setattr(module, "MANY_ROWS", 100)
    assert pick(forest.lag_features(fact, bounded=True)) == want
    ordered = tables.in_fact_order(fact, 480)
    assert ordered.rdd.getNumPartitions() > 4 and pick(ordered) == pick(fact)


def test_report_of_a_dealt_fact(make_fact, few_rows_a_task):
    fact = make_fact([(y, b, s, f"N{s}", m, str(s * m + b)) for y in (2025, 2026) for b in (1, 2) for s in range(1, 11) for m in range(1, 13)])
    pick = lambda rows: sorted(map(str, quality.report(rows.select("ANO", "FILIAL", "CODFORNEC").distinct(), rows, 2025, 2026).collect()))
    dealt = tables.dealt_by_rows(fact, 480, "ANO", "FILIAL", "CODFORNEC")
    assert dealt.rdd.getNumPartitions() == 10 and pick(dealt) == pick(fact)
