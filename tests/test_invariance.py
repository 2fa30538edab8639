"""Results do not depend on the number of shuffle partitions, and properties that hold for any amounts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from compare import canonical
from procura.operators import concentration, forecast
from test_rules import projection_by_definition

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "fact_build", "consolidated", "supplier_dim", "yoy_status", "abc_curve_parts", "concentration_scopes", "lorenz_curve",
    "forecast_series", "lag_features", "supplier_features", "zscore_anomalies", "dq_checks",
]


@pytest.mark.parametrize("name", NAMES)
def test_shuffle_partitions_do_not_matter(spark, name):
    query, seen = entry.queries()[name], []
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = query(spark, FOLDER)
            seen.append(canonical(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen[0] == seen[1]


amounts = st.lists(st.integers(0, 10**7), min_size=1, max_size=30).filter(any)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(amounts, min_size=1, max_size=8))
def test_projection_of_any_series(make_fact, series):
    rows = [
        (2020 + i // 12, 1, s, "N", i % 12 + 1, str(v / 100)) for s, vs in enumerate(series) for i, v in enumerate(vs)
    ]
    got = {r.CODFORNEC: r for r in forecast.forecast_series(make_fact(rows), bounded=True).collect()}
    for s, vs in enumerate(series):
        want = projection_by_definition([v / 100 for v in vs])
        assert [got[s][c] for c in forecast.PROJECTION] == pytest.approx(want, rel=1e-9, abs=1e-6)
        assert got[s].ic_inf <= got[s].ensemble + 1e-9 <= got[s].ic_sup + 2e-9


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(amounts)
def test_concentration_bounds(make_fact, values):
    fact = make_fact([(2025, 1, s, "N", 1, str(v / 100)) for s, v in enumerate(values)])
    row = concentration.concentration(fact).filter("ESCOPO = 'GERAL'").first()
    assert 0 <= row.GINI < 1 and 0 < row.HHI <= 10000 and row.TOP5_PCT <= row.TOP10_PCT <= 100
    if len(set(values)) == 1:
        assert row.GINI == 0
    last = max(r.ACUM_PCT for r in concentration.abc_curve(fact).collect())
    assert last == 100
