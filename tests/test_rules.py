"""Null, rounding, tie and boundary rules on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from procura.functions import labels, numeric, text
from procura.operators import concentration, forecast, forest, quality, ranking, reshape, selection, summary
from procura.schema import MONTHS, WIDE_COLUMNS


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


# --- functions ------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [
    (" 12 ", 12.0), ("1e3", 1000.0), ("-3.5", -3.5), (".5", 0.5), ("7.", 7.0), ("1,5", None), ("abc", None), ("", None),
    ("nan", None), ("inf", None), ("12d", None), ("0x1p3", None), ("1e999", None), (None, None), ("R$ 3", None),
])
def test_coerce_number(spark, raw, want):
    assert one(spark, numeric.coerce_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("x, want", [(0.125, 0.12), (0.375, 0.38), (2.5, 2.5), (1.005, 1.0), (-0.125, -0.12), (None, None)])
def test_half_even(spark, x, want):
    assert one(spark, numeric.half_even(F.lit(x).cast("double"))) == want


def test_growth_from_zero(spark):
    d = lambda x: F.lit(float(x))
    assert one(spark, numeric.growth(d(5), d(0))) == math.inf
    assert one(spark, numeric.growth(d(-5), d(0))) == -math.inf
    assert one(spark, numeric.growth(d(0), d(0))) is None
    assert one(spark, numeric.growth(d(3), d(2))) == 0.5
    assert one(spark, numeric.growth(d(5), d(0), finite_only=True)) is None


@pytest.mark.parametrize("raw, want", [
    ("  acme sa ", "ACME SA"), ("nan", None), ("None", None), ("<na>", None), ("", None), ("\t \n", None), (None, None),
])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text(F.lit(raw).cast("string"))) == want


def test_names_from_text(spark):
    assert one(spark, text.first_two_words(F.lit(" ACME  DO BRASIL SA "))) == "ACME DO"
    assert one(spark, text.first_two_words(F.lit("ACME"))) == "ACME"
    assert one(spark, text.first_two_words(F.lit(None).cast("string"))) is None
    assert one(spark, text.year_in_name(F.lit("TRIMESTRES 2027 (de 2025).xlsx"))) == 2027
    assert one(spark, text.year_in_name(F.lit("compras 1999"))) is None
    assert one(spark, text.year_in_name(F.lit(None).cast("string"))) is None
    assert one(spark, text.branch_in_sheet(F.lit("FILIAL  3 "))) == 3
    assert one(spark, text.branch_in_sheet(F.lit("RESUMO"))) is None


@pytest.mark.parametrize("x, full, short", [
    (1234567.89, "R$ 1.234.567,89", "R$ 1,23 mi"), (1234.5, "R$ 1.234,50", "R$ 1,2 mil"), (0.0, "R$ 0,00", "R$ 0,00"),
    (-2500.0, "R$ -2.500,00", "R$ -2,5 mil"), (1234567890.0, "R$ 1.234.567.890,00", "R$ 1,234,57 mi"), (None, "—", "—"),
])
def test_money(spark, x, full, short):
    assert one(spark, labels.fmt_brl(F.lit(x).cast("double"))) == full
    assert one(spark, labels.fmt_brl_compact(F.lit(x).cast("double"))) == short


@pytest.mark.parametrize("x, digits, want", [(12.34, 1, "12.3%"), (5.0, 2, "5.0%"), (12.3, 2, "12.3%"), (12345678.0, 1, "12345678.0%"), (None, 2, "nan%")])
def test_percent(spark, x, digits, want):
    assert one(spark, labels.percent_label(F.lit(x).cast("double"), digits)) == want


def test_bands_and_detector(spark):
    assert [one(spark, labels.hhi_band(F.lit(h))) for h in (2501, 2500, 1500)] == ["alto", "moderado", "baixo"]
    assert [one(spark, labels.gini_band(F.lit(g))) for g in (0.61, 0.6)] == ["alta", "moderada"]
    flags = [(True, True), (True, False), (False, True), (False, False)]
    assert [one(spark, labels.detector_label(F.lit(a), F.lit(b))) for a, b in flags] == ["Z+ISO", "Z", "ISO", ""]
    assert one(spark, labels.month_label(F.lit(13))) is None
    assert one(spark, labels.month_number(F.lit("MARÇO"))) is None


# --- reshape --------------------------------------------------------------------------------


def make_wide(spark, rows):
    schema = "ANO int, FILIAL int, CODFORNEC long, " + ", ".join(f"{c} string" for c in WIDE_COLUMNS[3:])
    return spark.createDataFrame([(*r[:6], *r[6:], *[None] * (18 - len(r))) for r in rows], schema)


def test_to_fact(spark):
    wide = make_wide(spark, [
        (2025, 1, 1, "A", "A", "C", "10.125", "abc", "0", "-5"),
        (2025, 2, 1, "A", "A", "C", "1e2", None, "0", "3"),
        (2026, 1, 1, "A", "A", None, None, None, "7"),
    ])
    fact = reshape.to_fact(wide)
    got = sorted(values(fact, "ANO", "FILIAL", "MES_NUM", "VALOR"))
    # March 2025 is zero and April 2025 is negative for everybody: neither has happened; March 2026 has
    assert [(a, f, m, float(v)) for a, f, m, v in got] == [(2025, 1, 1, 10.12), (2025, 2, 1, 100.0), (2026, 1, 3, 7.0)]
    assert fact.filter("ANO = 2026").first()["DATA"].isoformat() == "2026-03-01"


def test_unpivot_inverts_pivot(spark, make_fact):
    fact = make_fact([(2025, b, s, "N", m, str(b * 100 + s * 10 + m)) for b in (1, 2) for s in (1, 2, 3) for m in range(1, 13)])
    ids = WIDE_COLUMNS[:6]
    wide = fact.groupBy(*ids).pivot("MES", MONTHS).agg(F.sum("VALOR")).select(*ids, *[F.col(m).cast("string") for m in MONTHS])
    again = reshape.to_fact(wide)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fact.collect()))


# --- aggregation ----------------------------------------------------------------------------


def test_null_keys_are_dropped_from_groups_but_count_as_duplicates(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "5"), (2025, 1, None, "B", 1, "7"), (2025, 1, None, "B", 1, "7")])
    assert values(ranking.supplier_ranking(fact), "CODFORNEC", "TOTAL") == [(1, 5.0)]
    assert summary.supplier_dim(fact).count() == 1
    found = quality.check(fact.select("ANO", "FILIAL", "CODFORNEC"), fact)
    assert sorted(values(found, "ORDEM", "N")) == [(3, 1), (4, 1)]
    assert quality.exit_status(found) == 1
    kpi = summary.kpis(fact).first()
    assert (kpi.TOTAL_GERAL, kpi.N_FORNECEDORES, kpi.MEDIA_FORNECEDOR, kpi.TICKET_MEDIO) == (19.0, 1, 5.0, 19.0)


def test_single_row_has_no_deviation(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "5")])
    assert values(summary.consolidate(fact), "DESVIO", "INATIVO_TRIMESTRE") == [(0.0, False)]
    assert values(summary.year_stats(fact, summary.supplier_dim(fact), 2025), "DESVIO") == [(None,)]
    zero = make_fact([(2025, 1, 1, "A", 1, "0")])
    assert values(summary.consolidate(zero), "INATIVO_TRIMESTRE") == [(True,)]


def test_mode_ties_and_blanks(spark, make_fact):
    fact = make_fact([
        (2025, 1, 1, "BETA", 1, "1"), (2025, 1, 1, "ALFA", 2, "1"), (2025, 1, 1, None, 3, "1"),
        (2025, 1, 2, None, 1, "1"), (2025, 1, 3, "NAN", 1, "1"),
    ]).withColumn("FORNECEDOR", F.when(F.col("CODFORNEC") == 3, "X Y  Z").otherwise(F.col("FORNECEDOR")))
    got = {r.CODFORNEC: (r.FORNECEDOR, r.FANTASIA, r.N_REGISTROS) for r in summary.supplier_dim(fact).collect()}
    assert got == {1: ("ALFA LTDA", "ALFA", 3), 2: ("", "", 1), 3: ("X Y  Z", "X Y", 1)}


def test_comparison_status(spark, make_fact):
    pairs = {1: ("0", "9"), 2: ("9", "0"), 3: ("0", "0"), 4: ("10000", "10499"), 5: ("100", "105"), 6: ("100", "95"),
             7: ("-5", "9"), 8: ("100", "95.01"), 9: ("100", "300")}
    rows = [(y, 1, s, "N", 1, v) for s, pair in pairs.items() for y, v in zip((2025, 2026), pair)]
    rows += [(2026, 1, 10, "N", 1, "4"), (2024, 1, 11, "N", 1, "4")]
    comp = summary.annual_comparison(make_fact(rows), 2025, 2026)
    assert dict(values(comp, "CODFORNEC", "STATUS")) == {
        1: "NOVO", 2: "PERDIDO", 3: "INDEFINIDO", 4: "ESTAVEL", 5: "CRESCENTE", 6: "DECRESCENTE", 7: "INDEFINIDO",
        8: "ESTAVEL", 9: "CRESCENTE", 10: "NOVO", 11: "INDEFINIDO",
    }
    # 105 / 100 - 1 is just above 5 percent as a double; the exact cut belongs to the change, not to its label
    assert dict(values(comp, "CODFORNEC", "VAR_PCT"))[5] == 5.0


def test_absent_years_keep_the_columns(spark, make_fact):
    comp = summary.annual_comparison(make_fact([(2024, 1, 1, "A", 1, "1")]), 2025, 2026)
    assert comp.columns == ["CODFORNEC", "TOTAL_2025", "TOTAL_2026", "VAR_ABS", "VAR_PCT", "STATUS"]
    head = summary.yoy_headline(make_fact([(2026, 1, 1, "A", 1, "1")]), 2025, 2026).first()
    assert (head.VAR_PCT, head.DIRECAO, head.TEXTO) == (None, "neutral", None)


def test_abc_cuts_at_exactly_80_and_95(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "80"), (2025, 1, 2, "B", 1, "15"), (2025, 1, 3, "C", 1, "5")])
    curve = concentration.abc_curve(fact)
    assert sorted(values(curve, "CODFORNEC", "ACUM_PCT", "CLASSE")) == [(1, 80.0, "A"), (2, 95.0, "B"), (3, 100.0, "C")]
    assert sorted(values(concentration.abc_summary(curve), "CLASSE", "N", "VALOR")) == [("A", 1, 80.0), ("B", 1, 15.0), ("C", 1, 5.0)]


def test_concentration_edge_scopes(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "5"), (2025, 1, 1, "A", 2, "0"), (2025, 1, 1, "A", 3, "5"), (2026, 2, 1, "A", 1, "0")])
    got = {(r.ESCOPO, r.CHAVE): r for r in concentration.concentration(fact).collect()}
    assert set(got) == {("GERAL", "Total"), ("ANO", "2025"), ("FILIAL", "Filial 1"), ("ANO_FILIAL", "2025 · Filial 1")}
    one_supplier = got["ANO", "2025"]
    assert (one_supplier.HHI, one_supplier.GINI, one_supplier.TOP5_PCT, one_supplier.N_FORNECEDORES) == (10000.0, 0.0, 100.0, 1)
    assert one_supplier.CRESC_MEDIO_MOM_PCT == math.inf  # -100 %, then from zero
    finite = {(r.ESCOPO, r.CHAVE): r for r in concentration.concentration(fact, finite_only=True).collect()}
    assert finite["ANO", "2025"].CRESC_MEDIO_MOM_PCT == -100.0


def test_lone_month_has_no_growth(spark, make_fact):
    got = concentration.concentration(make_fact([(2025, 1, 1, "A", 1, "5")]))
    assert {r.CRESC_MEDIO_MOM_PCT for r in got.collect()} == {0.0}


def test_ties_go_to_the_smaller_key(spark, make_fact):
    fact = make_fact([(2025, 1, s, f"N{s}", 1, "5") for s in range(20, 0, -1)])
    top = ranking.top_suppliers(fact, summary.supplier_dim(fact), 3)
    assert sorted(values(top, "CODFORNEC")) == [(1,), (2,), (3,)]
    groups = {r.GRUPO for r in ranking.branch_composition(fact, 2).collect()}
    assert groups == {"N1", "N10", "Outros"}
    shown = ranking.top_n_total(fact, 50).first()
    assert (shown.EXIBIDOS, shown.DE, shown.TOTAL) == (20, 20, 100.0)


def test_seasonality_uses_present_months_only(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "10"), (2025, 1, 1, "A", 3, "30")])
    assert sorted(values(summary.seasonality(fact), "MES_NUM", "INDICE")) == [(1, 0.5), (3, 1.5)]


def test_features_fill_absent_months_with_zero(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "10"), (2026, 2, 1, "B", 3, "30"), (2025, 1, 2, "C", 2, "0")])
    got = {r.CODFORNEC: r for r in summary.supplier_features(fact, 2025, 2026).collect()}
    # three months are in use: (10 + 0 + 30) / 3
    assert got[1].SAZ_M1 == pytest.approx(0.75) and got[1].SAZ_M2 == 0.0 and got[1].SAZ_M3 == pytest.approx(2.25)
    assert (got[1].FANTASIA, got[1].N_FILIAIS, got[1].N_OBS, got[1].GROWTH_YOY) == ("A", 2, 2, 2.0)
    assert (got[2].SAZ_M2, got[2].CV, got[2].GROWTH_YOY, got[2].DESVIO) == (0.0, 0.0, 0.0, 0.0)


# --- filters --------------------------------------------------------------------------------


def test_empty_lists(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "5"), (2025, 2, 2, "B", 1, "5")])
    pick = lambda **k: selection.filter_fact(fact, **{"years": [2025], "branches": [1, 2], "buyers": ["C1"], "months": ["JANEIRO"], **k})
    assert pick().count() == 2
    assert pick(suppliers=[2]).count() == 1
    for name in ("years", "branches", "buyers", "months"):
        assert pick(**{name: []}).count() == 0
    dim = summary.supplier_dim(fact)
    assert values(selection.chosen_suppliers(dim, ["B  ·  2"]), "CODFORNEC") == [(2,)]


# --- forecast -------------------------------------------------------------------------------


def projection_by_definition(v):
    """The projection by definition, for one list."""
    n = len(v)
    mean = sum(v) / n
    weights = [1 + (i / (n - 1) if n > 1 else 0) for i in range(n)]
    weighted = sum(a * b for a, b in zip(v, weights)) / sum(weights)
    trend = v[-1]
    if n >= 2 and len(set(v)) > 1:
        xbar = (n - 1) / 2
        slope = sum((i - xbar) * (x - mean) for i, x in enumerate(v)) / sum((i - xbar) ** 2 for i in range(n))
        trend = max(0.0, mean + slope * (n - xbar))
    four = [v[-1], mean, trend, weighted]
    center = sum(four) / 4
    std = math.sqrt(sum((x - center) ** 2 for x in four) / 4)
    own = math.sqrt(sum((x - mean) ** 2 for x in v) / n) if n >= 2 else std
    spread = max(std, own / 2)
    return (*four[:1], mean, trend, weighted, max(0, center), max(0, center - 1.5 * spread), center + 1.5 * spread, spread)


SERIES = {1: [5], 2: [3, 9], 3: [4, 4, 4], 4: [100, 50, 10, 1], 5: [0, 0, 7, 0, 12, 30, 2], 6: [-5, -6, -9]}


@pytest.mark.parametrize("bounded", [True, False])
def test_projection(spark, make_fact, bounded):
    rows = [(2025 + i // 12, 1, s, "N", i % 12 + 1, str(v)) for s, vs in SERIES.items() for i, v in enumerate(vs)]
    got = {r.CODFORNEC: r for r in forecast.forecast_series(make_fact(rows), bounded).collect()}
    for s, vs in SERIES.items():
        assert [got[s][c] for c in forecast.PROJECTION] == pytest.approx(projection_by_definition(vs)), s
        assert got[s].ic_inf <= got[s].ensemble + 1e-9
    assert {(r.ANO, r.MES_NUM, r.MES) for r in got.values()} == {(2025, 8, "AGOSTO")}


def test_december_rolls_over(spark, make_fact):
    assert forecast.next_month(make_fact([(2025, 1, 1, "A", 12, "5"), (2024, 1, 1, "A", 12, "5")])).first()[:2] == (2026, 1)


def test_renamed_supplier_is_two_series(spark, make_fact):
    fact = make_fact([(2025, 1, 1, "A", 1, "5"), (2025, 1, 1, "B", 2, "7"), (2025, 1, 1, None, 3, "7")])
    assert sorted(values(forecast.forecast_series(fact, True), "FANTASIA", "naive")) == [("A", 5.0), ("B", 7.0)]


def test_final_forecast_blends(spark):
    series = spark.createDataFrame([(1, 1, 10.0), (1, 2, 10.0)], "FILIAL int, CODFORNEC long, ensemble double")
    rf = spark.createDataFrame([(1, 1, 4.0)], "FILIAL int, CODFORNEC long, RF_PREDICAO double")
    got = forecast.final_forecast(series, rf)
    assert sorted(values(got, "CODFORNEC", "PREDICAO_FINAL")) == [(1, 7.0), (2, None)]


@pytest.mark.parametrize("bounded", [True, False])
def test_lag_features(spark, make_fact, bounded):
    fact = make_fact([(2025, 1, 30, "A", m, str(v)) for m, v in ((1, 4), (2, 8), (3, 0))] + [(2025, 2, 7, "B", 1, "1")])
    got = forest.lag_features(fact, bounded)
    rows = sorted(values(got, "CODFORNEC", "MES_NUM", "LAG_1", "MEDIA_HIST", "FORNEC_CODE"))
    assert rows == [(7, 1, 0.0, 1.0, 0), (30, 1, 0.0, 4.0, 1), (30, 2, 4.0, 6.0, 1), (30, 3, 8.0, 4.0, 1)]
    past = forest.lag_features(fact, bounded, strict_past=True)
    assert sorted(values(past, "CODFORNEC", "MES_NUM", "MEDIA_HIST")) == [(7, 1, 0.0), (30, 1, 0.0), (30, 2, 4.0), (30, 3, 6.0)]
    last = forest.last_observation(got)
    assert sorted(values(last, "CODFORNEC", "MES_NUM")) == [(7, 1), (30, 3)]
