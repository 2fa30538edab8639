"""Every operator as a query over the given tables. `oracle.py` holds the SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.catalog import models
from procura.functions import labels
from procura.functions.numeric import coerce_number, half_even
from procura.functions.text import clean_text, name_or_fallback, year_in_name
from procura.operators import (
    anomalies,
    concentration,
    display,
    forecast,
    forest,
    partials,
    profile,
    quality,
    ranking,
    reshape,
    segments,
    selection,
    summary,
)
from procura.schema import AMOUNT, MONTHS, WIDE_COLUMNS
from procura.sources import sheets
from procura.sources.retail import build_fact, fact, line_count, part_names, purchase_lines, wide
from procura.sources.tables import dealt, dealt_by_rows, read_table, shared_folder, staged, tasks_by_key
from procura.sources.versions import Version

YEARS = list(range(1995, 2002))
YEAR_A, YEAR_B = 1999, 2000
BRANCHES = [1, 2, 3, 4, 5]
SHEETS = [f"FILIAL {b}" for b in BRANCHES]
FILTER_YEARS, FILTER_BRANCHES = [1998, 1999, 2000], [1, 2, 4]
FILTER_BUYERS = [f"NATION_{i}" for i in range(18)]
FILTER_MONTHS = ["JANEIRO", "FEVEREIRO", "MARCO", "ABRIL", "JULHO", "DEZEMBRO"]
Z_LOW, Z_HIGH = -4.0, 8.0

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    REGISTRY[function.__name__] = function
    return function


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def _comparison(spark: SparkSession, d: str, by: str = "supplier") -> DataFrame:
    return summary.annual_comparison(fact(spark, d, by), YEAR_A, YEAR_B)


def _dim(spark: SparkSession, d: str, by: str = "supplier") -> DataFrame:
    return summary.supplier_dim(fact(spark, d, by))


def _workbooks(spark: SparkSession, d: str) -> dict[int, str]:
    """The fact as CSV workbooks under the shared folder, written once per application."""
    root = f"{shared_folder(spark)}/workbooks"
    done = staged(
        spark, d, "workbook-list",
        lambda: (_write_workbooks(spark, d, root), wide(spark, d).select("ANO").distinct())[1],
    )
    years = sorted(r.ANO for r in done.collect())  # one row per calendar year
    return {y: f"{root}/{_mark(d)}/_book=COMPRAS {y}" for y in years}


def _mark(d: str) -> str:
    return d.rstrip("/").split("/")[-1].replace(".", "_")


def _write_workbooks(spark: SparkSession, d: str, root: str) -> None:
    sheets.write_workbooks(wide(spark, d), f"{root}/{_mark(d)}")


# --- sources, cleaning, reshape -------------------------------------------------------------


@query
def wide_scan(spark, d):
    table = sheets.scan_workbooks(spark, _workbooks(spark, d), expected=SHEETS)
    return table.select(*WIDE_COLUMNS[:6], *[coerce_number(F.col(m)).alias(m) for m in MONTHS])


@query
def ingest_union(spark, d):
    table = sheets.scan_workbooks(spark, _workbooks(spark, d), expected=SHEETS)
    long = reshape.unpivot_months(table)
    return long.groupBy("ANO", "FILIAL").agg(
        F.count("*").alias("N_VALORES"),
        F.count_distinct("CODFORNEC").alias("N_FORNECEDORES"),
        F.sum(F.col("VALOR").cast(AMOUNT)).cast("double").alias("TOTAL"),
    )


@query
def source_contract(spark, d):
    return sheets.validate_workbooks(spark, list(_workbooks(spark, d).values()), SHEETS)


@query
def year_from_name(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", year_in_name(F.col("text")).alias("ANO"))
    return docs.withColumn("TEM_ANO", F.col("ANO").isNotNull())


@query
def table_profile(spark, d):
    return profile.table_profile(read_table(spark, d, "lineitem"))


@query
def branch_mismatch(spark, d):
    """Sheets named by the supplier's region, branch column by the customer's."""
    region = read_table(spark, d, "supplier").join(
        read_table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey"
    )
    sheet = F.concat(F.lit("FILIAL "), (F.col("n_regionkey") + 1).cast("string"))
    named = fact(spark, d).join(region.select(F.col("s_suppkey").alias("CODFORNEC"), sheet.alias("SHEET")), "CODFORNEC")
    rows = named.groupBy("ANO", "FILIAL", "CODFORNEC", "SHEET").agg(F.count("*").alias("N"))
    return sheets.branch_mismatches(rows)


def _dirty_parts(spark, d):
    """Part names in the states a sheet cell comes in, chosen by the part's size."""
    size = F.col("p_size")
    name = (
        F.when(size <= 3, F.lit("")).when(size <= 6, F.lit(" nan ")).when(size <= 9, F.lit("None"))
        .when(size <= 12, F.lit("<NA>")).when(size <= 15, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t")))
    )
    legal = F.when(size <= 2, F.lit("none")).otherwise(F.concat_ws("  ", F.lit(" "), "p_name", "p_type", "p_brand"))
    return read_table(spark, d, "part").select("p_partkey", name.alias("FANTASIA"), legal.alias("FORNECEDOR"))


@query
def clean_strings(spark, d):
    return _dirty_parts(spark, d).select(
        "p_partkey", clean_text(F.col("FANTASIA")).alias("FANTASIA"), clean_text(F.col("FORNECEDOR")).alias("FORNECEDOR")
    )


@query
def name_fallback(spark, d):
    cleaned = clean_strings(spark, d)
    return cleaned.withColumn("FANTASIA", name_or_fallback(F.col("FANTASIA"), F.col("FORNECEDOR")))


@query
def coerce_numeric(spark, d):
    """Amounts written the way cells hold them: padded, scientific, with a comma, words, blanks."""
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    raw = (
        F.when(n == 1, F.concat(F.lit("  "), price, F.lit(" "))).when(n == 2, F.concat(price, F.lit("e1")))
        .when(n == 3, F.translate(price, ".", ",")).when(n == 4, F.concat(F.lit("R$ "), price))
        .when(n == 5, F.lit("nan")).when(n == 6, F.lit("")).otherwise(F.concat(F.lit("-"), price))
    )
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", raw.alias("RAW"))
    return lines.withColumn("VALOR", coerce_number(F.col("RAW")))


@query
def unpivot_months(spark, d):
    return reshape.unpivot_months(wide(spark, d)).select("ANO", "FILIAL", "CODFORNEC", "MES", "MES_NUM", "VALOR")


@query
def drop_empty_months(spark, d):
    """In each year one month has no movement yet: its amounts are zero."""
    long = fact(spark, d).withColumn("VALOR", F.when(F.col("MES_NUM") == F.col("ANO") - 1994, 0).otherwise(F.col("VALOR")))
    return _double(reshape.drop_empty_months(long), "VALOR").select("ANO", "FILIAL", "CODFORNEC", "MES", "MES_NUM", "VALOR")


@query
def fact_build(spark, d):
    return _double(build_fact(spark, d), "VALOR")


@query
def fact_from_wide(spark, d):
    return _double(reshape.to_fact(wide(spark, d)), "VALOR")


@query
def pivot_supplier_year(spark, d):
    return reshape.pivot_supplier_year(fact(spark, d), YEARS)


@query
def pivot_year_branch(spark, d):
    return reshape.pivot_year_branch(fact(spark, d), BRANCHES)


@query
def pivot_branch_month(spark, d):
    return reshape.pivot_branch_month(fact(spark, d))


# --- filters and lists ----------------------------------------------------------------------


def _filtered(spark, d, suppliers=()):
    return selection.filter_fact(fact(spark, d), FILTER_YEARS, FILTER_BRANCHES, FILTER_BUYERS, FILTER_MONTHS, suppliers)


@query
def filtered_fact(spark, d):
    return _double(_filtered(spark, d), "VALOR")


@query
def canonical_names(spark, d):
    """Facts keyed by part, whose names come from the dimension."""
    rows = summary.canonical_names(fact(spark, d, "part"), _dim(spark, d, "part"))
    return _double(rows, "VALOR").select("ANO", "FILIAL", "CODFORNEC", "MES_NUM", "FORNECEDOR", "FANTASIA", "VALOR")


@query
def filter_options(spark, d):
    return selection.filter_options(fact(spark, d))


@query
def supplier_labels(spark, d):
    return selection.supplier_labels(_dim(spark, d))


@query
def active_months(spark, d):
    return selection.calendar_activity(fact(spark, d))


@query
def active_months_by_year(spark, d):
    return selection.activity_by_year(fact(spark, d))


@query
def new_lost_suppliers(spark, d):
    return selection.new_and_lost(_comparison(spark, d, "part"))


# --- aggregations ---------------------------------------------------------------------------


@query
def kpis(spark, d):
    return summary.kpis(fact(spark, d))


@query
def consolidated(spark, d):
    return summary.consolidate(fact(spark, d))


@query
def supplier_dim(spark, d):
    """By part type: many names per key, so the mode has something to decide."""
    tasks = tasks_by_key(read_table(spark, d, "lineitem").select("l_suppkey"), line_count(spark, d))
    return summary.supplier_dim(dealt(_renamed_fact(spark, d), tasks, "CODFORNEC"))


def _renamed_fact(spark, d):
    """Order lines keyed by supplier and named after the part bought: names vary within a key."""
    lines = purchase_lines(spark, d, "l_suppkey", ("l_partkey",))
    names = part_names(spark, d).select(F.col("CODFORNEC").alias("l_partkey"), "FORNECEDOR", "FANTASIA")
    tasks = tasks_by_key(read_table(spark, d, "lineitem").select("l_partkey"), line_count(spark, d))
    return dealt(lines, tasks, "l_partkey").join(dealt(names, tasks, "l_partkey"), "l_partkey").withColumn(
        "FANTASIA", F.when(F.col("FANTASIA").startswith("RED"), None).otherwise(F.col("FANTASIA"))
    )


@query
def yoy_status(spark, d):
    return _comparison(spark, d, "part")


@query
def yoy_status_suppliers(spark, d):
    return summary.annual_comparison(fact(spark, d), 2000, 2001, YEARS)


@query
def year_supplier_stats(spark, d):
    return summary.year_stats(fact(spark, d), _dim(spark, d), YEAR_B)


@query
def supplier_ranking(spark, d):
    return _rounded(ranking.supplier_ranking(fact(spark, d)), 2, "MEDIA_MENSAL", "DESVIO", "CV_PCT")


@query
def sum_branch_year(spark, d):
    return summary.sums_by(fact(spark, d), "FILIAL", "ANO")


@query
def sum_month_year(spark, d):
    return summary.sums_by(fact(spark, d), "MES_NUM", "ANO")


@query
def heat_branch_month_year(spark, d):
    return summary.sums_by(fact(spark, d), "FILIAL", "MES_NUM", "ANO")


@query
def monthly_series(spark, d):
    return summary.sums_by(fact(spark, d), "DATA", "ANO", "MES_NUM").orderBy("DATA")


@query
def seasonality_index(spark, d):
    return _rounded(summary.seasonality(fact(spark, d)), 3, "INDICE")


@query
def yoy_headline(spark, d):
    return summary.yoy_headline(fact(spark, d), YEAR_A, YEAR_B)


@query
def supplier_features(spark, d):
    table = summary.supplier_features(fact(spark, d), YEAR_A, YEAR_B)
    return _rounded(table, 4, "MEDIA", "DESVIO", "CV", "GROWTH_YOY", *[f"SAZ_M{m}" for m in range(1, 13)])


@query
def abc_curve(spark, d):
    curve = concentration.abc_curve(fact(spark, d))
    return summary.with_names(curve, _dim(spark, d))


@query
def abc_curve_parts(spark, d):
    return concentration.abc_curve(fact(spark, d, "part"), names=True)


@query
def abc_summary(spark, d):
    return concentration.abc_summary(concentration.abc_curve(fact(spark, d), names=True))


@query
def concentration_scopes(spark, d):
    return concentration.concentration(fact(spark, d))


@query
def concentration_bands(spark, d):
    return concentration.bands(concentration.concentration(fact(spark, d)))


@query
def monthly_growth(spark, d):
    """Growth with a month at zero in it: the step after it is infinite."""
    rows = fact(spark, d).withColumn("VALOR", F.when(F.col("DATA") == F.lit("1997-05-01").cast("date"), 0).otherwise(F.col("VALOR")))
    return concentration.monthly_growth(rows)


@query
def lorenz_curve(spark, d):
    return concentration.lorenz_curve(fact(spark, d, "part"))


# --- rankings -------------------------------------------------------------------------------


@query
def top_suppliers(spark, d):
    return ranking.top_suppliers(fact(spark, d), _dim(spark, d))


@query
def top_n_total(spark, d):
    return ranking.top_n_total(fact(spark, d), 15)


@query
def top_growth(spark, d):
    return ranking.extremes(_comparison(spark, d), _dim(spark, d))


@query
def top_drop(spark, d):
    return ranking.extremes(_comparison(spark, d), _dim(spark, d), falls=True)


@query
def top8_series(spark, d):
    return ranking.top_series(fact(spark, d))


@query
def branch_composition(spark, d):
    return ranking.branch_composition(fact(spark, d))


@query
def next_month(spark, d):
    return forecast.next_month(fact(spark, d))


# --- labels and display tables --------------------------------------------------------------


@query
def fmt_brl(spark, d):
    price = F.col("o_totalprice")
    scaled = {"CENTESIMO": price / 10000, "INTEIRO": price, "MILHAR": price * 1000, "NEGATIVO": -price}
    orders = read_table(spark, d, "orders").select("o_orderkey", *[half_even(c).alias(n) for n, c in scaled.items()])
    return orders.select(
        "o_orderkey",
        *[labels.fmt_brl(F.col(n)).alias(f"BRL_{n}") for n in scaled],
        *[labels.fmt_brl_compact(F.col(n)).alias(f"CURTO_{n}") for n in scaled],
    )


@query
def month_labels(spark, d):
    rows = fact(spark, d).select("ANO", "MES", "MES_NUM", "DATA").distinct()
    return rows.select(
        "ANO", "MES_NUM",
        labels.month_name(F.col("MES_NUM")).alias("MES"),
        labels.month_number(F.col("MES")).alias("NUMERO"),
        labels.month_label(F.col("MES_NUM")).alias("MES_LBL"),
        labels.period_label(F.col("DATA")).alias("PERIODO"),
        labels.target_label(F.col("ANO"), F.col("MES_NUM")).alias("ALVO_LBL"),
    )


@query
def supplier_table(spark, d):
    return display.ranking_table(ranking.supplier_ranking(fact(spark, d)))


@query
def abc_table(spark, d):
    return display.abc_table(concentration.abc_curve(fact(spark, d), names=True))


@query
def comparison_table(spark, d):
    return display.comparison_table(_comparison(spark, d, "part"), _dim(spark, d, "part"), YEAR_A, YEAR_B)


@query
def concentration_table(spark, d):
    return display.concentration_table(concentration.concentration(fact(spark, d)))


# --- quality --------------------------------------------------------------------------------


@query
def dq_checks(spark, d):
    """Order lines as a fact with returns, missing amounts and repeated keys in it."""
    ledger = _ledger(spark, d)
    return quality.check(ledger.select("ANO", "FILIAL", "CODFORNEC", "MES").distinct(), ledger)


def _ledger(spark, d):
    lines = purchase_lines(spark, d, "l_suppkey", ("l_returnflag", "l_discount"))
    amount = F.when(F.col("l_discount") == 0, None).when(F.col("l_returnflag") == "R", -F.col("VALOR")).otherwise(F.col("VALOR"))
    return lines.select("ANO", "FILIAL", "CODFORNEC", labels.month_name(F.col("MES_NUM")).alias("MES"), amount.alias("VALOR"))


@query
def dq_checks_clean(spark, d):
    rows = fact(spark, d)
    return quality.check(rows.select("ANO", "FILIAL", "CODFORNEC").distinct(), rows)


@query
def qa_report(spark, d):
    rows = fact(spark, d, "part")
    rows = dealt_by_rows(rows, rows.count(), "ANO", "FILIAL", "CODFORNEC")  # all groups of the report's states hold these keys
    sheets_rows = rows.select("ANO", "FILIAL", "CODFORNEC").distinct()
    return quality.report(sheets_rows, rows, YEAR_A, YEAR_B)


# --- two loads ------------------------------------------------------------------------------


def _two_loads(spark, d, table, first, second):
    """A table by year, published twice: the first load has wrong rows of the last year it knows, which the second
    replaces beside the years that follow."""
    folder = f"{shared_folder(spark)}/loads-{_mark(d)}-{uuid.uuid4().hex}"
    for rows, carry in ((first, False), (second, True)):
        version = Version(spark, folder)
        version.write(table, rows, by_year=True, carry=carry)
        version.publish()
    return read_table(spark, folder, table)


def _refreshed_states(spark, d, rows, n):
    early = rows.filter(F.col("ANO") <= YEAR_A).withColumn("VALOR", F.when(F.col("ANO") == YEAR_A, -F.col("VALOR")).otherwise(F.col("VALOR")))
    late = rows.filter(F.col("ANO") >= YEAR_A)
    return _two_loads(spark, d, "estado_compras", partials.state(early, n), partials.state(late, n))


@query
def refresh_consolidated(spark, d):
    rows = fact(spark, d)
    return partials.consolidate(_refreshed_states(spark, d, rows, rows.count()))


@query
def refresh_supplier_dim(spark, d):
    rows = _renamed_fact(spark, d).withColumn("CODCOMPRADOR", F.lit("C"))
    return partials.supplier_dim(_refreshed_states(spark, d, rows, line_count(spark, d)))


@query
def refresh_yoy_status(spark, d):
    rows = fact(spark, d, "part")
    return partials.annual_comparison(_refreshed_states(spark, d, rows, rows.count()), YEAR_A, YEAR_B)


@query
def refresh_dq_checks(spark, d):
    """The rows of dq_checks in two loads."""
    ledger = _ledger(spark, d)
    keys = ledger.select("ANO", "FILIAL", "CODFORNEC", "MES").distinct()
    early, late = F.col("ANO") <= YEAR_A, F.col("ANO") >= YEAR_A
    # in the first load the last year has no amounts
    first = partials.line_counts(keys.filter(early), ledger.filter(early).withColumn("VALOR", F.when(F.col("ANO") < YEAR_A, F.col("VALOR"))))
    return quality.findings_of(_two_loads(spark, d, "estado_linhas", first, partials.line_counts(keys.filter(late), ledger.filter(late))))


# --- forecast -------------------------------------------------------------------------------


@query
def forecast_series(spark, d):
    table = forecast.forecast_series(fact(spark, d), bounded=True)
    return _rounded(table, 2, *forecast.PROJECTION)


@query
def forecast_total(spark, d):
    table = forecast.error_bars(forecast.forecast_total(fact(spark, d)))
    return _rounded(table, 2, *forecast.PROJECTION, "ERRO_SUP", "ERRO_INF")


@query
def history_plus_forecast(spark, d):
    return _rounded(forecast.history_and_forecast(fact(spark, d)), 2, "VALOR", "IC_INF", "IC_SUP")


@query
def lag_features(spark, d):
    table = forest.lag_features(fact(spark, d), bounded=True)
    return _rounded(_double(table, "VALOR"), 2, "MEDIA_HIST").select("ANO", "CODFORNEC", "VALOR", *[c for c in forest.FEATURES if c != "ANO"])


@query
def lag_features_strict(spark, d):
    table = forest.lag_features(fact(spark, d, "part"), bounded=True, strict_past=True)
    return _rounded(_double(table, "VALOR"), 2, "MEDIA_HIST").select("ANO", "CODFORNEC", "VALOR", *[c for c in forest.FEATURES if c != "ANO"])


@query
def last_observation(spark, d):
    return _double(forest.last_observation(fact(spark, d)), "VALOR").select("FILIAL", "CODFORNEC", "ANO", "MES_NUM", "VALOR")


# --- models ---------------------------------------------------------------------------------


@query
def rf_importance(spark, d):
    return models.staged_importances(spark, d)


@query
def rf_forecast(spark, d):
    return models.staged_forest_forecast(spark, d)


@query
def rf_cv_metrics(spark, d):
    return models.staged_cv(spark, d)


@query
def forecast_final(spark, d):
    return models.staged_forecast(spark, d)


@query
def forecast_top20(spark, d):
    return forecast.top_forecasts(models.staged_forecast(spark, d), 20)


@query
def forecast_table(spark, d):
    return display.forecast_table(models.staged_forecast(spark, d))


@query
def scaled_features(spark, d):
    table = segments.scale_features(summary.supplier_features(fact(spark, d), YEAR_A, YEAR_B))
    return _rounded(table, 4, *segments.FEATURES)


@query
def kmeans_selection(spark, d):
    return models.staged_selection(spark, d)


@query
def clusters(spark, d):
    return segments.bubble_sizes(models.staged_clusters(spark, d))


@query
def cluster_profiles(spark, d):
    return segments.profiles(models.staged_clusters(spark, d))


@query
def cluster_sizes(spark, d):
    return segments.cluster_sizes(models.staged_clusters(spark, d))


@query
def cluster_table(spark, d):
    return display.cluster_table(models.staged_clusters(spark, d))


@query
def zscore_anomalies(spark, d):
    table = _double(anomalies.z_scores(fact(spark, d)), "VALOR")
    table = _rounded(table, 4, "Z_SCORE", "MEDIA_FORN", "STD_FORN")
    return table.select("ANO", "FILIAL", "CODFORNEC", "MES_NUM", "VALOR", "MEDIA_FORN", "STD_FORN", "Z_SCORE", "ANOMALIA_Z")


@query
def zscore_summary(spark, d):
    return _rounded(anomalies.z_summary(anomalies.z_scores(fact(spark, d))), 4, "PCT_Z")


@query
def zscore_histogram(spark, d):
    return anomalies.z_histogram(anomalies.z_scores(fact(spark, d)), Z_LOW, Z_HIGH)


@query
def top_anomalies(spark, d):
    return display.anomaly_table(anomalies.top_anomalies(anomalies.z_scores(fact(spark, d))))


@query
def isolation_forest(spark, d):
    return models.staged_anomalies(spark, d).select("ANO", "FILIAL", "CODFORNEC", "MES_NUM", "VALOR", "ISO_SCORE", "ANOMALIA_ISO")


@query
def anomalies_combined(spark, d):
    found = models.staged_anomalies(spark, d)
    return found.withColumn("FLAG", labels.detector_label(F.col("ANOMALIA_Z"), F.col("ANOMALIA_ISO")))


@query
def anomaly_summary(spark, d):
    return anomalies.summary(models.staged_anomalies(spark, d))


@query
def ml_report(spark, d):
    return models.report(spark, d)


# --- rules that follow the models, on model outputs that SQL can express -----------------------


def _second_forecast(spark, d):
    """Half of the largest amount, for even suppliers only."""
    even = fact(spark, d).filter(F.col("CODFORNEC") % 2 == 0)
    return even.groupBy("FILIAL", "CODFORNEC").agg((F.max("VALOR").cast("double") / 2).alias("RF_PREDICAO"))


@query
def blend_rule(spark, d):
    final = forecast.final_forecast(forecast.forecast_series(fact(spark, d), bounded=True), _second_forecast(spark, d))
    return _rounded(final, 2, "RF_PREDICAO", "PREDICAO_FINAL").select("FILIAL", "CODFORNEC", "RF_PREDICAO", "PREDICAO_FINAL")


@query
def top_forecast_rule(spark, d):
    final = forecast.final_forecast(forecast.forecast_series(fact(spark, d), bounded=True), _second_forecast(spark, d))
    return _rounded(forecast.top_forecasts(final, 20), 2, "ensemble", "ic_inf", "ic_sup", "PREDICAO_FINAL")


def _by_region(spark, d):
    """Supplier features with the supplier's region as its cluster."""
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("CLUSTER"))
    region = read_table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("CODFORNEC"), "CLUSTER")
    return summary.supplier_features(fact(spark, d), YEAR_A, YEAR_B).join(region, "CODFORNEC")


def _labelled(spark, d):
    rows = _by_region(spark, d)
    return rows.join(segments.profiles(rows).select("CLUSTER", "CLUSTER_ROTULO"), "CLUSTER")


@query
def cluster_profile_rule(spark, d):
    return _rounded(segments.profiles(_by_region(spark, d)), 4, "total", "cv", "growth")


@query
def cluster_size_rule(spark, d):
    return segments.cluster_sizes(_labelled(spark, d))


@query
def cluster_table_rule(spark, d):
    return display.cluster_table(_labelled(spark, d))


@query
def bubble_rule(spark, d):
    return _rounded(segments.bubble_sizes(_by_region(spark, d)), 4, "TAMANHO").select("CODFORNEC", "TAMANHO")


def _december(spark, d):
    """z-scores, with every December flagged by the second detector."""
    scored = anomalies.z_scores(fact(spark, d)).withColumn("ANOMALIA_ISO", F.col("MES_NUM") == 12)
    return scored.withColumn("ANOMALIA", F.col("ANOMALIA_Z") | F.col("ANOMALIA_ISO"))


@query
def detector_rule(spark, d):
    rows = _december(spark, d).withColumn("FLAG", labels.detector_label(F.col("ANOMALIA_Z"), F.col("ANOMALIA_ISO")))
    return rows.select("ANO", "FILIAL", "CODFORNEC", "MES_NUM", "ANOMALIA", "FLAG")


@query
def detector_summary_rule(spark, d):
    return _rounded(anomalies.summary(_december(spark, d)), 4, "PCT_TOTAL")


@query
def percentile_flag(spark, d):
    rows = fact(spark, d)
    flagged = anomalies.flag_lowest(rows.withColumn("_s", F.col("VALOR").cast("double")))
    return _rounded(flagged, 2, "ISO_SCORE").select("ANO", "FILIAL", "CODFORNEC", "MES_NUM", "ISO_SCORE", "ANOMALIA_ISO")
