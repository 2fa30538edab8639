"""Models over the test tables, fitted once per application: every stage is written under the shared folder, and later
queries read the written tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from procura.operators import anomalies, concentration, forecast, forest, segments, summary
from procura.plans import ml
from procura.sources.retail import fact
from procura.sources.tables import staged

_models: dict[tuple, object] = {}
_lock = threading.RLock()
YEAR_A, YEAR_B = 1999, 2000


def _features(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "lag-features", lambda: forest.lag_features(fact(spark, d), bounded=True))


def _model(spark: SparkSession, d: str):
    key = (spark.sparkContext.applicationId, d)
    with _lock:
        if key not in _models:
            _models[key] = forest.fit(_features(spark, d))
        return _models[key]


def staged_importances(spark: SparkSession, d: str) -> DataFrame:
    return forest.importances(spark, _model(spark, d))


def staged_forest_forecast(spark: SparkSession, d: str) -> DataFrame:
    return staged(
        spark, d, "rf-forecast", lambda: forest.forest_forecast(fact(spark, d), _features(spark, d), _model(spark, d))
    )


def staged_cv(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "rf-cv", lambda: forest.cross_validate(_features(spark, d)))


def staged_forecast(spark: SparkSession, d: str) -> DataFrame:
    return staged(
        spark, d, "forecast",
        lambda: forecast.final_forecast(
            forecast.forecast_series(fact(spark, d), bounded=True), staged_forest_forecast(spark, d)
        ),
    )


def _segment(spark: SparkSession, d: str) -> None:
    clustered, choice = segments.segment(summary.supplier_features(fact(spark, d), YEAR_A, YEAR_B))
    staged(spark, d, "clusters", lambda: clustered)
    staged(spark, d, "kmeans", lambda: ml.selection_table(spark, choice))


def staged_clusters(spark: SparkSession, d: str) -> DataFrame:
    with _lock:
        key = (spark.sparkContext.applicationId, d, "segments")
        if key not in _models:
            _segment(spark, d)
            _models[key] = True
    return staged(spark, d, "clusters", lambda: None)


def staged_selection(spark: SparkSession, d: str) -> DataFrame:
    staged_clusters(spark, d)
    return staged(spark, d, "kmeans", lambda: None)


def staged_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "anomalias", lambda: anomalies.anomalies(fact(spark, d)))


def report(spark: SparkSession, d: str) -> DataFrame:
    return ml.report_lines(
        {
            "rf_metricas": staged_cv(spark, d),
            "rf_importancias": staged_importances(spark, d),
            "forecast_total": forecast.forecast_total(fact(spark, d)),
            "kmeans_escolha": staged_selection(spark, d),
            "clusters": staged_clusters(spark, d),
            "anomalias": staged_anomalies(spark, d),
            "metricas_avancadas": concentration.concentration(fact(spark, d)),
        }
    )
