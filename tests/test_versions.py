"""Published versions, and tables that follow from partial states."""

import random

import pytest
from pyspark.sql import functions as F

from procura.operators import partials, quality, selection, summary
from procura.plans import bundle, etl, ml
from procura.sources import versions
from procura.sources.tables import read_table

HEAD = "CODFORNEC,FILIAL,FORNECEDOR,FANTASIA,CODCOMPRADOR,JANEIRO,FEVEREIRO"


def workbook(root, year, extra=0, repeat=False):
    folder = root / f"COMPRAS {year}"
    folder.mkdir(parents=True, exist_ok=True)
    for n in range(1, 5):
        rows = [f"{s},{n},FORN {s} SA,,C{s % 2},{s * 10 + n + extra},{s * 9 + n}" for s in range(year - 2024, 9)]
        (folder / f"FILIAL {n}.csv").write_text("\n".join([HEAD, *rows, *(rows[:1] if repeat else [])]) + "\n")
    return {year: str(folder)}


def shown(spark, staging):
    """All tables as a reader sees them, and whether they belong together."""
    tables = {name: read_table(spark, staging, name) for name in ("fato_compras", "consolidado_trimestre", "comparativo_anual", "dim_fornecedor")}
    fact = tables["fato_compras"]
    total = fact.agg(F.sum("VALOR")).first()[0]
    assert float(total) == pytest.approx(tables["consolidado_trimestre"].agg(F.sum("TOTAL_TRI")).first()[0])
    assert float(total) == pytest.approx(sum(tables["comparativo_anual"].agg(F.sum("TOTAL_2025"), F.sum("TOTAL_2026")).first()))
    assert fact.count() == tables["dim_fornecedor"].agg(F.sum("N_REGISTROS")).first()[0]
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in tables.items()}


@pytest.fixture
def books(tmp_path):
    return {**workbook(tmp_path / "one", 2025), **workbook(tmp_path / "one", 2026)}


@pytest.mark.parametrize("broken", ["consolidate", "annual_comparison", "supplier_dim"])
def test_a_load_that_fails_between_the_writes_shows_the_old_version(spark, tmp_path, books, monkeypatch, broken):
    staging, outputs = str(tmp_path / "staging"), str(tmp_path / "out")
    assert etl.main(spark, books, staging, outputs, 2025, 2026, plain=False) == 0
    before, name = shown(spark, staging), versions.current(spark, staging)["version"]
    new = workbook(tmp_path / "two", 2026, extra=5)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(partials, broken, fail)
        with pytest.raises(OSError, match="lost"):
            etl.main(spark, new, staging, outputs, 2025, 2026, refresh=True, plain=False)
    assert shown(spark, staging) == before and versions.current(spark, staging)["version"] == name
    # the same load without the fault goes through
    assert etl.main(spark, new, staging, outputs, 2025, 2026, refresh=True, plain=False) == 0
    assert shown(spark, staging) != before
    entry = versions.current(spark, staging)["tables"]["fato_compras"]
    assert sorted(y for f in entry["folders"] for y in f["years"]) == ["ANO=2025", "ANO=2026"] and len(entry["folders"]) == 2
    gone = versions.drop_unused(spark, staging)
    assert len(gone) == 1 and name not in gone and shown(spark, staging)  # the failed one; 2025 still comes from the first


def test_failed_checks_publish_only_on_request(spark, tmp_path, books):
    staging, outputs = str(tmp_path / "staging"), str(tmp_path / "out")
    etl.main(spark, books, staging, outputs, 2025, 2026, plain=False)
    before = shown(spark, staging)
    bad = workbook(tmp_path / "bad", 2026, repeat=True)
    assert etl.main(spark, bad, staging, outputs, 2025, 2026, refresh=True, plain=False) == 1
    assert shown(spark, staging) == before
    assert etl.main(spark, bad, staging, outputs, 2025, 2026, refresh=True, plain=False, publish_failed=True) == 1
    assert shown(spark, staging) != before
    # the fault stays known when another year is refreshed, though only that year is read
    assert etl.main(spark, {2025: books[2025]}, staging, outputs, 2025, 2026, refresh=True, plain=False) == 1


def test_two_loads_at_once(spark, tmp_path):
    staging = str(tmp_path / "s")
    rows = spark.createDataFrame([(2025, 1)], "ANO int, v int")
    first, second = versions.Version(spark, staging), versions.Version(spark, staging)
    for v in (first, second):
        v.write("t", rows, by_year=True)
    first.publish()
    with pytest.raises(RuntimeError, match="meanwhile"):
        second.publish()
    assert versions.table(spark, staging, "t").collect() == rows.collect()
    assert versions.table(spark, staging, "other") is None and versions.table(spark, str(tmp_path), "t") is None
    empty = versions.Version(spark, staging)
    empty.write("t", rows.limit(0), by_year=True)
    empty.publish()
    assert versions.table(spark, staging, "t").columns == ["ANO", "v"] and versions.table(spark, staging, "t").count() == 0


def test_analytics_join_the_version_and_leave_with_the_next_load(spark, tmp_path, books):
    staging, outputs = str(tmp_path / "staging"), str(tmp_path / "out")
    etl.main(spark, books, staging, outputs, 2025, 2026, plain=False)
    ml.main(spark, staging, outputs, 2025, 2026, trees=3)
    tables = bundle.load(spark, staging)
    assert bundle.has_analytics(tables) and tables["anomalias"].count() == tables["fato"].count()
    etl.main(spark, workbook(tmp_path / "two", 2026, 3), staging, outputs, 2025, 2026, refresh=True, plain=False)
    assert not bundle.has_analytics(bundle.load(spark, staging))


def test_states_give_the_tables_of_the_fact(spark, make_fact):
    rng = random.Random(3)
    rows = [
        (2020 + i % 3, rng.choice([1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice(["A", "B", None]), 1 + rng.randrange(12), rng.choice([None, "0", "-3.5", "12.25", "9999999999999.99"]))
        for i in range(300)
    ]
    fact = make_fact(rows)
    states = partials.state(fact.filter("ANO < 2022")).unionByName(partials.state(fact.filter("ANO >= 2022")))
    table = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert table(partials.supplier_dim(states)) == table(summary.supplier_dim(fact))
    assert table(partials.annual_comparison(states, 2020, 2022)) == table(summary.annual_comparison(fact, 2020, 2022))
    assert table(partials.consolidate(states).drop("DESVIO")) == table(summary.consolidate(fact).drop("DESVIO"))
    deviations = partials.consolidate(states).join(
        summary.consolidate(fact).select("ANO", "FILIAL", "CODFORNEC", "FANTASIA", F.col("DESVIO").alias("other")), ["ANO", "FILIAL", "CODFORNEC", "FANTASIA"]
    )
    assert all(r.DESVIO == pytest.approx(r.other, rel=1e-9, abs=0.011) for r in deviations.collect())
    counts = partials.line_counts(fact.select("ANO", "FILIAL", "CODFORNEC"), fact)
    parts = [partials.line_counts(fact.filter(c).select("ANO", "FILIAL", "CODFORNEC"), fact.filter(c)) for c in ("ANO < 2022", "ANO >= 2022")]
    assert table(counts) == table(parts[0].unionByName(parts[1]))
    assert table(quality.findings_of(counts)) == table(quality.check(fact.select("ANO", "FILIAL", "CODFORNEC"), fact))


def test_large_equal_amounts_have_no_deviation(make_fact):
    fact = make_fact([(2025, 1, 1, "A", m, "9999999999999.37") for m in range(1, 8)])
    assert partials.consolidate(partials.state(fact)).first().DESVIO == 0


def test_report_reads_the_fact_twice(spark, make_fact, tmp_path):
    make_fact([(2025, 1, 1, "A", m, "5") for m in range(1, 4)]).write.parquet(f"{tmp_path}/f")
    fact = spark.read.parquet(f"{tmp_path}/f")
    report = quality.report(fact.select("ANO", "FILIAL", "CODFORNEC").distinct(), fact, 2025, 2026)
    assert "linhas_consolidado" in {r.ITEM for r in report.collect()}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert not any(str(file).split("/")[-1] in plan for file in fact.inputFiles()) and set(report.inputFiles()).isdisjoint(fact.inputFiles())


def test_activity_by_year(make_fact):
    found = selection.activity_by_year(make_fact([(2024, 1, 1, "A", 2, "5"), (2025, 1, 1, "A", 12, "7"), (2025, 1, 2, "B", 12, "1")])).collect()
    assert len(found) == 24 and {(r.ANO, r.MES_NUM, r.N, r.VALOR) for r in found if r.ATIVO} == {(2024, 2, 1, 5.0), (2025, 12, 2, 8.0)}
