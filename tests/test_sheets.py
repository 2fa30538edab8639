"""Sheets, contract, sinks and the two batch runs, on files in a temporary folder."""

import gzip

import pytest
from pyspark.sql import functions as F

from procura.operators import profile, summary
from procura.plans import bundle, etl, ml
from procura.schema import FACT_COLUMNS, WIDE_COLUMNS
from procura.sources import sheets
from procura.sources.tables import optional_table, read_table, write_csv, write_fact

HEAD = "CODFORNEC,FILIAL,FORNECEDOR,FANTASIA,CODCOMPRADOR,JANEIRO,FEVEREIRO"


def put(folder, sheet, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{sheet}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture
def book(tmp_path):
    folder = tmp_path / "TRIMESTRES 2025"
    put(folder, "FILIAL 1", " codfornec ,Filial,Fornecedor,rep_obs,CodComprador,Janeiro,MARÇO,TOTAL",
        "7,1, acme do  brasil ,,c1, 12 ,9,1", "8,1.0,Beta,nan,None,abc,9,1")
    put(folder, "FILIAL 2", HEAD, "7,2,ACME,Acme Loja,C1,1e3,5", "9,2,,<NA>,C2,\"1,5\",nan")
    put(folder, "FILIAL 3", HEAD, "7,3,ACME,A,C1,1,0")
    put(folder, "FILIAL 4", HEAD, "7,4,ACME,A,C1,2,0", "7,4,ACME,A,C1,3,0")
    put(folder, "RESUMO", "TEXTO", "qualquer")
    return str(folder)


def test_scan(spark, book):
    table = sheets.scan_workbooks(spark, [book])
    assert table.columns == WIDE_COLUMNS
    got = {(r.FILIAL, r.CODFORNEC, r.JANEIRO): r for r in table.collect()}
    first = got[1, 7, " 12 "] if (1, 7, " 12 ") in got else got[1, 7, "12"]
    assert (first.ANO, first.FORNECEDOR, first.FANTASIA, first.CODCOMPRADOR, first.MARCO) == (2025, "ACME DO  BRASIL", "ACME DO", "C1", None)
    beta = got[1, 8, "abc"]
    assert (beta.FANTASIA, beta.CODCOMPRADOR) == ("BETA", None)
    blank = got[2, 9, "1,5"]
    assert (blank.FORNECEDOR, blank.FANTASIA) == (None, None)
    assert len(got) == 7


def test_year_from_caller(spark, book):
    assert {r.ANO for r in sheets.scan_workbooks(spark, {2031: book}).collect()} == {2031}


def test_branch_guard(spark, tmp_path):
    folder = tmp_path / "C 2025"
    put(folder, "FILIAL 1", HEAD, "7,1,A,A,C,1,1", "8,2,A,A,C,1,1", "9,,A,A,C,1,1")
    raw = sheets.read_sheets(spark, sheets.list_sheets(spark, str(folder)))
    assert sorted(r.CODFORNEC for r in sheets.branch_mismatches(raw).collect()) == ["8", "9"]
    with pytest.raises(Exception, match="FILIAL differs"):
        sheets.wide_table(raw).collect()
    with pytest.raises(Exception, match="FILIAL differs"):
        sheets.wide_table(raw).count()
    with pytest.raises(Exception, match="FILIAL differs"):
        sheets.wide_table(raw).agg(F.sum("JANEIRO")).collect()
    assert sheets.wide_table(raw, strict=False).count() == 3


def test_no_file_is_lost(spark, tmp_path):
    folder = tmp_path / "C 2025"
    put(folder, "FILIAL 1", HEAD, "7,1,A,A,C,1,2")
    with gzip.open(folder / "FILIAL 2.csv.gz", "wt") as file:
        file.write(HEAD + "\n7,2,A,A,C,3,4\n")
    (folder / "FILIAL 3.CSV").write_text(HEAD + "\n7,3,A,A,C,5,6\n")
    put(folder / "FILIAL 5", "part-0", HEAD, "7,5,A,A,C,7,8")
    put(folder / "FILIAL 5", "part-1", HEAD.replace("JANEIRO,FEVEREIRO", "FEVEREIRO,JANEIRO"), "8,5,A,A,C,10,9")
    (folder / "notes.txt").write_text("x")
    with pytest.warns(UserWarning, match="notes.txt"):
        table = sheets.scan_workbooks(spark, [str(folder)])
    got = {(r.FILIAL, r.CODFORNEC): (r.JANEIRO, r.FEVEREIRO) for r in table.collect()}
    assert got == {(1, 7): ("1", "2"), (2, 7): ("3", "4"), (3, 7): ("5", "6"), (5, 7): ("7", "8"), (5, 8): ("9", "10")}
    names = [f"FILIAL {n}" for n in (1, 2, 3, 5)]
    rows = [(r.NIVEL, r.LINHAS) for r in sheets.validate_workbooks(spark, [str(folder), str(tmp_path / "none")], names).orderBy("WORKBOOK", "ORDEM").collect()]
    assert rows == [("AVISO", 0), ("OK", 5), ("ERRO", 0)]


def test_workbooks_of_one_name(spark, tmp_path):
    for year in (2025, 2026):
        put(tmp_path / str(year) / "COMPRAS", "FILIAL 1", HEAD, f"{year},1,A,A,C,1,2")
    books = {y: str(tmp_path / str(y) / "COMPRAS") for y in (2025, 2026)}
    assert {(r.ANO, r.CODFORNEC) for r in sheets.scan_workbooks(spark, books).collect()} == {(2025, 2025), (2026, 2026)}
    assert sheets.validate_workbooks(spark, list(books.values()), ["FILIAL 1"]).count() == 2


def test_refresh_equals_a_full_load(spark, tmp_path):
    for year in (2025, 2026):
        for n in range(1, 5):
            rows = [f"{s},{n},FORN {s} SA,,C{s % 2},{s * 10 + n + year - 2025},{s * 9 + n}" for s in range(year - 2024, 9)]
            put(tmp_path / "raw" / f"COMPRAS {year}", f"FILIAL {n}", HEAD, *rows)
    books = {y: str(tmp_path / "raw" / f"COMPRAS {y}") for y in (2025, 2026)}
    full, again = str(tmp_path / "full"), str(tmp_path / "again")
    for target in (full, again):
        etl.main(spark, books, target, str(tmp_path / "out"), 2025, 2026)
    etl.main(spark, {2026: books[2026]}, again, str(tmp_path / "out"), 2025, 2026, refresh=True)
    for name in ("fato_compras", "consolidado_trimestre", "comparativo_anual", "dim_fornecedor"):
        one, two = (sorted(map(str, read_table(spark, d, name).select(sorted(read_table(spark, d, name).columns)).collect())) for d in (full, again))
        assert one == two and one


def findings(spark, *books):
    return [(r.NIVEL, r.MENSAGEM, r.LINHAS, r.OK) for r in sheets.validate_workbooks(spark, list(books)).orderBy("WORKBOOK", "ORDEM").collect()]


def test_contract(spark, book, tmp_path):
    assert findings(spark, book) == [
        ("AVISO", "aba fora da lista: RESUMO", 0, True), ("OK", "7 linhas em 4 abas", 7, True),
    ]
    few = tmp_path / "B 2026"
    put(few, "FILIAL 1", HEAD, "7,1,A,A,C,1,1")
    (level, message, _, ok), = findings(spark, str(few))
    assert level == "ERRO" and "FILIAL 2" in message and not ok
    for n in (2, 3, 4):
        put(few, f"FILIAL {n}", HEAD, f"7,{n},A,A,C,1,1")
    put(few, "FILIAL 3", "CODFORNEC,FILIAL,JANEIRO", "7,3,1")
    assert findings(spark, str(few)) == [("ERRO", "FILIAL 3: colunas ausentes CODCOMPRADOR, FORNECEDOR", 0, False)]
    put(few, "FILIAL 3", "CODFORNEC,FILIAL,FORNECEDOR,CODCOMPRADOR,MARÇO", "7,3,A,C,1")
    assert findings(spark, str(few))[0][1].startswith("FILIAL 3: nenhuma coluna de mês")
    assert sheets.year_clashes([book, str(few), "/x/OUTRA 2025"]) == {"2025": [book, "/x/OUTRA 2025"]}


def test_headers(spark):
    df = spark.createDataFrame([(1, "a", "b", 2, 3)], "` codfornec ` int, nome string, apelido string, Total int, media int")
    fixed = sheets.repair_headers(df)
    assert fixed.columns == ["CODFORNEC", "FANTASIA", "APELIDO"]
    assert set(WIDE_COLUMNS) <= set(sheets.pad_columns(fixed).columns) | {"ANO", "FILIAL"}


def test_load_and_analytics_runs(spark, tmp_path):
    for year in (2025, 2026):
        for n in range(1, 5):
            rows = [f"{s},{n},FORN {s} SA,,C{s % 2},{s * 10 + n + year - 2025},{s * 9 + n}" for s in range(1, 9)]
            put(tmp_path / "raw" / f"COMPRAS {year}", f"FILIAL {n}", HEAD, *rows)
    books = {y: str(tmp_path / "raw" / f"COMPRAS {y}") for y in (2025, 2026)}
    staging, outputs = str(tmp_path / "staging"), str(tmp_path / "outputs")
    assert etl.main(spark, books, staging, outputs, 2025, 2026) == 0
    fact = spark.read.parquet(f"{staging}/fato_compras.parquet")
    assert fact.count() == 2 * 4 * 8 * 2
    assert read_table(spark, staging, "comparativo_anual").count() == 8
    report = [r.value for r in spark.read.text(f"{outputs}/qa_report").collect()]
    assert "VALIDACOES: OK: nada a corrigir" in report

    ml.main(spark, staging, outputs, 2025, 2026, trees=5)
    forecast = read_table(spark, staging, "forecast")
    assert {"RF_PREDICAO", "PREDICAO_FINAL", "ensemble"} <= set(forecast.columns) and forecast.count() == 32
    assert read_table(spark, staging, "anomalias").count() == fact.count()
    assert read_table(spark, staging, "metricas_avancadas").filter("ESCOPO = 'GERAL'").count() == 1
    assert spark.read.option("header", True).csv(f"{outputs}/clusters.csv").count() == 8
    assert len(spark.read.text(f"{outputs}/ml_report").collect()) > 15
    assert optional_table(spark, staging, "nada") is None
    assert optional_table(spark, staging, "clusters").count() == 8

    tables = bundle.load(spark, staging)
    assert bundle.has_analytics(tables) and set(tables) == {*bundle.REQUIRED, *bundle.OPTIONAL}
    bundle.export_filtered(
        tables, f"{outputs}/filtrado.csv", years=[2026], branches=[1, 2], buyers=["C0", "C1"], months=["JANEIRO"], suppliers=[3]
    )
    assert spark.read.option("header", True).csv(f"{outputs}/filtrado.csv").count() == 2

    # a rerun for one year leaves the other alone
    only = fact.filter("ANO = 2026").withColumn("VALOR", F.lit(1).cast("decimal(18,2)")).select(*FACT_COLUMNS)
    write_fact(spark.createDataFrame(only.collect(), only.schema), f"{staging}/fato_compras.parquet", refresh=True)
    again = spark.read.parquet(f"{staging}/fato_compras.parquet")
    assert again.filter("ANO = 2025").count() == 64 and {float(r.VALOR) for r in again.filter("ANO = 2026").collect()} == {1.0}


def test_bad_load_fails(spark, book, tmp_path):
    assert etl.main(spark, {2025: book}, str(tmp_path / "s"), str(tmp_path / "o"), 2025, 2026) == 1  # repeated supplier


def test_csv_and_profile(spark, make_fact, tmp_path):
    fact = make_fact([(2025, 1, 1, "A", 1, "5"), (2025, 1, 2, None, 1, "5")])
    write_csv(summary.consolidate(fact), str(tmp_path / "c.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c.csv")).count() == 1
    rows = {r.COLUNA: (r.TIPO, r.N_LINHAS, r.N_NULOS) for r in profile.table_profile(fact).collect()}
    assert rows["FANTASIA"] == ("string", 2, 1) and rows["VALOR"] == ("decimal(18,2)", 2, 0)
    assert profile.head(fact, 1).count() == 1
