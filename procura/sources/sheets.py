"""Wide sheets: one workbook per year, one sheet per branch, one row per supplier.

A workbook is a folder; each sheet is a sub-folder of part files or one file, CSV or Parquet:
<root>/COMPRAS 2025/FILIAL 1.csv or <root>/COMPRAS 2025/FILIAL 1/part-*.csv.
Extensions may be in capitals or name a compression. Files with the same header are read by one scan.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from csv import reader
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procura.functions.text import branch_in_sheet, clean_text, name_or_fallback, strip, year_in_name
from procura.schema import (
    DERIVED_COLUMNS,
    EXPECTED_SHEETS,
    MONTHS,
    NAME_ALIASES,
    REQUIRED_COLUMNS,
    WIDE_COLUMNS,
)
from procura.sources.headers import SCHEMES, with_headers

SHEET_PATTERN = r"^FILIAL\s+\d+$"
# .../<workbook>/<sheet>[/part-*]; folders may be written as name=value
_EXTENSION = r"\.(csv|parquet)(?:\.(gz|bz2|zst|lz4|snappy))?$"
_PATH_PARTS = r"^(.*?/(?:[^/=]+=)?([^/]+))/(?:[^/=]+=)?([^/]+?)(?:(?i)" + _EXTENSION[:-1] + r")?(?:/part-[^/]*)?$"


@dataclass(frozen=True)
class Sheet:
    """One file of a sheet. root: path of the workbook folder."""

    workbook: str
    name: str
    path: str
    kind: str
    columns: tuple[str, ...] = ()
    root: str = ""

    @property
    def headers(self) -> list[str]:
        return normal_headers(list(self.columns))


def normal_headers(columns: list[str]) -> list[str]:
    return [c.strip().upper() for c in columns]


def _plain(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _provenance(path: Column) -> tuple[Column, Column, Column]:
    """Root and name of the workbook, name of the sheet."""
    return tuple(F.regexp_extract(_plain(path), _PATH_PARTS, i) for i in (1, 2, 3))


def _files(spark: SparkSession, *workbooks: str) -> DataFrame:
    """Every file of the workbook folders: file, path, root, workbook, name, kind (null if it cannot be read), packed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(workbooks))
    file = F.col("_metadata.file_path")
    root, workbook, name = _provenance(file)
    kind, packed = (F.lower(F.regexp_extract(_plain(file), "(?i)" + _EXTENSION, i)) for i in (1, 2))
    return files.select(
        file.alias("file"), _plain(file).alias("path"), root.alias("root"), workbook.alias("workbook"), name.alias("name"),
        F.nullif(kind, F.lit("")).alias("kind"), packed.alias("packed"),
    )


def _scanned_headers(spark: SparkSession, files: list[Row]) -> dict[str, list[str]]:
    """Headers by Spark's own readers, for files that a task cannot open by itself: one text scan that keeps the first
    line of every CSV file, and the schema of each Parquet file."""
    found = {r.file: spark.read.parquet(r.path).columns for r in files if r.kind == "parquet"}
    csv = [r.path for r in files if r.kind == "csv"]
    if csv:
        text = spark.read.text(csv).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
        lines = text.filter("at = 0 and trim(value) <> ''").withColumn("n", F.monotonically_increasing_id())
        first = lines.groupBy("file").agg(F.min_by("value", "n").alias("line"))
        found |= {r.file: next(reader([r.line.removeprefix("\ufeff")]), []) for r in first.collect()}
    return found


def list_sheets(spark: SparkSession, *workbooks: str, schemes: tuple[str, ...] = SCHEMES) -> list[Sheet]:
    """Files of the workbook folders with their raw headers, in order of workbook and sheet.

    Tasks open the files side by side and read the first record or the footer only, so part files of one sheet may order
    their columns differently. schemes: the stores they open; files elsewhere take Spark's readers. The list has a row per
    file, as Spark's own file index has.
    """
    files = with_headers(_files(spark, *workbooks).filter("kind is not null"), schemes).collect()
    scanned = _scanned_headers(spark, [r for r in files if r.header is None])
    header = lambda r: tuple(scanned.get(r.file, ()) if r.header is None else r.header)
    return [Sheet(r.workbook, r.name, r.path, r.kind, header(r), r.root) for r in sorted(files, key=lambda r: (r.root, r.name, r.path))]


def read_sheets(spark: SparkSession, sheets: list[Sheet]) -> DataFrame:
    """All sheets as text with clean headers, plus ROOT, WORKBOOK and SHEET. Files are grouped by their own header."""
    same: dict[tuple, list[Sheet]] = defaultdict(list)
    for sheet in sheets:
        if sheet.columns:
            same[(sheet.kind, sheet.columns)].append(sheet)
    parts = []
    for (kind, columns), group in same.items():
        source = spark.read.format(kind)
        if kind == "csv":
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            broken = any("\n" in c or "\r" in c for c in columns)  # such a file is read by one task
            source = source.option("header", True).option("multiLine", broken).schema(schema)
        raw = source.load([s.path for s in group])
        raw = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns], *_provenance(F.col("_metadata.file_path")))
        parts.append(repair_headers(raw.toDF(*columns, "ROOT", "WORKBOOK", "SHEET")))
    if not parts:
        raise ValueError("no sheet to read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def repair_headers(df: DataFrame) -> DataFrame:
    """Trim and upper-case headers, take the first known alias for FANTASIA, drop derived columns."""
    df = df.toDF(*normal_headers(df.columns))
    if "FANTASIA" not in df.columns:
        alias = next((a for a in NAME_ALIASES if a in df.columns), None)
        if alias:
            df = df.withColumnRenamed(alias, "FANTASIA")
    return df.drop(*DERIVED_COLUMNS)


def pad_columns(df: DataFrame) -> DataFrame:
    """Add absent month and name columns as nulls."""
    missing = [c for c in [*MONTHS, "FORNECEDOR", "FANTASIA", "CODCOMPRADOR"] if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing})


def clean_names(df: DataFrame) -> DataFrame:
    df = df.withColumns({c: clean_text(F.col(c)) for c in ("FORNECEDOR", "FANTASIA", "CODCOMPRADOR")})
    return df.withColumn("FANTASIA", name_or_fallback(F.col("FANTASIA"), F.col("FORNECEDOR")))


def branch_mismatches(df: DataFrame, branch: str = "FILIAL", sheet: str = "SHEET") -> DataFrame:
    """Rows whose branch column is not the number in the sheet name; a null branch is a mismatch."""
    number = F.col(branch).cast("string").try_cast("double")
    return df.filter(~number.eqNullSafe(branch_in_sheet(F.col(sheet)).cast("double")))


def wide_table(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Raw sheets (SHEET and ANO or WORKBOOK present) to the fixed wide schema.

    strict: a row whose FILIAL contradicts its sheet fails the job that reads it.
    """
    sheet_branch = branch_in_sheet(F.col("SHEET"))
    if "FILIAL" in raw.columns and strict:
        number = F.col("FILIAL").cast("string").try_cast("double")
        agrees = number.eqNullSafe(sheet_branch.cast("double"))
        fault = F.raise_error(F.concat(F.col("SHEET"), F.lit(": FILIAL differs from the sheet name")))
        raw = raw.filter(F.when(agrees, F.lit(True)).otherwise(fault.cast("boolean")))  # a filter is never pruned away
    year = F.col("ANO").cast("int") if "ANO" in raw.columns else year_in_name(F.col("WORKBOOK"))
    df = pad_columns(raw).withColumns({"ANO": year, "FILIAL": sheet_branch})
    code = F.col("CODFORNEC").cast("string")
    df = df.withColumn("CODFORNEC", F.coalesce(code.try_cast("long"), code.try_cast("double").try_cast("long")))
    return clean_names(df).select(*WIDE_COLUMNS)


def _root_of(roots: set[str], path: str) -> str:
    """The root as it stands in file paths, for a workbook path as the caller wrote it."""
    tail = "/" + re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", path.rstrip("/")).lstrip("/")
    return next((r for r in roots if r == path.rstrip("/") or r.endswith(tail)), path)


def scan_workbooks(
    spark: SparkSession,
    workbooks: dict[int, str] | list[str],
    strict: bool = True,
    pattern: str = SHEET_PATTERN,
    expected: list[str] | None = None,
) -> DataFrame:
    """Wide table of every branch sheet; sheets whose name is not a branch are left out.

    A dict gives the year of each workbook; a list takes it from the folder names. expected: the sheets to load, as given
    to validate_workbooks; None loads every name that fits the pattern. Files of other formats give a warning.
    """
    paths = list(workbooks.values()) if isinstance(workbooks, dict) else list(workbooks)
    for path in unread_files(spark, paths):
        warnings.warn(f"not read: {path}", stacklevel=2)
    wanted = lambda name: name in expected if expected else re.match(pattern, name)
    sheets = [s for s in list_sheets(spark, *paths) if wanted(strip_upper(s.name))]
    raw = read_sheets(spark, sheets)
    if isinstance(workbooks, dict):
        roots = {s.root for s in sheets}
        years = spark.createDataFrame([(_root_of(roots, path), year) for year, path in workbooks.items()], "ROOT string, ANO int")
        raw = raw.drop("ANO").join(F.broadcast(years), "ROOT")  # one row a workbook
    return wide_table(raw, strict)


def unread_files(spark: SparkSession, workbooks: list[str]) -> list[str]:
    """Files in the workbook folders that are neither CSV nor Parquet."""
    return sorted(r.path for r in _files(spark, *workbooks).filter("kind is null").collect())


def _contract_findings(sheets: list[Sheet], expected: list[str]) -> list[tuple[str, str]]:
    """Findings from names and headers alone. The checks stop at the first error."""
    by_name: dict[str, list[Sheet]] = defaultdict(list)
    for sheet in sheets:
        by_name[sheet.name].append(sheet)
    names = {strip_upper(n) for n in by_name}
    missing = [e for e in expected if e not in names]
    if missing:
        return [("ERRO", f"sem as abas {', '.join(missing)}")]
    found = []
    for name, files in by_name.items():
        if strip_upper(name) not in expected:
            found.append(("AVISO", f"aba fora da lista: {name}"))
            continue
        absent = sorted(set(REQUIRED_COLUMNS) - set.intersection(*[set(f.headers) for f in files]))
        if absent:
            return [*found, ("ERRO", f"{name}: colunas ausentes {', '.join(absent)}")]
        if not all(set(MONTHS) & set(f.headers) for f in files):
            return [*found, ("ERRO", f"{name}: nenhuma coluna de mês")]
    return found


def validate_workbooks(spark: SparkSession, workbooks: list[str], expected: list[str] = EXPECTED_SHEETS) -> DataFrame:
    """Findings per workbook: WORKBOOK, ANO, ORDEM, NIVEL, MENSAGEM, LINHAS, COLUNAS, OK. COLUNAS counts the distinct headers
    of the expected sheets.

    A folder that cannot be opened is a finding of its own. Rows of the expected sheets of all sound workbooks are
    counted by one scan.
    """
    sheets, unread = [], []
    closed: dict[str, str] = {}
    for path in workbooks:
        try:
            sheets += list_sheets(spark, path)
            unread += unread_files(spark, [path])
        except AnalysisException as error:
            closed[path.rstrip("/")] = error.getCondition() or "erro de leitura"
    roots = {s.root for s in sheets}
    by_book: dict[str, list[Sheet]] = {_root_of(roots, w): [] for w in workbooks if w.rstrip("/") not in closed}
    for sheet in sheets:
        by_book.setdefault(sheet.root, []).append(sheet)
    findings = {book: _contract_findings(own, expected) for book, own in by_book.items()}
    for path in unread:
        book = next((b for b in by_book if path.startswith(b + "/")), None)
        if book is not None:
            findings[book].insert(0, ("AVISO", f"arquivo de outro formato: {path[len(book) + 1:]}"))
    findings |= {path: [("ERRO", f"pasta ilegível: {why}")] for path, why in closed.items()}
    failed = {book for book, found in findings.items() if any(level == "ERRO" for level, _ in found)}
    title = lambda root: root.rstrip("/").split("/")[-1].split("=")[-1]
    wanted = {b: [s for s in own if strip_upper(s.name) in expected] for b, own in by_book.items()}
    headers = {b: len({h for s in own for h in s.headers}) for b, own in wanted.items()}
    notes = [
        (title(book), i, level, text, 0, headers.get(book, 0), book not in failed)
        for book, found in findings.items()
        for i, (level, text) in enumerate(found)
    ]
    lines = spark.createDataFrame(
        notes, "WORKBOOK string, ORDEM int, NIVEL string, MENSAGEM string, LINHAS long, COLUNAS int, OK boolean"
    )
    good = [s for b, own in wanted.items() if b not in failed for s in own]
    if good:
        books = spark.createDataFrame([(b, len(findings[b]), headers[b]) for b in by_book if b not in failed], "ROOT string, ORDEM int, COLUNAS int")
        passed = read_sheets(spark, good).groupBy("ROOT", "WORKBOOK").agg(F.count("*").alias("LINHAS")).join(F.broadcast(books), "ROOT")
        text = F.concat(F.col("LINHAS").cast("string"), F.lit(f" linhas em {len(expected)} abas"))
        lines = lines.unionByName(
            passed.select("WORKBOOK", "ORDEM", F.lit("OK").alias("NIVEL"), text.alias("MENSAGEM"), "LINHAS", "COLUNAS", F.lit(True).alias("OK"))
        )
    return lines.withColumn("ANO", year_in_name(F.col("WORKBOOK")))


def strip_upper(name: str) -> str:
    return name.strip().upper()


def year_clashes(workbooks: list[str]) -> dict[str, list[str]]:
    """Workbooks that name the same year; all of them are kept when scanned as a list."""
    by_year: dict[str, list[str]] = defaultdict(list)
    for path in workbooks:
        match = re.search(r"20\d{2}", path.rstrip("/").split("/")[-1])
        if match:
            by_year[match.group(0)].append(path)
    return {year: paths for year, paths in by_year.items() if len(paths) > 1}


def write_workbooks(wide: DataFrame, root: str, title: str = "COMPRAS") -> None:
    """Write a wide table as one CSV sheet per year and branch, in the layout read above."""
    book = F.concat(F.lit(f"{title} "), F.col("ANO").cast("string"))
    sheet = F.concat(F.lit("FILIAL "), F.col("FILIAL").cast("string"))
    (
        wide.withColumn("_book", book)
        .withColumn("_sheet", sheet)
        .repartitionByRange("ANO", "FILIAL", "CODFORNEC")
        .drop("ANO")
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy("_book", "_sheet")
        .csv(root)
    )
