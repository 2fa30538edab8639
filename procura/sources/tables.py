"""Table reads, durable intermediate tables, and sinks."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.schema import FACT_ORDER
from procura.sources import versions

_lock = threading.RLock()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the published version, or the plain table of a folder without one."""
    published = versions.table(spark, folder, name)
    return published if published is not None else spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def optional_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """None when the table is absent; any other failure is raised."""
    try:
        return read_table(spark, folder, name)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/procura-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage on reliable storage, as columns that later reads can prune; what was computed stays fixed if an
    executor is lost. drop_durable removes the files at the end of a run."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one task, and the size from which a table is dealt by them.
TASK_ROWS, MANY_ROWS = 500_000, 2_000_000


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by hash of the keys in tasks of about TASK_ROWS rows, however many partitions the session has and however well
    the rows compress. A table of up to MANY_ROWS rows is left as it is. No key may hold more rows than a task should get."""
    return df if rows <= MANY_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)


def tasks_by_key(keys: DataFrame, rows: int) -> int:
    """How many tasks a table of so many rows is dealt to by a key. keys: its column of keys, cheap to read; nulls do not count.
    0 if the table has up to MANY_ROWS or one key more than TASK_ROWS: a hot key is left to map-side sums and the session's skew joins."""
    if rows <= MANY_ROWS:
        return 0
    key = F.col(keys.columns[0])
    largest = keys.filter(key.isNotNull()).groupBy(key.alias("_key")).count().agg(F.max("count")).first()[0]
    return -(-rows // TASK_ROWS) if (largest or 0) <= TASK_ROWS else 0


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df by hash of the keys in so many tasks; as it is for 0."""
    return df.repartition(tasks, *keys) if tasks else df


def drop_durable(*tables: DataFrame) -> None:
    """Delete the files of durable tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(
    spark: SparkSession,
    source: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Write a table once per application under the shared folder, then read it back."""
    mark = hashlib.sha1(f"{source}|{name}".encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/staged-{name}-{mark}"
    with _lock:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return spark.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Overwrite every table of the bundle."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def in_fact_order(fact: DataFrame, rows: int = 0) -> DataFrame:
    """Range-partitioned and sorted by the fact order: each file holds one stretch of one or two
    years, and its row groups carry tight min/max ranges for pushed-down filters. rows: how many there are at most; many
    are cut into ranges of about TASK_ROWS."""
    cut = fact.repartitionByRange(-(-rows // TASK_ROWS), *FACT_ORDER) if rows > MANY_ROWS else fact.repartitionByRange(*FACT_ORDER)
    return cut.sortWithinPartitions(*FACT_ORDER)


def write_fact(fact: DataFrame, path: str, refresh: bool = False) -> None:
    """Fact sink, one folder per year. refresh replaces only the years present in `fact`."""
    writer = in_fact_order(fact).write.mode("overwrite")
    if refresh:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("ANO").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(lines: DataFrame, path: str, order: list[str], column: str = "LINHA") -> None:
    """A report as text, in order over its part files. Short reports come out as one file."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(path)
