"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that names none gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"procura-llm-{spark.sparkContext.applicationId}")


def tasks_for(rows: int, per_task: int = 20_000) -> int:
    """How many tasks a table of so many rows deserves: 8 at least, and one more per per_task rows without any limit."""
    return max(8, -(-rows // per_task))


def stage(df: DataFrame, name: str, tasks: int | None = None, **options: str | int) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that was staged. tasks: join the partitions of a small table into so many.
    options: of the writer."""
    spark = df.sparkSession
    df = df.coalesce(tasks) if tasks else df
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
