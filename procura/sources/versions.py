"""Tables that are published together, as one version.

The pointer file of a staging folder names the folders that make up each table. It is replaced by one rename after every
table is written and checked, so a reader sees the old version or the new one, never a mixture, and a load that fails
half-way leaves what was published. Years that a refresh does not touch stay where an earlier version wrote them.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "CURRENT.json"
YEAR = "ANO"


def current(spark: SparkSession, folder: str) -> dict | None:
    """The published pointer, or None where nothing was published as a version."""
    path, files = _file(spark, f"{folder.rstrip('/')}/{POINTER}")
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the published version; None if there is no version or it has no such table."""
    pointer = current(spark, folder)
    entry = pointer["tables"].get(name) if pointer else None
    return _read(spark, folder.rstrip("/"), entry) if entry else None


class Version:
    """The next version of a folder. Nothing is visible to readers before publish()."""

    def __init__(self, spark: SparkSession, folder: str, keep_tables: bool = False) -> None:
        """keep_tables: all tables of the published version belong to the new one, unless written anew."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.base = current(spark, folder)
        self.name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, dict] = dict(self.base["tables"]) if keep_tables and self.base else {}

    def write(self, name: str, df: DataFrame, by_year: bool = False, carry: bool = False) -> DataFrame:
        """Write a table and return the rows just written. by_year: one folder per year. carry: years that are not among
        the rows are taken over from the published version."""
        root = f"versions/{self.name}/{name}.parquet"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(YEAR) if by_year else writer).parquet(f"{self.folder}/{root}")
        written = {"root": root, "years": self._years(root) if by_year else None}
        folders = [written]
        old = self.base["tables"].get(name) if carry and self.base else None
        for earlier in old["folders"] if old else []:
            left = [y for y in earlier["years"] if y not in written["years"]]
            if left:
                folders.append({"root": earlier["root"], "years": left})
        self.tables[name] = {"schema": df.schema.json(), "folders": folders}
        return _read(self.spark, self.folder, {"schema": df.schema.json(), "folders": [written]})

    def _years(self, root: str) -> list[str]:
        path, files = _file(self.spark, f"{self.folder}/{root}")
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return sorted(n for n in names if n.startswith(f"{YEAR}="))

    def read(self, name: str) -> DataFrame:
        """A table as the new version will show it."""
        return _read(self.spark, self.folder, self.tables[name])

    def publish(self) -> None:
        """Switch readers to this version. Fails if another load published since this one began."""
        found = current(self.spark, self.folder)
        if (found or {}).get("version") != (self.base or {}).get("version"):
            raise RuntimeError(f"{self.folder}: another version was published meanwhile")
        text = json.dumps({"version": self.name, "tables": self.tables}, indent=1)
        path, files = _file(self.spark, f"{self.folder}/{POINTER}")
        draft, _ = _file(self.spark, f"{self.folder}/versions/{self.name}/{POINTER}")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = getattr(hadoop, "Options$Rename")
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        hadoop.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, overwrite)


def drop_unused(spark: SparkSession, folder: str) -> list[str]:
    """Delete versions older than the published one that it takes no folder from; returns their names. Readers that
    still hold an older pointer lose their files."""
    pointer = current(spark, folder)
    if not pointer:
        return []
    used = {f["root"].split("/")[1] for entry in pointer["tables"].values() for f in entry["folders"]}
    path, files = _file(spark, f"{folder.rstrip('/')}/versions")
    names = [status.getPath().getName() for status in files.listStatus(path)]
    gone = sorted(n for n in names if n not in used and n < pointer["version"])
    for name in gone:
        files.delete(_file(spark, f"{folder.rstrip('/')}/versions/{name}")[0], True)
    return gone


def _file(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, folder: str, entry: dict) -> DataFrame:
    """One scan per version that wrote part of the table: as many as there are years, at most."""
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    parts = []
    for place in entry["folders"]:
        root = f"{folder}/{place['root']}"
        if place["years"] is None:
            parts.append(spark.read.schema(schema).parquet(root))
        elif place["years"]:
            parts.append(spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{y}" for y in place["years"]]))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).select(*schema.names)
