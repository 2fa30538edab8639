"""Headers of files, read from their first bytes or their footer inside tasks.

One Spark job opens every file once: a task reads the first record of a CSV file, quoted line breaks included, or the
footer of a Parquet file, and stops. What is read of a file does not grow with it. A file that a task cannot open by
itself, such as one in a store whose access is set up in Spark alone, comes back without a header.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stores whose files a task opens by itself; for others Spark's own readers are used.
SCHEMES = ("file", "hdfs")
READ_AHEAD = 65_536
#: A first record that is longer than this is no header: an open quote may run to the end of the file.
LONGEST = 1_048_576
_DECODERS = {"gz": gzip.open, "bz2": bz2.open}


class _Counted(io.RawIOBase):
    """A stream that ends after `most` bytes, so that a header without an end cannot read a whole file."""

    def __init__(self, stream, most: int):
        self.stream, self.left = stream, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(min(len(buffer), self.left))
        self.left -= len(got)
        buffer[: len(got)] = got
        return len(got)


def first_record(stream, most: int = LONGEST) -> list[str] | None:
    """Fields of the first record that is not blank; an empty file has none.

    A record that does not end, as after an open quote, counts as its first line; None if that line is longer than `most`.
    """
    source = _Counted(stream, most)
    text = io.TextIOWrapper(io.BufferedReader(source, READ_AHEAD), "utf-8-sig", errors="replace", newline="")
    first: list[str] = []

    def lines() -> Iterator[str]:
        for line in text:
            if first or line.strip():
                first.append(line)
                yield line

    try:
        record = next(csv.reader(lines(), strict=True), [])
        if source.left:
            return record
    except csv.Error:
        pass
    try:
        return next(csv.reader(first[:1])) if first and first[0].endswith(("\r", "\n")) else None
    except csv.Error:
        return None


def read_header(uri: str, path: str, kind: str, packed: str, schemes: tuple[str, ...] = SCHEMES) -> list[str] | None:
    """Column names of one file; None if its store or its compression cannot be read here.

    uri: the file as Spark names it; path: the same, decoded; packed: extension of the compression, or empty.
    """
    scheme = uri.split(":", 1)[0].lower()
    if scheme not in schemes or (kind == "csv" and packed and packed not in _DECODERS):
        return None
    try:
        if scheme == "file":
            store, place = fs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/")
        else:
            store, place = fs.FileSystem.from_uri(uri)
        with store.open_input_file(place) as file:
            if kind == "parquet":
                return pq.read_schema(file).names
            if packed:
                with _DECODERS[packed](file) as plain:
                    return first_record(plain)
            return first_record(file)
    except (OSError, EOFError, zlib.error, pa.ArrowException):
        return None  # Spark's reader gives the header, or its own error


def with_headers(files: DataFrame, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """Files (file, path, kind, packed and more) with header, an array of names; null where a task could not open the file."""
    schema = T.StructType([*files.schema.fields, T.StructField("header", T.ArrayType(T.StringType()))])

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["file", "path", "kind", "packed"]).to_pylist()
            found = [read_header(r["file"], r["path"], r["kind"], r["packed"], schemes) if r["kind"] else None for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "header"])

    return files.withColumn("packed", F.coalesce("packed", F.lit(""))).mapInArrow(open_all, schema)
