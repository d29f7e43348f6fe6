"""Records inside Arrow files, SQLite databases and archives; every file is read by a task, as one stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

MEMBER = "path string, member string, line long, value string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _open_arrow(raw: bytes):  # noqa: ANN202
    source = pa.BufferReader(raw)
    return pa.ipc.open_file(source) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(source)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Arrow files or streams of one schema, that of the first file; columns that a file lacks are null in its rows."""
    files = _files(spark, path)
    first = files.orderBy("path").select("content").first()
    if first is None:
        raise ValueError(f"no file under {path}")
    schema = _open_arrow(bytes(first[0])).schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for raw in batch.column(0):
                found = _open_arrow(raw.as_py())
                parts = (found.get_batch(n) for n in range(found.num_record_batches)) if hasattr(found, "num_record_batches") else found
                for part in parts:
                    cols = [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return files.select("content").mapInArrow(run, from_arrow_schema(schema))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, *, rows: int = 10_000) -> DataFrame:
    """The rows of a table in every database file under ``path``, each in a task of its own, ``rows`` at a time.

    ``schema`` is a DDL string that names the columns to read. A file without the table fails.
    """
    names = spark.createDataFrame([], schema).columns
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    statement = f'SELECT {quoted} FROM "{table.replace(chr(34), chr(34) * 2)}"'

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import sqlite3
        import tempfile

        for batch in stream:
            for raw in batch["content"]:
                with tempfile.TemporaryDirectory() as scratch:  # a task's own scratch file, gone with the task
                    local = os.path.join(scratch, "db")
                    with open(local, "wb") as f:
                        f.write(raw)
                    link = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
                    cursor = link.execute(statement)
                    while got := cursor.fetchmany(rows):
                        yield pd.DataFrame(got, columns=names)
                    link.close()

    return _files(spark, path).select("content").mapInPandas(run, schema)


def read_archive(spark: SparkSession, path: str, *, endings: tuple[str, ...] = (".jsonl", ".json", ".csv", ".tsv", ".txt", ".md"), rows: int = 1000) -> DataFrame:
    """path, member, line, value: the text lines of the members of zip and tar archives (plain, gz, bz2, xz).

    Members with other endings, folders and hidden files are left out; bytes
    that are no UTF-8 become replacement marks. An archive is read member by
    member without unpacking it.
    """

    def members(raw: bytes):  # noqa: ANN202
        import io
        import tarfile
        import zipfile

        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        with z.open(info) as f:
                            yield info.filename, f
        else:
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
                for info in t:
                    if info.isfile():
                        yield info.name, t.extractfile(info)

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            for path_, raw in zip(batch["path"], batch["content"], strict=True):
                held = []
                for name, f in members(raw):
                    if not name.lower().endswith(endings) or name.rsplit("/", 1)[-1].startswith("."):
                        continue
                    for n, line in enumerate(f):
                        text = line.decode("utf-8", "replace").rstrip("\r\n")
                        held.append((path_, name, n, text.removeprefix("﻿") if n == 0 else text))
                        if len(held) == rows:
                            yield pd.DataFrame(held, columns=["path", "member", "line", "value"])
                            held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "member", "line", "value"])

    return _files(spark, path).select("path", "content").mapInPandas(run, MEMBER)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of archive lines that hold JSON, beside path, member and line; blank and broken lines go."""
    parsed = lines.where(F.trim("value") != "").select("path", "member", "line", F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("_v"))
    return parsed.where("_v is not null").select("path", "member", "line", "r.*")
