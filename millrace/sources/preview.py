"""A few records of a file of any usual kind and encoding, as short JSON texts."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.listings import lines_of
from millrace.functions.previews import PREVIEW, Limits, shortened
from millrace.sources.files import kind_of, looks_binary, read_json, read_records

# Encodings in the order in which they are tried, and the largest file that is looked into.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5", "utf-16", "utf-16-le", "utf-16-be", "latin-1", "cp1252", "iso-8859-1")
MOST_BYTES = 80 << 20
_SHAPE = "file string, size long, encoding string, columns array<string>, records array<string>, error string"


@F.pandas_udf(StructType().add("encoding", "string").add("text", "string"))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Bytes as text, by the first of ``ENCODINGS`` that reads them all; null bytes are null."""

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        for name in ENCODINGS if b is not None else ():
            try:
                return name, codecs.decode(b, name)
            except UnicodeError:
                continue
        return None, None

    return pd.DataFrame([one(b) for b in content], columns=["encoding", "text"])


def sample_records(df: DataFrame, max_rows: int = 8, limits: Limits = PREVIEW) -> DataFrame:
    """record: some ``max_rows`` rows as short JSON text. Column names must differ."""
    return df.limit(max_rows).select(shortened(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, limits).alias("record"))


def _parsed(spark: SparkSession, kind: str, path: str, text: DataFrame, max_rows: int) -> DataFrame | None:
    """The first rows of a decoded text file, or None if it has none; at most ``max_rows`` lines come to the driver."""
    if kind == "json":
        one = text.where(F.try_parse_json("text").isNotNull())
        return read_json(spark, path) if one.count() else None
    lines = text.select(F.posexplode(lines_of(F.col("text"))).alias("n", "line")).where(F.trim("line") != "")
    if kind == "text":
        return lines.orderBy("n").select(F.col("line").alias("text"))
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else ","
        head = lines.orderBy("n").limit(max_rows + 1).collect()
        if not head:
            return None
        of = lambda line, shape: F.from_csv(line, shape, {"sep": sep, "escape": '"'})
        wide = ", ".join(f"c{i} string" for i in range(head[0].line.count(sep) + 1))
        names = [v for v in spark.range(1).select(of(F.lit(head[0].line), wide).alias("r")).first().r if v is not None]
        shape = StructType()
        for i, name in enumerate(names):
            shape = shape.add(name if name not in names[:i] else f"{name}_{i}", "string")
        return lines.where(F.col("n") > head[0].n).orderBy("n").select(of(F.col("line"), _ddl(shape)).alias("r")).select("r.*")
    good = lines.where(F.try_parse_json("line").isNotNull() & F.json_object_keys("line").isNotNull()).orderBy("n").limit(max_rows).collect()
    if not good:
        return None
    shape = F.schema_of_json(F.lit("[" + ",".join(r.line for r in good) + "]"))
    return spark.createDataFrame([(r.line,) for r in good], "line string").select(F.explode(F.from_json(F.concat(F.lit("["), F.col("line"), F.lit("]")), shape)).alias("r")).select("r.*")


def _ddl(shape: StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in shape.fields)


def preview(spark: SparkSession, path: str, *, max_rows: int = 8, limits: Limits = PREVIEW) -> DataFrame:
    """One row: file, size, encoding (null for binary kinds), columns, records (short JSON texts), error.

    Errors: ``file_too_large`` (over 80 MB; its content is not read),
    ``likely_binary_file``, ``no_records``. Texts are read in the first encoding
    that fits the whole file; broken lines of JSON are passed over, delimited
    records may not span lines, and a JSON document is read as UTF-8. At most
    50 rows are given.
    """
    max_rows = max(1, min(50, max_rows))
    kind = kind_of(path)
    files = spark.read.format("binaryFile").load(path)
    found = files.select("length").first()
    size = found[0] if found else 0  # empty files are not listed

    def told(error: str | None, encoding: str | None = None, df: DataFrame | None = None) -> DataFrame:
        records = [r.record for r in sample_records(df, max_rows, limits).collect()] if df is not None else []
        said = error if error or records else "no_records"
        return spark.createDataFrame([(path, size, encoding, df.columns if df is not None else [], records, said)], _SHAPE)

    if size == 0:
        return told("no_records")
    if size > MOST_BYTES:
        return told("file_too_large")
    if kind in ("parquet", "arrow", "orc"):
        return told(None, None, read_records(spark, path, kind))
    if files.select(looks_binary(F.substring("content", 1, 16_384))).first()[0]:
        return told("likely_binary_file")
    text = files.select(decoded(F.col("content")).alias("d")).select("d.*")
    return told(None, text.select("encoding").first()[0], _parsed(spark, kind, path, text, max_rows))
