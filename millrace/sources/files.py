"""Records from and to files of the usual kinds, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from millrace.sources import containers

CORRUPT = "_corrupt_record"
#: Keys under which a JSON document may hold its records, by priority.
RECORD_KEYS = ("data", "items", "records", "examples", "train", "test", "validation", "val")
#: Marks in a path and the reader that they call for, by priority.
KINDS = (("jsonl", "jsonl"), ("json", "json"), ("csv", "csv"), ("tsv", "tsv"), ("parquet", "parquet"), ("arrow", "arrow"), ("orc", "orc"), ("txt", "text"), ("md", "text"))
DOCS, DATA, SCRIPTS = ("readme", "license", "changelog"), ("json", "jsonl", "csv", "tsv", "parquet", "arrow", "txt"), ("py", "sh", "ipynb", "js")


def kind_of(path: str) -> str:
    """The reader for a path, by its name; text if nothing fits."""
    low = path.lower()
    return next((kind for mark, kind in KINDS if f".{mark}" in low), "text")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines): blank lines are skipped, a broken line stops nothing.

    Lines are read once as text and parsed with one schema, inferred from the
    whole input where none is given; compressed files work by their extension.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        schema = spark.read.json(path).schema
    fields = StructType([f for f in schema.fields if f.name != CORRUPT]).add(CORRUPT, "string")
    parsed = lines.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), "value")
    good = parsed.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    return good, parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col("value").alias("line"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list gives its items, an object those of its first list under ``RECORD_KEYS``, any other object itself; scalar items become ``value``."""
    df = spark.read.option("multiLine", True).json(path)
    lists = [k for k in RECORD_KEYS if k in df.columns and isinstance(df.schema[k].dataType, ArrayType)]
    if not lists:
        return df
    out, taken = None, F.lit(False)
    for k in lists:  # each document by its own first list that is not empty
        item = df.where(~taken & (F.size(k) > 0)).select(F.explode(k).alias("value"))
        part = item.select("value.*") if isinstance(item.schema["value"].dataType, StructType) else item
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        taken = taken | F.coalesce(F.size(k) > 0, F.lit(False))
    return out


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The records of a file or folder; ``kind`` is found from the path where not given. Whole text files are one record each."""
    kind = kind or kind_of(path)
    if kind == "jsonl":
        return read_jsonl(spark, path)[0]
    if kind == "json":
        return read_json(spark, path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    if kind == "arrow":
        return containers.read_arrow(spark, path)
    if kind == "text":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return spark.read.format(kind).load(path)


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """path, length, kind (readme, data, script or other), hidden and cache folders left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ext = F.regexp_extract(F.regexp_replace(name, r"\.(gz|bz2|xz|zst)$", ""), r"\.([a-z0-9]+)$", 1)
    kind = F.when(name.rlike(f"^({'|'.join(DOCS)})"), "readme").when(ext.isin(*DATA), "data").when(ext.isin(*SCRIPTS), "script").otherwise("other")
    return files.where(~F.col("path").rlike(r"/(\.[^/]+|__pycache__|_temporary)/|/[._][^/]*$")).select("path", "length", kind.alias("kind"))


def looks_binary(content: Column) -> Column:
    """Whether the first 16 KiB hold a NUL, or 512 or more of them less than a quarter of printable ASCII and no mark of UTF-16 before them."""
    head = F.substring(content, 1, 16_384)
    bytes_ = F.regexp_replace(F.hex(head), "(..)", "$1 ")
    printable = F.length(head) - F.length(F.regexp_replace(bytes_, "(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]|09|0A|0D) ", "")) / 3
    return bytes_.rlike("(^| )00 ") | (~bytes_.rlike("^(FF FE|FE FF) ") & (F.length(head) >= 512) & (printable < 0.25 * F.length(head)))


def write_jsonl(df: DataFrame, path: str, *, rows_per_file: int = 10_000, mode: str = "error", compression: str = "none") -> None:
    """JSON lines in files of at most ``rows_per_file`` rows; null fields are left out."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", compression).json(path)
