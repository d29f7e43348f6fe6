"""Cleaning chains: named steps over a table, each written once, counted in the same pass and found again after a break.

A step is a function from DataFrame to DataFrame, registered under a name. It
may leave a column ``_state`` that says ``error`` or ``filtered`` of rows that
do not go on; all other rows are valid. Counts come from an ``Observation`` on
the rows that the step writes anyway, so no table is read twice for them.

A chain's tables lie in one folder with a manifest, which names the input by
its fingerprint and is replaced whole after each table. A chain that is run
again on the same input reads the tables that the manifest lists and runs only
what is missing; a folder of another input is set aside, not overwritten.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import collapse
from millrace.operators import dedup, records

Step = Callable[[DataFrame], DataFrame]
#: Steps by name.
REGISTRY: dict[str, Callable[..., Step]] = {}
STATE, MANIFEST = "_state", "manifest.json"


@dataclass
class Count:
    """Of one step: rows read, kept, not readable and left out; whether it left nothing and so kept its input."""

    step: str
    total: int
    valid: int
    error: int
    filtered: int
    kept_input: bool


def cleaner(name: str) -> Callable[[Callable[..., Step]], Callable[..., Step]]:
    """Registers a function that makes a step of its parameters."""

    def add(make: Callable[..., Step]) -> Callable[..., Step]:
        REGISTRY[name] = make
        return make

    return add


def rows(*, keep: Column | None = None, error: Column | None = None, change: dict[str, Column] | None = None) -> Step:
    """A step that takes each row by itself: ``error`` says that it cannot be read, ``keep`` that it stays; null keeps nothing."""

    def step(df: DataFrame) -> DataFrame:
        bad = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
        out = F.coalesce(~keep, F.lit(True)) if keep is not None else F.lit(False)
        return df.withColumn(STATE, F.when(bad, "error").when(out, "filtered")).withColumns(change or {})

    return step


@cleaner("filled")
def _filled(column: str = "text") -> Step:
    return rows(keep=records.filled(F.col(column)))


@cleaner("least_length")
def _least_length(column: str = "text", least: int = 1) -> Step:
    return rows(keep=F.length(F.trim(F.col(column))) >= least)


@cleaner("chat")
def _chat(column: str = "messages") -> Step:
    return rows(keep=records.valid_messages(F.col(column)), error=F.col(column).isNull())


@cleaner("collapse")
def _collapse(column: str = "text") -> Step:
    return rows(change={column: F.trim(F.regexp_replace(F.col(column), r"\s+", " "))})


@cleaner("distinct")
def _distinct(column: str = "text") -> Step:
    """One row of each text, compared in lower case with white space collapsed: that of the least whole row."""

    def step(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != column]
        least = F.min_by(F.struct(*df.columns), F.struct(*others, column))
        return df.groupBy(F.sha2(collapse(F.col(column)).cast("binary"), 256).alias("_h")).agg(least.alias("_row")).select("_row.*")

    return step


@cleaner("benchmark")
def _benchmark(bench: DataFrame, bench_col: str = "text", id_col: str = "doc_id", column: str = "text") -> Step:
    return lambda df: dedup.decontaminate(df, bench, id_col=id_col, text_col=column, bench_col=bench_col)


@cleaner("lines")
def json_lines(schema: str, column: str = "line") -> Step:
    """Records of JSON lines; a line that is no object of the schema is an error."""

    def step(df: DataFrame) -> DataFrame:
        read = F.from_json(F.col(column), f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
        parsed = df.where(F.trim(column) != "").select(read.alias("_r"))
        broken = F.col("_r").isNull() | F.col("_r._broken").isNotNull()
        return parsed.select(F.when(broken, "error").alias(STATE), "_r.*").drop("_broken")

    return step


def shared_home(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``, which all machines share; a temporary one only on a single machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='millrace-')}/chain-{uuid.uuid4().hex}"


def fingerprint(df: DataFrame) -> str:
    """Of the schema and all rows, in whatever order and partitions they come."""
    hashed = df.select(F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("c"))) if "map" in t else F.col(c) for c, t in df.dtypes]).alias("h"))
    got = hashed.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 31)))).first()
    return json.dumps([df.dtypes, *got])


class Folder:
    """The tables of one chain, through Spark's file systems."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        if not self._fs.exists(self._path(f"{self.home}/{MANIFEST}")):
            return None
        return json.loads(self.spark.read.text(f"{self.home}/{MANIFEST}", wholetext=True).first()[0])

    def set_manifest(self, said: dict) -> None:
        """Written beside and moved into place, so that a break leaves the old one or the new one."""
        new, place = self._path(f"{self.home}/.{MANIFEST}.{uuid.uuid4().hex}"), self._path(f"{self.home}/{MANIFEST}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        self._fs.delete(place, False)
        if not self._fs.rename(new, place):
            raise OSError(f"cannot write {place}")

    def set_aside(self) -> str:
        aside = f"{self.home}-aside-{uuid.uuid4().hex}"
        if not self._fs.rename(self._path(self.home), self._path(aside)):
            raise OSError(f"cannot move {self.home}")
        return aside

    def has_table(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.home}/{name}/_SUCCESS"))


def run(df: DataFrame, steps: list[tuple[str, Step]], *, home: str) -> tuple[DataFrame, list[Count]]:
    """The table that the steps leave, in turn, and each one's counts.

    A step that leaves no valid row keeps its input, and says so. Steps that
    ran before on this input are read from ``home``; from the first one that
    is missing, has another name or whose table is gone, all run again. A
    step's name stands for its parameters: give other ones another name.
    """
    folder, mark = Folder(df.sparkSession, home), fingerprint(df)
    said = folder.manifest()
    if said and said["input"] != mark:
        folder.set_aside()
        said = None
    done = [Count(**c) for c in said["steps"]] if said else []
    counts: list[Count] = []
    for n, (name, step) in enumerate(steps):
        table = f"{n:03d}-{re.sub(r'[^A-Za-z0-9_-]', '_', name)}"
        known = n < len(done) and done[n].step == name and (done[n].kept_input or folder.has_table(table))
        if not known:
            done = done[:n]
            counts.append(_run_step(df, name, step, f"{folder.home}/{table}", counts[-1] if counts else None))
            folder.set_manifest({"input": mark, "steps": [asdict(c) for c in counts]})
        else:
            counts.append(done[n])
        if not counts[-1].kept_input:
            df = df.sparkSession.read.parquet(f"{folder.home}/{table}")
    return df, counts


def _run_step(df: DataFrame, name: str, step: Step, path: str, before: Count | None) -> Count:
    read, wrote = Observation(), Observation()
    out = step(df.observe(read, F.count(F.lit(1)).alias("total")))
    if STATE not in out.columns:
        out = out.withColumn(STATE, F.lit(None).cast("string"))
    count = lambda s: F.count_if(F.col(STATE) == s).alias(s)
    seen = out.observe(wrote, F.count_if(F.col(STATE).isNull()).alias("valid"), count("error"), count("filtered"), F.count(F.lit(1)).alias("told"))
    seen.where(F.col(STATE).isNull()).drop(STATE).write.mode("overwrite").parquet(path)
    got = wrote.get
    # A step that reads its input twice, as a join with itself does, observes it more than once: then the step before tells.
    total = (before.total if before.kept_input else before.valid) if before else read.get["total"]
    filtered = got["filtered"] if got["told"] == total else total - got["valid"] - got["error"]
    return Count(name, total, got["valid"], got["error"], filtered, got["valid"] == 0)


def report(spark: SparkSession, counts: list[Count]) -> DataFrame:
    """One row to each step."""
    return spark.createDataFrame([(n, *asdict(c).values()) for n, c in enumerate(counts)], "place int, step string, total long, valid long, error long, filtered long, kept_input boolean")
