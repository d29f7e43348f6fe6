"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the pattern ``[\x20\x09-\x0D]``.
SPACE = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines share and whose owner clears it.

    Where none is set, a temporary folder on one machine (master ``local``); an error on a cluster.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fewer(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` in no more partitions than its ``rows`` are worth."""
    return df.coalesce(max(1, -(-rows // each)))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, read again: smaller than a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names; null text is empty.

    Selecting here is what keeps any other column, whatever its name, from
    clashing with an operator's own columns.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def batches(stream: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into shorter ones, so that few texts are Python objects at a time."""
    for batch in stream:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: By so many parts is a table divided to tell which keys are hot, so no more keys than this can be.
PARTS = 4096


#: Bits to a value, and most bits, of a filter: 64 MB at most. Beyond 500 million values it lets more and more others pass.
BITS_EACH, MOST_BITS = 16, 1 << 29


def hash_filter(wanted: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function for tasks that tells of 64-bit hashes which may be in ``column``; it never misses one that is."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * wanted.count()).bit_length()))
    slot = F.pmod(column, F.lit(bits))
    words = wanted.groupBy(F.floor(slot / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("b")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def passes(hashes: np.ndarray) -> np.ndarray:
        s = hashes.astype(np.int64, copy=False) % bits
        return (shared.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1

    return passes


def join_hot(left: DataFrame, right: DataFrame, key: str, *, rows: str, total: int, parts: int = PARTS) -> DataFrame:
    """The inner join of ``left`` with ``right`` on ``key``, whatever share of ``left`` one key has.

    Column ``rows`` of ``right`` says how many rows of ``left`` (``total`` in all) have the key. A
    key of one part in PARTS of them or more is hot. At most PARTS keys can be, so their rows of
    ``right`` (a bounded number to each key) are small enough to send to every task; all other keys
    are too rare to fill a task.
    """
    least = max(1, total // parts)
    hot, rest = right.where(F.col(rows) >= least).drop(rows), right.where(F.col(rows) < least).drop(rows)
    known = F.broadcast(hot.select(key).distinct())
    return left.join(F.broadcast(hot), key).unionByName(left.join(known, key, "left_anti").join(rest, key))
