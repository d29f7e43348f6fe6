"""A corpus cleaned and packed in five stages, each one an operator of ``millrace.llm``.

Stages take and return the columns of ``documents``; the last returns the
places of the packed pieces. Null texts count as empty, null and repeated ids
are decided row by row, an empty table passes as one, and columns beyond those
of ``documents`` are left out.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import near_copies, packing, pii, templates, toxicity
from millrace.llm.util import checkpoint, remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Later stages learn from models and statistics, which SQL cannot state.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; all labels are learnt from.

    A row is decided by its own text: rows that share an id, or have none, go or stay each for itself.
    """
    # The hash of the text goes along as the id, since a null or repeated id names no text.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(7), "text").alias("_h2"))
    scored = toxicity.toxicity(texts, table(spark, sf_dir, "labels"), keep=("_h1", "_h2"))
    gone = checkpoint(scored.where("predicted = 1").select("_h1", "_h2").distinct())
    return docs.join(gone, (F.xxhash64("text") == F.col("_h1")) & (F.xxhash64(F.lit(7), "text") == F.col("_h2")), "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; every document stays."""
    return _counted(templates.drop_templates(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id. SimHash fingerprints and least values bring texts together, their shingles decide."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; every document stays."""
    return _counted(pii.redact(docs, keep=COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            remove(spark, f"{home}/{before}")  # the last one stays: the result reads it
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
