"""Files of data sets and benchmarks by their paths alone: what belongs together and what it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Files and folders that hold no benchmark, its files' endings, the folders of each origin, and the names of evaluation files, by priority.
SKIPPED_FILES = ("dataset_dict.json", "dataset_info.json", "state.json")
SKIPPED_DIRS = (".git", "__pycache__", ".cache", ".tmp", "node_modules", ".venv", "venv")
ENDINGS = ("jsonl", "json", "csv", "tsv", "parquet", "arrow", "txt")
RECORDS = ("records.jsonl", "records.json")
PREDICTIONS = ("predict.jsonl", "pred.jsonl", "predictions.jsonl", "predict.json", "pred.json", "predictions.json")
TRUTHS = ("ground_truth.jsonl", "gt.jsonl", "labels.jsonl", "ground_truth.json", "gt.json", "labels.json")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """A file's name without its last ending; a name that begins with its only dot stays."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def logical_stem(path: Column) -> Column:
    """A file's stem, for JSON lines without the number of its part: files of one data set have one."""
    return F.when(F.lower(path).endswith(".jsonl"), F.regexp_replace(stem(path), r"_part_\d{3}$", "")).otherwise(stem(path))


def file_counts(files: DataFrame, *, path: str = "path") -> DataFrame:
    """files, paths, datasets: one row; paths are those that differ, data sets by ``logical_stem``."""
    return files.agg(F.count(path).alias("files"), F.countDistinct(path).alias("paths"), F.countDistinct(logical_stem(F.col(path))).alias("datasets"))


def below(path: Column, root: str) -> Column:
    """A path from a folder on; null for one outside of it."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, len(head) + 1, 1 << 30))


def benchmark_sources(files: DataFrame, root: str, *, path: str = "path") -> DataFrame:
    """path, name: the benchmark files below a folder, each a source of its own, named by its place without its ending, folders parted by two underscores."""
    rel = below(F.col(path), root)
    dirs = F.split(F.regexp_replace(rel, "[^/]*$", ""), "/")
    wanted = ~F.exists(dirs, lambda x: x.isin(*SKIPPED_DIRS) | x.startswith(".")) & ~file_name(rel).startswith(".")
    data = F.lower(file_name(rel)).rlike(rf"\.({'|'.join(ENDINGS)})$") & ~F.lower(file_name(rel)).isin(*SKIPPED_FILES)
    return files.where(rel.isNotNull() & wanted & data).select(F.col(path).alias("path"), F.replace(F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", ""), F.lit("/"), F.lit("__")).alias("name"))


def routed(files: DataFrame, root: str, origins: tuple[str, ...], *, path: str = "path") -> DataFrame:
    """The files that lie in a data set's folder, ``root/origin/dataset/…``, with ``origin`` and ``dataset``; all others go."""
    parts = F.split(below(F.col(path), root), "/")
    placed = files.withColumn("origin", F.get(parts, F.lit(0))).withColumn("dataset", F.get(parts, F.lit(1)))
    return placed.where(F.col("origin").isin(*origins) & (F.size(parts) > 2) & (F.col("dataset") != ""))


def eval_inputs(files: DataFrame, *, by: str, path: str = "path") -> DataFrame:
    """by, mode, records, pred, truth: what each benchmark is scored from.

    A file of records goes before a pair of predictions and truths (mode
    ``split``); with neither, the mode is ``records`` and no file is named:
    all of its files are records. Of several the first name by priority is
    taken, and of one name the least path.
    """

    def best(names: tuple[str, ...]) -> Column:
        rank = F.array_position(F.array(*map(F.lit, names)), file_name(F.col(path)))
        return F.min(F.when(rank > 0, F.struct(rank.alias("rank"), F.col(path).alias("path"))))["path"]

    found = files.groupBy(by).agg(best(RECORDS).alias("r"), best(PREDICTIONS).alias("p"), best(TRUTHS).alias("t"))
    split = F.col("r").isNull() & F.col("p").isNotNull() & F.col("t").isNotNull()
    return found.select(by, F.when(split, "split").otherwise("records").alias("mode"), F.col("r").alias("records"), F.when(split, F.col("p")).alias("pred"), F.when(split, F.col("t")).alias("truth"))


def registered(registry: DataFrame, new: DataFrame, *, order: str, path: str = "path") -> DataFrame:
    """name, path, state: a registry of (name, path) after new paths, named by their stems: ``kept``, ``added`` or ``replaced`` by another path.

    Of new paths of one name the last in order counts.
    """
    last = new.withColumn("_name", stem(F.col(path))).withColumn("_n", F.row_number().over(W.partitionBy("_name").orderBy(F.desc(order)))).where("_n = 1").select(F.col("_name").alias("name"), F.col(path).alias("_new"))
    both = registry.select("name", F.col("path").alias("_old")).join(last, "name", "full")
    state = F.when(F.col("_new").isNull() | F.coalesce(F.col("_new") == F.col("_old"), F.lit(False)), "kept").when(F.col("_old").isNull(), "added").otherwise("replaced")
    return both.select("name", F.coalesce("_new", "_old").alias("path"), state.alias("state"))
