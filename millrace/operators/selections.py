"""Gates, picks and shares over records, samples and data sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.sampling import pool

# Languages whose programs can be checked.
LANGUAGES = ("python", "javascript", "java", "cpp", "c", "csharp", "go", "rust", "ruby", "swift", "kotlin", "scala", "bash", "shell", "html", "css", "json", "yaml", "markdown")


def relevant(df: DataFrame, *, messages: str, score: str | None, least: float, order: str, n: int) -> DataFrame:
    """The first ``n`` rows with messages whose score, if they have one, is at least ``least``."""
    enough = F.coalesce(F.col(score) >= least, F.lit(True)) if score in df.columns else F.lit(True)
    return df.where(enough & (F.size(messages) > 0)).orderBy(order).limit(n)


def checkable(is_code: Column, language: Column) -> Column:
    """Whether a record is code in one of ``LANGUAGES``, in any case."""
    return F.coalesce(is_code & F.lower(language).isin(*LANGUAGES), F.lit(False))


def exportable(related: Column, is_benchmark: Column, success: Column | None = None) -> Column:
    """Whether a data set may go into training data: related, judged to be no benchmark, and read without failure. What was not judged may not."""
    return F.coalesce((F.lit(True) if success is None else success) & related & ~is_benchmark, F.lit(False))


def latest(df: DataFrame, *, order: str, n: int = 1, by: str | None = None) -> DataFrame:
    """The last ``n`` rows in the order of a column that tells them apart, of each value of ``by`` or of all; with ``rank`` from 1, the newest first."""
    newest = W.partitionBy(by if by else F.lit(0)).orderBy(F.desc_nulls_last(order))
    few = df if by else df.orderBy(F.desc_nulls_last(order)).limit(n)  # then the window has n rows
    return few.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def loosely_right(pred: Column, refs: Column) -> Column:
    """Whether a trimmed prediction is, or holds, one of the trimmed references; blank ones are held by none."""
    mine = F.trim(F.coalesce(pred, F.lit("")))
    return F.coalesce(F.exists(refs, lambda r: (mine == F.trim(r)) | ((F.trim(r) != "") & mine.contains(F.trim(r)))), F.lit(False))


def exactly_held(pred: Column, refs: Column) -> Column:
    """Whether a prediction holds one of the references as it stands, white space included; null where either is."""
    return F.exists(refs, lambda r: pred.contains(r))


def case_samples(df: DataFrame, *, pred: str, refs: str, id_col: str, group: str = "negative", n: int = 5, seed: int = 42, right: Callable[[Column, Column], Column] = loosely_right) -> DataFrame:
    """``n`` rows of a group (``positive``, ``negative``, ``mixed``; any other name is negative), repeatable by the seed, with ``correct``, which ``right`` tells of prediction and references."""
    told = df.withColumn("correct", right(F.col(pred), F.col(refs)))
    wanted = {"mixed": F.lit(True), "positive": F.col("correct")}.get(group, ~F.col("correct"))
    return pool(told.where(wanted), id_col=id_col, size=n, seed=seed)


def with_problems(samples: DataFrame, problems: DataFrame, *, task: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(samples with their problem's columns and ``completion_id``, the place within the task from 0; samples of unknown tasks).

    Problems must be unique by task. The side to broadcast is left to its size.
    """
    known = problems.withColumn("_known", F.lit(True))
    both = samples.join(known, task, "left")
    placed = both.where("_known").drop("_known").withColumn("completion_id", F.row_number().over(W.partitionBy(task).orderBy(order)) - 1)
    return placed, both.where("_known is null").select(*samples.columns)


def parse_rates(df: DataFrame, *, failing: str, expected: str, got: str, by: tuple[str, ...] = ()) -> DataFrame:
    """some, total, whole, rate: of the failures that show a part of their assertion (total), those that show all three (whole), as a share of four digits (0 without any); ``some`` have a value on either side, among all rows."""
    shown = {c: F.coalesce(F.col(c) != "", F.lit(False)) for c in (failing, expected, got)}
    part, all_three = shown[failing] | shown[expected] | shown[got], shown[failing] & shown[expected] & shown[got]
    some = F.col(expected).isNotNull() | F.col(got).isNotNull()
    counted = df.groupBy(*by).agg(F.count_if(some).alias("some"), F.count_if(part).alias("total"), F.count_if(all_three).alias("whole"))
    return counted.withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("whole") / F.col("total"), 4)).otherwise(0.0))


def dataset_info(df: DataFrame, *, length: Column, order: str, by: str, first: int = 10) -> DataFrame:
    """by, samples, mean_length: of each data set, the whole number of characters a sample in its first ``first`` rows. A null length is 0."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("samples"))
    head = df.select(by, order, F.coalesce(length, F.lit(0)).alias("_l")).withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_n") <= first)
    means = head.groupBy(F.col(by).alias("_by")).agg(F.sum("_l").alias("_sum"), F.count(F.lit(1)).alias("_of"))
    whole = F.floor(F.col("_sum") / F.col("_of")).cast("long")
    return sizes.join(means, F.col(by).eqNullSafe(F.col("_by"))).select(by, "samples", whole.alias("mean_length"))
