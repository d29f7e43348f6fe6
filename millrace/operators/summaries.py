"""Counts, rates and picks that reports are made of, over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, value: str, *, n: int) -> DataFrame:
    """value, n: the ``n`` most frequent values, the smaller of two as frequent first; null is a value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def bins(c: Column, edges: tuple[int, ...]) -> Column:
    """The range of a number by the last number of each: ``<=10``, ``11-30``, …, ``>60``; null for null."""
    out = F.when(c > edges[-1], f">{edges[-1]}")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        out = out.when((c > low) & (c <= high), f"{low + 1}-{high}")
    return out.when(c <= edges[0], f"<={edges[0]}")


def pass_rates(df: DataFrame, *, task: str, passed: str) -> DataFrame:
    """sample_rate, task_rate: passed samples over all, and tasks with a passed sample over all, to four digits; a null did not pass. Null without rows."""
    ok = F.coalesce(F.col(passed).cast("int"), F.lit(0))
    by = df.groupBy(task).agg(F.sum(ok).alias("s"), F.count(F.lit(1)).alias("n"), F.max(ok).alias("any"))
    return by.agg(F.round(F.sum("s") / F.sum("n"), 4).alias("sample_rate"), F.round(F.avg("any"), 4).alias("task_rate"))


def field_presence(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, n: how many rows have a value that is neither null nor empty, in one pass; an absent column has none."""
    has = lambda f: F.nullif(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit(None)
    return df.agg(*[F.count(has(f)).alias(f) for f in fields]).unpivot([], list(fields), "field", "n")


def drop_reasons(df: DataFrame, reason: Column, *, chars: int = 60) -> DataFrame:
    """reason, n: dropped rows by what their reason says before a colon, at most ``chars`` characters of it; rows without a reason were not dropped."""
    key = F.substring(F.substring_index(reason, ":", 1), 1, chars)
    return df.select(key.alias("reason")).where("reason is not null and reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def dominant(df: DataFrame, kind: Column, *by: str) -> DataFrame:
    """by, dominant: each group's most frequent kind, the greater name of two as frequent, ``N/A`` where all are null."""
    n = df.groupBy(*by, kind.alias("_kind")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.struct("_n", "_kind")))
    return n.groupBy(*by).agg(F.coalesce(best, F.lit("N/A")).alias("dominant"))


def best_checkpoint(df: DataFrame, *, by: str, loss: str, step: str) -> DataFrame:
    """by, best, loss: each run's step of least loss, the earlier of two; rows without a loss do not count."""
    return df.where(F.col(loss).isNotNull()).groupBy(by).agg(F.min_by(step, F.struct(loss, step)).alias("best"), F.min(loss).alias("loss"))


def nearest_checkpoint(best: DataFrame, saved: DataFrame, *, by: str, step: str, number: str) -> DataFrame:
    """The rows of ``best`` with ``number``: their run's saved checkpoint nearest to the step, the smaller of two; null without any.

    A run's least candidates are found by aggregation, so its checkpoints never meet in one task.
    """
    there = best.join(saved.select(by, F.col(number).alias("_c")), by, "left")
    near = F.min_by("_c", F.when(F.col("_c").isNotNull(), F.struct(F.abs(F.col("_c") - F.col(step)), F.col("_c"))))
    return there.groupBy(*[F.col(f"`{c}`") for c in best.columns]).agg(near.alias(number))
