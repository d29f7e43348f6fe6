"""Evaluation metrics over rows of predictions and references; global ones are single aggregations at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def set_f1(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / F.greatest(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def pass_at_k(df: DataFrame, *, task_col: str, passed_col: str, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """k, score: mean over tasks of 1 - prod(1 - k / i); only k that every task has samples for."""
    tasks = df.groupBy(task_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed_col).alias("c"))
    each = tasks.select("n", "c", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    miss = F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda a, i: a * (1 - F.col("k") / i))
    score = F.when((F.col("c") == 0), 0.0).when(F.col("n") - F.col("c") < F.col("k"), 1.0).otherwise(1 - miss)
    return each.groupBy("k").agg(F.min("n").alias("_n"), F.avg(score).alias("score")).where("_n >= k").select("k", "score")


def below(counts: DataFrame, *, value_col: str, count_col: str, name: str, ranges: int = 256) -> DataFrame:
    """The rows of distinct values with ``name``: the sum of ``count_col`` over all smaller values.

    Values fall into at most ``ranges`` ranges cut at approximate quantiles (the
    only thing that reaches the driver); each range sums by itself, so no task
    sees all values. NaN counts as the largest value.
    """
    cuts = counts.agg(F.percentile_approx(value_col, [n / ranges for n in range(1, ranges)])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col(value_col)))
    placed = counts.withColumn("_range", part)
    totals = placed.groupBy("_range").agg(F.sum(count_col).alias("_t"))  # one row for each range
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.sum(count_col).over(W.partitionBy("_range").orderBy(value_col).rowsBetween(W.unboundedPreceding, -1))
    ranked = placed.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "_range")
    return ranked.withColumn(name, F.col("_in") + F.col("_off")).drop("_range", "_in", "_off")


def auc(df: DataFrame, *, score_col: str, label_col: str) -> DataFrame:
    """Area under the ROC curve by average ranks of the distinct scores; null for a single class."""
    by = df.where(F.col(score_col).isNotNull()).groupBy(F.col(score_col).cast("double").alias("s")).agg(F.count_if(F.col(label_col) == 1).alias("p"), F.count_if(F.col(label_col) == 0).alias("n"))
    steps = below(by, value_col="s", count_col="n", name="b")
    return steps.agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2.0)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def class_auc(df: DataFrame, *, scores_col: str, label_col: str, classes: tuple[str, ...]) -> DataFrame:
    """auc: the mean over ``classes`` of each one's area against all others, by its own score in an array in their order; null where a class has no rows or all.

    Rows with a null label or array, or an array of another length, are left out. Each class is
    ranked within ranges of its scores, so neither a class nor the table meets in one task.
    """
    whole = df.where(F.col(label_col).isNotNull() & (F.size(scores_col) == len(classes)))
    each = whole.select(F.col(label_col).cast("string").alias("y"), F.posexplode(scores_col).alias("k", "s")).where("s is not null")
    mine = F.col("y") == F.element_at(F.array(*map(F.lit, classes)), F.col("k") + 1)
    by = each.groupBy("k", F.col("s").cast("double").alias("s")).agg(F.count_if(mine).alias("p"), F.count_if(~mine).alias("n"))
    areas = []
    for k in range(len(classes)):  # classes are a benchmark's, few by nature
        steps = below(by.where(F.col("k") == k), value_col="s", count_col="n", name="b")
        areas.append(steps.agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2.0)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("a")))
    both = areas[0]
    for a in areas[1:]:
        both = both.union(a)
    return both.agg(F.when(F.count("a") == len(classes), F.avg("a")).alias("auc"))


def mcc(df: DataFrame, *, pred_col: str, label_col: str) -> DataFrame:
    p, y = F.col(pred_col), F.col(label_col)
    c = df.agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"))
    d = [F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn")]
    tp, tn, fp, fn = d
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(F.when(under == 0, 0.0).otherwise((tp * tn - fp * fn) / under).alias("mcc"))


def gini(df: DataFrame, *, category_col: str, correct_col: str) -> DataFrame:
    """Half the relative mean difference of the categories' accuracies, from their sorted order."""
    acc = df.groupBy(category_col).agg(F.avg(F.col(correct_col).cast("double")).alias("a"))
    ranked = acc.select("a", F.row_number().over(W.orderBy("a", category_col)).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    return ranked.agg(F.when(F.sum("a") == 0, 0.0).otherwise(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("a")) / (F.max("n") * F.sum("a"))).alias("gini"))
