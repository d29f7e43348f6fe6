"""Metrics by name: what a benchmark asks for is looked up and computed in one aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import answers, overlap, text
from millrace.operators.metrics import set_f1

Metric = Callable[[Column, Column], Column]


def strict_match(pred: Column, refs: Column) -> Column:
    """Whether the prediction is one of the references, character by character."""
    return F.coalesce(F.array_contains(refs, pred), F.lit(False))


def choice_accuracy(pred: Column, refs: Column) -> Column:
    """Whether the option letter of the prediction is that of a reference; false without one."""
    return F.coalesce(F.exists(refs, lambda r: text.choice(r) == text.choice(pred)), F.lit(False))


def accuracy(pred: Column, refs: Column) -> Column:
    """Trimmed equality with a reference, else equal option letters."""
    return F.coalesce(F.exists(refs, lambda r: F.trim(r) == F.trim(pred)), F.lit(False)) | choice_accuracy(pred, refs)


def extracted(pred: Column, refs: Column) -> Column:
    """Whether the prediction has a number."""
    return answers.number(pred).isNotNull()


def extracted_choice(pred: Column, refs: Column) -> Column:
    return text.choice(pred).isNotNull()


def micro_f1(pred: Column, refs: Column, options: int = 26) -> Column:
    """F1 of the sets of options that the prediction and the first reference name; both empty: 1."""
    n = F.lit(options)
    return set_f1(answers.option_set(pred, n), answers.option_set(F.try_element_at(refs, F.lit(1)), n))


#: name -> (metric of a row, other names)
METRICS: dict[str, tuple[Metric, tuple[str, ...]]] = {
    "exact_match": (overlap.exact_match, ("em",)),
    "strict_match": (strict_match, ("strict",)),
    "choice_accuracy": (choice_accuracy, ("mc_accuracy",)),
    "accuracy": (accuracy, ("acc", "acc_norm")),
    "extraction_rate": (extracted, ("number_rate",)),
    "choice_extraction_rate": (extracted_choice, ()),
    "missing_answer_rate": (lambda p, r: ~extracted(p, r), ()),
    "micro_f1": (micro_f1, ("multilabel_f1",)),
    "keyword_recall": (overlap.keyword_recall, ()),
}


def resolve(name: str) -> str:
    """The registered name of a metric, by name or other name, in any case."""
    low = name.strip().lower()
    for key, (_, others) in METRICS.items():
        if low == key or low in others:
            return key
    raise KeyError(f"no metric {name!r}")


def evaluate(df: DataFrame, names: tuple[str, ...], *, pred: str, refs: str) -> DataFrame:
    """metric, score, n: the mean of each metric over all rows, in one pass; a null of a row counts as none."""
    keys = list(dict.fromkeys(map(resolve, names)))
    values = df.select(*[METRICS[k][0](F.col(pred), F.col(refs)).cast("double").alias(k) for k in keys])
    means = values.agg(*[F.struct(F.avg(k).alias("score"), F.count(k).alias("n")).alias(k) for k in keys])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k)["score"].alias("score"), F.col(k)["n"].alias("n")) for k in keys])).alias("x")).select("x.*")


#: Data sets and the metrics that they are scored by, in lower case.
DATASETS: dict[str, tuple[str, ...]] = {}


def register_dataset(name: str, metrics: tuple[str, ...]) -> None:
    """From now on the data set, in any case, is scored by these; an unknown metric is an error here and not later."""
    DATASETS[name.strip().lower()] = tuple(map(resolve, metrics))


def evaluate_datasets(df: DataFrame, *, dataset: str, pred: str, refs: str, default: tuple[str, ...] = ()) -> DataFrame:
    """dataset, metric, score, n: each data set's rows by its own metrics, or by ``default`` where it has none, in one pass over all.

    Names are compared in lower case, trimmed; a row without one is not scored. A metric is
    computed only in rows of data sets that ask for it.
    """
    fallback = tuple(map(resolve, default))
    name = F.lower(F.trim(F.col(dataset)))
    asks = {k: name.isin(*[d for d, ms in DATASETS.items() if k in ms]) | (F.lit(k in fallback) & ~name.isin(*DATASETS)) for k in METRICS if k in fallback or any(k in ms for ms in DATASETS.values())}
    if not asks:
        raise ValueError("no data set has metrics and there is no default")
    values = df.where(name.isNotNull()).select(name.alias("dataset"), *[F.when(wanted, METRICS[k][0](F.col(pred), F.col(refs)).cast("double")).alias(k) for k, wanted in asks.items()])
    means = values.groupBy("dataset").agg(*[F.struct(F.avg(k).alias("score"), F.count(k).alias("n")).alias(k) for k in asks])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k)["score"].alias("score"), F.col(k)["n"].alias("n")) for k in asks]))
    return means.select("dataset", each.alias("x")).select("dataset", "x.*").where("n > 0")


def mcc(df: DataFrame, *, pred_col: str, label_col: str) -> DataFrame:
    """Matthews' correlation for any number of classes, from counts of the pairs; 0 where it is undefined. Rows with a null are left out."""
    pairs = df.where(F.col(pred_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(pred_col).cast("string").alias("p"), F.col(label_col).cast("string").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = pairs.select(F.explode(F.array(F.struct(F.col("p").alias("k"), F.col("n").alias("np"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("c")), F.struct(F.col("y").alias("k"), F.lit(0.0).alias("np"), F.col("n").alias("ny"), F.when(F.col("p") == F.col("y"), F.col("n")).otherwise(0.0).alias("c")))).alias("x")).select("x.*")
    each = side.groupBy("k").agg(F.sum("np").alias("np"), F.sum("ny").alias("ny"), F.sum("c").alias("c"))
    s = each.agg(F.sum("c").alias("c"), F.sum("ny").alias("s"), F.sum(F.col("np") * F.col("ny")).alias("py"), F.sum(F.col("np") * F.col("np")).alias("pp"), F.sum(F.col("ny") * F.col("ny")).alias("yy"))
    under = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("yy")))
    return s.select(F.when(under > 0, (F.col("c") * F.col("s") - F.col("py")) / under).otherwise(0.0).alias("mcc"))
