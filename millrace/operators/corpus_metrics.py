"""Corpus scores of predictions against references: counts of n-grams by sample, then one small sum.

A sample's n-grams are counted where its row is, a few rows at a time, and
only their counts are shuffled; the last step sees one row for each order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.operators.metrics import below

#: The steps of the mteval-13a tokeniser.
STEPS_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokens_13a(c: Column) -> Column:
    out = F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" "))
    for pattern, by in STEPS_13A:
        out = F.regexp_replace(out, pattern, by)
    return F.filter(F.split(F.trim(out), r"\s+"), lambda w: w != "")


def characters(c: Column) -> Column:
    """The characters that are not white space."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""), ""), lambda w: w != "")


def _count(stream: Iterator[pa.RecordBatch], order: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """What ``_matched`` returns, of ``rows`` samples at a time, so that few tokens are Python objects at once."""
    grams = lambda toks, n: Counter(zip(*(toks[i:] for i in range(n)), strict=False))
    longs, each = pa.list_(pa.int64()), range(1, order + 1)
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            hits, clipped, preds, refs = [], [], part.column(1).to_pylist(), part.column(2).to_pylist()
            for p, rs in zip(preds, refs, strict=True):
                mine, theirs = [grams(p, n) for n in each], [[grams(r, n) for n in each] for r in rs]
                hits.append([[(m & t).total() for m, t in zip(mine, ts, strict=True)] for ts in theirs])
                clipped.append([sum(min(c, max((ts[n][g] for ts in theirs), default=0)) for g, c in m.items()) for n, m in enumerate(mine)])
            sizes = [pa.array([len(p) for p in preds], pa.int64()), pa.array([[len(r) for r in rs] for rs in refs], longs)]
            yield pa.RecordBatch.from_arrays([part.column(0), *sizes, pa.array(hits, pa.list_(longs)), pa.array(clipped, longs)], ["id", "p", "rs", "hits", "clipped"])


def _matched(df: DataFrame, id_col: str, pred: str, refs: str, split: Callable[[Column], Column], order: int) -> DataFrame:
    """id, p and rs (tokens of the prediction and of each reference), hits (n-grams in common with each reference, by order), clipped (with the reference that has most of each).

    Null references are empty ones; a null list has none. Nothing is shuffled.
    """
    each = F.transform(F.coalesce(F.col(refs), F.array().cast("array<string>")), split)
    toks = df.select(F.col(id_col).alias("id"), split(F.col(pred)).alias("p"), each.alias("rs"))
    return toks.mapInArrow(lambda stream: _count(stream, order), f"id {dict(toks.dtypes)['id']}, p long, rs array<long>, hits array<array<long>>, clipped array<long>")


def _grams_of(size: Column, n: Column | int) -> Column:
    return F.greatest(size - n + 1, F.lit(0)).cast("long")


def bleu(df: DataFrame, *, id_col: str, pred: str, refs: str, order: int = 4) -> DataFrame:
    """score: corpus BLEU from 0 to 1, of 13a tokens, clipped by the best reference, closest reference length, exponential smoothing.

    Predictions without references count with no match and length 0. Ids must
    be unique. No rows, or no n-gram of some order, give 0.
    """
    rows = _matched(df, id_col, pred, refs, tokens_13a, order)
    sums = [F.struct(F.lit(n).alias("n"), F.sum(F.col("clipped")[n - 1]).alias("hit"), F.sum(_grams_of(F.col("p"), n)).alias("all")) for n in range(1, order + 1)]
    near = F.array_min(F.transform("rs", lambda r: F.struct(F.abs(r - F.col("p")).alias("d"), r.alias("r"))))["r"]
    summed = rows.agg(F.array(*sums).alias("by"), F.sum("p").alias("sys"), F.sum(F.coalesce(near, F.lit(0))).alias("ref"))
    by, whole = summed.select(F.explode("by").alias("x")).select("x.*"), summed.select("sys", "ref")
    # From here on there is one row for each order.
    stats = by.where(F.col("all") > 0).select("n", F.coalesce("hit", F.lit(0)).alias("hit"), "all")
    zeros = F.sum(F.when(F.col("hit") == 0, 1).otherwise(0)).over(W.partitionBy(F.lit(0)).orderBy("n"))
    logs = stats.select(F.log(F.when(F.col("hit") == 0, 1 / (F.pow(F.lit(2.0), zeros) * F.col("all"))).otherwise(F.col("hit") / F.col("all"))).alias("l"), "hit")
    mean = logs.agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("k"), F.sum("hit").alias("hit"))
    brief = F.when(F.col("sys") < F.col("ref"), F.exp(1 - F.col("ref") / F.col("sys"))).otherwise(1.0)
    return mean.crossJoin(whole).select(F.when((F.col("k") < order) | (F.col("hit") == 0), 0.0).otherwise(F.least(F.lit(1.0), brief * F.exp(F.col("l") / order))).alias("score"))


def chrf(df: DataFrame, *, id_col: str, pred: str, refs: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """score: corpus chrF from 0 to 1 over character n-grams; each sample counts against its reference of best own score.

    Samples without references are left out; no rows give 0.
    """
    matched = _matched(df, id_col, pred, refs, characters, order)
    sides = matched.select("id", F.col("p").alias("own"), F.posexplode(F.arrays_zip("rs", "hits")).alias("side", "x"))
    rows = sides.select("id", "side", "own", "x.rs", F.posexplode("x.hits").alias("n", "hit")).withColumn("n", F.col("n") + 1)
    rows = rows.select("id", "side", "n", "hit", _grams_of(F.col("own"), F.col("n")).alias("p"), _grams_of(F.col("rs"), F.col("n")).alias("c"))
    each = rows.groupBy("id", "side").agg(*_fscore(beta), F.collect_list(F.struct("n", "hit", "p", "c")).alias("all"))
    best = each.groupBy("id").agg(F.max_by("all", F.struct(F.col("f"), -F.col("side"))).alias("all"))
    summed = best.select(F.explode("all").alias("x")).groupBy("x.n").agg(*[F.sum(f"x.{k}").alias(k) for k in ("hit", "p", "c")])
    return summed.agg(*_fscore(beta)).select(F.coalesce("f", F.lit(0.0)).alias("score"))


def _fscore(beta: float) -> list[Column]:
    both = (F.col("p") > 0) & (F.col("c") > 0)
    p, r = F.avg(F.when(both, F.col("hit") / F.col("p"))), F.avg(F.when(both, F.col("hit") / F.col("c")))
    return [F.coalesce((1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)), F.lit(0.0)).alias("f")]


def token_f1(df: DataFrame, *, id_col: str, pred: str, refs: str) -> DataFrame:
    """id, score: best multiset F1 of normalised words over the references; 1 if both are empty, 0 without references."""
    from millrace.functions.overlap import words

    matched = _matched(df, id_col, pred, refs, words, 1)
    f = lambda x: F.when((F.col("p") == 0) & (x["rs"] == 0), 1.0).otherwise(2.0 * x["hits"][0] / (F.col("p") + x["rs"]))
    best = F.array_max(F.transform(F.arrays_zip("rs", "hits"), f))
    return matched.groupBy("id").agg(F.max(F.coalesce(best, F.lit(0.0))).alias("score"))


@F.pandas_udf(DoubleType())
def rouge_l(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of lower-case words ``[a-z0-9]+``, unstemmed; 0 for an empty side.

    Positions of a word are kept as bits of one integer, so that a pair costs
    one pass over the shorter text.
    """
    import re

    def one(a: str | None, b: str | None) -> float:
        x, y = (re.findall("[a-z0-9]+", (s or "").lower()) for s in (a, b))
        if not x or not y:
            return 0.0
        where: dict[str, int] = {}
        for i, w in enumerate(x):
            where[w] = where.get(w, 0) | 1 << i
        full, row = (1 << len(x)) - 1, (1 << len(x)) - 1
        for w in y:
            hit = row & where.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return 2.0 * (len(x) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([one(a, b) for a, b in zip(pred, ref, strict=True)], dtype="float64")


def spearman(df: DataFrame, *, x_col: str, y_col: str) -> DataFrame:
    """rho: correlation of average ranks. Ranks come from running counts of the distinct values; null where one side is constant."""

    def ranks(col: str, name: str) -> DataFrame:
        by = df.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull()).groupBy(F.col(col).cast("double").alias(f"_{name}")).agg(F.count(F.lit(1)).alias("c"))
        return below(by, value_col=f"_{name}", count_col="c", name="_b").select(f"_{name}", (F.col("_b") + (F.col("c") + 1) / 2).alias(name))

    ranked = df.join(ranks(x_col, "rx"), F.col(x_col).cast("double") == F.col("_rx")).join(ranks(y_col, "ry"), F.col(y_col).cast("double") == F.col("_ry"))
    return ranked.agg(F.corr("rx", "ry").alias("rho")).select(F.when(~F.isnan("rho"), F.col("rho")).alias("rho"))
