"""Scores of generated texts that need no model: likeness, variety and repetition."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The share of each part in the whole, the length of the word sequences that repetition is told by, and of the longest that likeness is.
WEIGHTS = {"bleu": 0.4, "lexical_diversity": 0.3, "ngram": 0.3}
RUN, ORDER = 5, 4
_IDEOGRAPH = r"([\x{4e00}-\x{9fff}])"


def words(c: Column) -> Column:
    """What white space parts; each Chinese ideograph is a word of its own. Null has none."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), _IDEOGRAPH, " $1 "), r"\s+"), lambda w: w != "")


def lexical_diversity(c: Column) -> Column:
    """Distinct words over all words; 0 without any."""
    return F.transform(F.array(words(c)), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0))[0]


def distinct_runs(c: Column, n: int = RUN) -> Column:
    """Distinct sequences of ``n`` words over all, in lower case, without punctuation; 0 for a shorter text."""

    def share(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.transform(F.array(runs), lambda r: F.size(F.array_distinct(r)) / F.size(r))[0]).otherwise(0.0)

    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.transform(F.array(words(bare)), share)[0]


@F.pandas_udf(DoubleType())
def bleu(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """Of each row's words by themselves: clipped n-grams of one to four words, geometric mean, short texts scaled down; 0 if a text is empty or an order has no match."""

    def one(p: list[str], r: list[str]) -> float:
        logs = 0.0
        for n in range(1, ORDER + 1):
            mine, theirs = (Counter(zip(*(w[i:] for i in range(n)), strict=False)) for w in (p, r))
            hit = sum((mine & theirs).values())
            if not hit:
                return 0.0
            logs += math.log(hit / (len(p) - n + 1))
        return math.exp(logs / ORDER) * (math.exp(1 - len(r) / len(p)) if len(p) < len(r) else 1.0)

    return pd.Series([one(list(p), list(r)) for p, r in zip(pred, ref, strict=True)], dtype="float64")


def sample_scores(df: DataFrame, *, id_col: str, pred: str, ref: str, weights: dict[str, float] | None = None) -> DataFrame:
    """id, bleu, lexical_diversity, ngram and their weighted ``overall`` of each generated text, to four digits. Null texts are empty.

    A row's scores need no other row, so nothing is shuffled.
    """
    w = WEIGHTS if weights is None else weights
    each = df.select(F.col(id_col).alias("id"), bleu(words(F.col(pred)), words(F.col(ref))).alias("bleu"), lexical_diversity(F.col(pred)).alias("lexical_diversity"), distinct_runs(F.col(pred)).alias("ngram"))
    overall = sum((F.col(k) * w[k] for k in WEIGHTS), F.lit(0.0))
    return each.select("id", *[F.round(k, 4).alias(k) for k in WEIGHTS], F.round(overall, 4).alias("overall"))


def average_scores(scores: DataFrame) -> DataFrame:
    """samples and the mean of each score, to four digits: one row; without samples all are 0."""
    means = [F.round(F.coalesce(F.avg(k), F.lit(0.0)), 4).alias(k) for k in (*WEIGHTS, "overall")]
    return scores.agg(F.count(F.lit(1)).alias("samples"), *means)
