"""Scores of a predicted text against reference texts, as Columns; of several references the best counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import normalize_answer


def words(c: Column) -> Column:
    """The words of a normalised answer; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(normalize_answer(c), F.lit("")), " "), lambda w: w != "")


def exact_match(pred: Column, refs: Column) -> Column:
    """Whether the normalised prediction equals any normalised reference; null matches nothing."""
    same = F.exists(refs, lambda r: r.isNotNull() & (normalize_answer(r) == normalize_answer(pred)))
    return pred.isNotNull() & F.coalesce(same, F.lit(False))


def keyword_recall(pred: Column, refs: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Share of the references' words, less ``stopwords``, that the prediction holds; null without any."""
    keys = F.array_distinct(F.flatten(F.transform(refs, words)))
    if stopwords:
        keys = F.array_except(keys, F.array(*map(F.lit, stopwords)))
    return F.size(F.array_intersect(keys, words(pred))) / F.nullif(F.size(keys), F.lit(0))


def format_compliance(pred: Column, answer: Column) -> Column:
    """Length of the extracted answer against the text, times 0.8 where code fences stand; 0 for a blank text."""
    bare = F.trim(F.coalesce(pred, F.lit("")))
    share = F.length(F.trim(F.coalesce(answer, F.lit("")))) / F.nullif(F.length(bare), F.lit(0))
    fenced = F.when(bare.contains("```"), 0.8).otherwise(1.0)
    return F.when(bare == "", 0.0).otherwise(F.least(F.lit(1.0), share * fenced))


def reasoning_efficiency(pred: Column, ref: Column) -> Column:
    """Length of the reference against the prediction; null for an empty prediction."""
    return F.length(ref) / F.nullif(F.length(pred), F.lit(0))


def multi_choice(c: Column) -> Column:
    """The distinct letters that stand alone; else, in an answer of at most five letters, each of them."""
    up = F.upper(F.coalesce(c, F.lit("")))
    alone = F.array_distinct(F.regexp_extract_all(up, F.lit(r"\b([A-Z])\b"), F.lit(1)))
    letters = F.regexp_replace(up, "[^A-Z]", "")
    each = F.array_distinct(F.filter(F.split(letters, ""), lambda x: x != ""))
    return F.when(F.size(alone) > 0, alone).when(F.length(letters) <= 5, each).otherwise(F.array().cast("array<string>"))
