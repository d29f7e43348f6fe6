"""English word stems, and ROUGE-L over stems."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The published suffix rules, with the extensions that ROUGE's scorer uses: whole words, then suffixes and what replaces them.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as v and c; y is a consonant at the start and after a vowel."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    """Whether the end is consonant, vowel and a consonant other than w, x and y, or the whole a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """By the first rule whose suffix the word has, if a syllable is left."""
    for suffix, by in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + by if _measure(stem) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-2] if word.endswith("sses") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _doubled(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _doubled(word[:-2])
    if word.endswith("logi"):  # after the suffixes above, none of which ends so
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replaced(word, STEP_2)


def _residual(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))) else word
    return word


@cache
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _residual(_replaced(_doubled(word), STEP_3))
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stemmed_words(text: str | None) -> list[str]:
    """Lower-case runs of ASCII letters and digits, those of more than three characters stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


def common_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: positions of a word are bits of one integer, so it takes one pass over ``y``."""
    where: dict[str, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    row = full = (1 << len(x)) - 1
    for w in y:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l_stemmed(pred: pd.Series, refs: pd.Series) -> pd.Series:
    """The best F1, over references, of the longest common subsequence of stems; 0 without words or references."""

    def one(p: str | None, rs: list[str | None] | None) -> float:
        x, best = stemmed_words(p), 0.0
        for y in map(stemmed_words, rs if rs is not None else ()):
            if x and y:
                best = max(best, 2.0 * common_length(x, y) / (len(x) + len(y)))
        return best

    return pd.Series([one(a, b) for a, b in zip(pred, refs, strict=True)], dtype="float64")
