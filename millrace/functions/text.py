"""Text functions: normalisation and answer extraction, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: White space as Unicode has it, and the separators that text processing commonly counts with it.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, WHITE, " ")))


def normalize_answer(c: Column) -> Column:
    """The final answer of a text, without case, punctuation and articles; null is empty.

    It is what follows the last ``####``; else, if the text opens a box, what
    the last one holds up to its first closing brace; else, of more than 50
    characters, what they say the answer or result is.
    """
    c = F.coalesce(c, F.lit(""))
    after = F.element_at(F.split(c, "####"), -1)
    boxes = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]+)\}"), F.lit(1))
    said = F.trim(F.regexp_extract(c, r"(?iU)(?:answer|result)\s+is\s+:?\s*([^!.?\n]+)", 1))
    pick = F.when(c.contains("####"), after).when(c.contains("\\boxed{"), F.coalesce(F.try_element_at(boxes, F.lit(-1)), c)).when((F.length(c) > 50) & (said != ""), said).otherwise(c)
    bare = F.regexp_replace(F.translate(F.lower(pick), PUNCTUATION, ""), r"(?U)\b(?:a|an|the)\b", " ")
    return F.trim(F.regexp_replace(bare, WHITE, " "))


def first_number(c: Column) -> Column:
    """The first number of a text, thousands separators dropped; null if there is none."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def choice(c: Column, *, fixed: bool = False) -> Column:
    """The option letter: after ``answer`` or ``option``, else the first letter that stands alone.

    The plain form takes one character of ``:is`` between the two, so that
    ``THE ANSWER IS B`` gives S; ``fixed`` reads a colon or the word.
    """
    up = F.upper(c)
    between = r"\s*(?::|IS:?)\s*" if fixed else r"\s*[:IS]\s*"
    named = F.regexp_extract(up, rf"(?:ANSWER|OPTION){between}\(?([A-Z])", 1)
    alone = F.regexp_extract(up, r"(?:^|[^A-Z0-9_])([A-Z])(?:[^A-Z0-9_]|$)", 1)
    return F.nullif(F.when(named != "", named).otherwise(alone), F.lit(""))


def safe_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), F.lit("._"))


def truthy(c: Column) -> Column:
    return ~F.lower(F.trim(c)).isin("0", "false", "no", "off", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"\s+", " ")), " "), lambda w: w != "")
