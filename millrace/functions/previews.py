"""Values of any type as short JSON text, for previews and prompts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, FractionalType, IntegralType, MapType, StringType, StructType, DecimalType


@dataclass(frozen=True)
class Limits:
    """What of a value is shown, and the texts that stand for the rest, made of how much there is."""

    chars: int
    items: int
    depth: int
    cut: Callable[[Column], Column]  # the length of a text
    more: Callable[[Column], Column]  # the items left out
    more_keys: Callable[[Column], Column]  # the members left out, as a member


def _said(before: str, after: str) -> Callable[[Column], Column]:
    return lambda n: F.concat(F.lit(before), n.cast("string"), F.lit(after))


# Limits and marks of previews of files, and of samples of records.
PREVIEW = Limits(2500, 48, 14, _said("...(truncated,len=", ")"), _said('"...(', ' more items)"'), _said('"__truncated_keys__":', ""))
SAMPLE = Limits(200, 3, 1000, lambda n: F.lit("..."), lambda n: F.lit('"..."'), lambda n: F.lit('"...":"..."'))


def _json(c: Column) -> Column:
    """One value as JSON text."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(shown: Column, size: Column, limit: int, mark: Callable[[Column], Column]) -> Column:
    rest = F.when(size > limit, F.array(mark(size - limit))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(shown, rest), ",")


def shortened(c: Column, kind: DataType, limits: Limits = PREVIEW, depth: int = 0) -> Column:
    """JSON text of a value of this type, without spaces: texts, lists and members are cut, each with a mark of what is missing.

    The text is built along the schema, so only what is shown is looked at.
    Null is ``null``; bytes give their number; dates, decimals and the like are
    texts. Below ``limits.depth`` levels a mark stands for whatever is there.
    """
    if depth > limits.depth:
        return F.lit('"<nested_too_deep>"')
    n = limits.items
    if isinstance(kind, StructType):
        members = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), shortened(c[f.name], f.dataType, limits, depth + 1)) for f in kind.fields[:n]]
        shown = F.array(*members) if members else F.array().cast("array<string>")
        text = F.concat(F.lit("{"), _listed(shown, F.lit(len(kind.fields)), n, limits.more_keys), F.lit("}"))
    elif isinstance(kind, MapType):
        member = lambda e: F.concat(_json(e["key"].cast("string")), F.lit(":"), shortened(e["value"], kind.valueType, limits, depth + 1))
        text = F.concat(F.lit("{"), _listed(F.transform(F.slice(F.map_entries(c), 1, n), member), F.size(c), n, limits.more_keys), F.lit("}"))
    elif isinstance(kind, ArrayType):
        item = lambda x: shortened(x, kind.elementType, limits, depth + 1)
        text = F.concat(F.lit("["), _listed(F.transform(F.slice(c, 1, n), item), F.size(c), n, limits.more), F.lit("]"))
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit('"<bytes len='), F.length(c).cast("string"), F.lit('>"'))
    elif isinstance(kind, BooleanType | IntegralType) or (isinstance(kind, FractionalType) and not isinstance(kind, DecimalType)):
        text = _json(c)
    else:
        s = c if isinstance(kind, StringType) else c.cast("string")
        text = _json(F.when(F.length(s) <= limits.chars, s).otherwise(F.concat(F.substring(s, 1, limits.chars), limits.cut(F.length(s)))))
    return F.when(c.isNull(), "null").otherwise(text)


def bounded(text: Column, max_chars: int) -> Column:
    """A text of at most ``max_chars`` characters, ending in a note if it was cut; a short note where the long one leaves under 64."""
    size = F.length(text).cast("string")
    long = F.concat(F.lit("\n...[record JSON truncated: original_chars="), size, F.lit(f", max={max_chars}]"))
    short = F.lit("\n...[truncated]")
    note = F.when(max_chars - F.length(long) < 64, short).otherwise(long)
    kept = F.greatest(max_chars - F.length(note), F.lit(0))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, F.lit(1), kept), note))
