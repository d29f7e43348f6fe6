"""Field paths such as ``a.b[2].c`` and ``a[*].b``, compiled against a schema to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

TOKEN = re.compile(r"^([^\[\]]+)(?:\[([^\]]*)\])?$")


def _none() -> Column:
    return F.array().cast("array<string>")


def _present(a: Column) -> Column:
    return F.filter(F.coalesce(a, _none()), lambda x: x.isNotNull() & (x != ""))


def _null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def flat_text(c: Column, kind: DataType) -> Column:
    """A value as one text: structs and maps as ``k. v; k. v``, lists as ``v; v``; null if nothing is in it."""
    if isinstance(kind, ArrayType):
        return _null_if_blank(F.array_join(_present(F.transform(c, lambda x: flat_text(x, kind.elementType))), "; "))
    if isinstance(kind, StructType | MapType):
        return _null_if_blank(F.array_join(_present(_entries(c, kind, _entry)), "; "))
    return c.cast("string")


def _entry(key: Column, value: Column) -> Column:
    return F.when(_null_if_blank(value).isNull(), key).otherwise(F.concat(key, F.lit(". "), value))


def _pair(key: Column, value: Column) -> Column:
    return F.concat_ws("; ", key, _null_if_blank(value))


def _entries(c: Column, kind: DataType, form: Callable[[Column, Column], Column]) -> Column:
    if isinstance(kind, MapType):
        return F.transform(F.map_entries(c), lambda e: form(e["key"].cast("string"), flat_text(e["value"], kind.valueType)))
    return F.when(c.isNotNull(), F.array(*[form(F.lit(f.name), flat_text(c[f.name], f.dataType)) for f in kind.fields]))


def _values(c: Column, kind: DataType, tokens: list[str], form: Callable[[Column, Column], Column]) -> Column:
    if not tokens:
        if isinstance(kind, ArrayType):
            inner = lambda x: F.coalesce(_values(x, kind.elementType, [], form), _none())
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), inner))
        if isinstance(kind, StructType | MapType):
            return F.coalesce(_entries(c, kind, form), _none())
        return F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(_none())
    found = TOKEN.match(tokens[0])
    if not found or not isinstance(kind, StructType | MapType):
        return _none()
    name, index = found.groups()
    if isinstance(kind, StructType):
        if name not in kind.names:
            return _none()
        c, kind = c[name], kind[name].dataType
    else:
        c, kind = F.try_element_at(c, F.lit(name)), kind.valueType
    return _indexed(c, kind, index, tokens[1:], form)


def _indexed(c: Column, kind: DataType, index: str | None, rest: list[str], form: Callable[[Column, Column], Column]) -> Column:
    if not index:
        return _values(c, kind, rest, form)
    if isinstance(kind, ArrayType):
        if index.lower() in ("*", "all"):
            inner = lambda x: F.coalesce(_values(x, kind.elementType, rest, form), _none())
            return F.flatten(F.transform(F.coalesce(c, F.array().cast(kind)), inner))
        return _values(F.get(c, F.lit(int(index))), kind.elementType, rest, form) if index.isdigit() else _none()

    def children(key: Column, value: Column, child: DataType) -> Column:
        got = _values(value, child, rest, _pair)
        return F.when(F.size(got) > 0, F.transform(got, lambda x: _entry(key, x))).otherwise(F.array(_entry(key, flat_text(value, child))))

    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(c), lambda e: children(e["key"].cast("string"), e["value"], kind.valueType))), _none())
    if isinstance(kind, StructType):
        each = [children(F.lit(f.name), c[f.name], f.dataType) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(*each)).otherwise(_none())
    return _none()


def values(df: DataFrame, spec: str) -> Column:
    """The texts that a path finds in each row, empty ones left out.

    A list without an index gives all its items, a struct or map at the end of
    a path its entries as ``k. v``; ``[n]`` counts from 0, ``[*]`` and
    ``[all]`` take every item, and any of the two on a struct or map gives
    ``key. value`` for each. Unknown columns, indices out of range and nulls
    give an empty array. Column names are matched as they are written.
    """
    tokens = spec.strip().split(".")
    found = TOKEN.match(tokens[0])
    if not found or found[1] not in df.columns:
        return _none()
    name = found[1].replace("`", "``")
    return _present(_indexed(F.col(f"`{name}`"), df.schema[found[1]].dataType, found[2], tokens[1:], _entry))


def joined(df: DataFrame, specs: str | list[str], sep: str = "\n") -> Column:
    """Values of one or several paths in one text; null if there are none."""
    parts = F.concat(*[values(df, s) for s in ([specs] if isinstance(specs, str) else specs)])
    return _null_if_blank(F.array_join(parts, sep))


def meta(df: DataFrame, specs: dict[str, str]) -> Column:
    """struct<string>: each member from a path, or the text itself where its head names no column."""
    head = lambda s: re.split(r"[.\[]", s.strip())[0]
    return F.struct(*[(joined(df, s) if head(s) in df.columns else F.lit(s)).cast(StringType()).alias(k) for k, s in specs.items()])


def pretrain(df: DataFrame, specs: list[str], meta_specs: dict[str, str] | None = None) -> DataFrame:
    """id, dataset_type, text, meta: the stripped values of the paths, joined by a blank; rows without text go. Ids come from the text."""
    text = F.array_join(_present(F.transform(F.concat(*[values(df, s) for s in specs]), F.trim)), " ")
    out = df.select(text.alias("text"), (meta(df, meta_specs) if meta_specs else F.lit(None).cast("struct<source:string>")).alias("meta"))
    return out.where("text <> ''").select(F.md5("text").alias("id"), F.lit("pretrain").alias("dataset_type"), "text", "meta")


def instruct(df: DataFrame, roles: list[tuple[str, str | list[str]]], system: str | None = None) -> DataFrame:
    """id, dataset_type, messages, system: one message for each role whose paths find a text; only the assistant's count for the loss. Rows without messages go."""
    made = [F.struct(F.lit(role).alias("role"), joined(df, spec).alias("content"), F.lit(role == "assistant").alias("loss_mask")) for role, spec in roles]
    messages = F.filter(F.array(*made), lambda m: m["content"].isNotNull())
    out = df.select(messages.alias("messages"), (joined(df, system) if system else F.lit(None).cast("string")).alias("system"))
    return out.where(F.size("messages") > 0).select(F.md5(F.to_json("messages")).alias("id"), F.lit("sft").alias("dataset_type"), "messages", "system")
