"""Changes to records: messages put in or replaced, identities and reasoning taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_message(m: Column, role: str, content: Column) -> Column:
    """The first message of ``role`` gets ``content``; without one, a message is added at the end. A null array counts as empty."""
    m = F.coalesce(m, F.array().cast("array<struct<role: string, content: string>>"))
    own = F.lower(F.lit(role))
    place = F.array_position(F.transform(m, lambda x: F.coalesce(F.lower(x["role"]), F.lit(""))), own)
    new = lambda r: F.struct(r.alias("role"), content.alias("content"))
    replaced = F.transform(m, lambda x, i: F.when(i + 1 == place, new(x["role"])).otherwise(F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return F.when(place > 0, replaced).otherwise(F.concat(m, F.array(new(F.lit(role)))))


def merge_identity(made: DataFrame, source: DataFrame, *, key: str, id_col: str, meta_col: str) -> DataFrame:
    """``made`` with the id of its source where it has none, and the source's members of a map where it lacks them."""
    old = source.select(key, F.col(id_col).alias("_id"), F.col(meta_col).alias("_meta"))
    none = F.expr("cast(map() as map<string, string>)")
    own, other = F.coalesce(F.col(meta_col), none), F.coalesce(F.col("_meta"), none)
    merged = F.map_concat(F.map_filter(other, lambda k, v: ~F.map_contains_key(own, k)), own)
    return made.join(old, key, "left").withColumns({id_col: F.coalesce(F.col(id_col), F.col("_id")), meta_col: merged}).drop("_id", "_meta")


def first_present(df: DataFrame, names: tuple[str, ...], hint: str | None = None) -> Column:
    """The hinted column, else the first of ``names`` that the table has; null if it has none. Present is not the same as filled."""
    there = next((n for n in ((hint,) if hint else ()) + names if n in df.columns), None)
    return F.col(there) if there else F.lit(None)


def think_first(m: Column, reasoning: Column) -> Column:
    """The first assistant message with the reasoning before it, in think tags; without reasoning, unchanged."""
    place = F.array_position(F.transform(m, lambda x: F.coalesce(F.lower(x["role"]), F.lit(""))), F.lit("assistant"))
    lead = F.concat(F.lit("<think>"), reasoning, F.lit("</think>"))
    added = F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(i + 1 == place, F.concat(lead, F.coalesce(x["content"], F.lit("")))).otherwise(x["content"]).alias("content")))
    return F.when(F.coalesce(F.length(F.trim(reasoning)) > 0, F.lit(False)), added).otherwise(m)
