"""Verdicts of rules and models on records, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A judge's view of a failure. Null members are absent.
VERDICT = "struct<stage:string, advice:string, tags:array<string>, evidence:map<string,string>, factors:map<string,string>>"
OTHER = "other"
# From which numbers on a failure has a tag.
MANY_JOINS, NESTED, LOOPS, PATHS = 3, 2, 4, 6


def _texts() -> Column:
    return F.array().cast("array<string>")


def mapping_verdict(answer: Column) -> Column:
    """``accept``, ``reject`` or ``parse_error`` of a model's JSON answer; only true and false count, not their texts.

    It rejects by ``accept`` false or ``reject_mapping`` true; else it accepts
    if ``record`` is an object. All else, null and broken JSON are parse errors.
    """
    said = F.from_json(answer, "accept boolean, reject_mapping boolean, record map<string,string>")
    rejects = (said["accept"] == F.lit(False)) | said["reject_mapping"]
    return F.when(F.coalesce(rejects, F.lit(False)), "reject").when(said["record"].isNotNull(), "accept").otherwise("parse_error")


def sentences(c: Column) -> Column:
    """What stands between full stops and line breaks, trimmed, without what is blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def alignment_constraints(hint: Column, missing: Column, generated: Column, prefix: Column) -> Column:
    """struct<hints, statements, any> that a rewritten statement has to meet: the hint and the missing fields;
    the sentences of the generated evidence, and those of the prompt's prefix that begin with ``evidence`` in any case."""
    hints = F.concat(F.when(F.coalesce(hint, F.lit("")) != "", F.array(hint)).otherwise(_texts()), F.coalesce(missing, _texts()))
    stated = F.concat(sentences(generated), F.filter(sentences(prefix), lambda s: F.lower(s).startswith("evidence")))
    return F.struct(hints.alias("hints"), stated.alias("statements"), ((F.size(hints) > 0) | (F.size(stated) > 0)).alias("any"))


def _laid_over(low: Column, high: Column) -> Column:
    """Members of both maps; where both have one, that of ``high`` unless it is null. Null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(low, none), F.coalesce(high, none), lambda _, a, b: F.coalesce(b, a))


def merged_verdict(rule: Column, model: Column, stages: tuple[str, ...]) -> Column:
    """One ``VERDICT`` of a rule's and a model's.

    A model that names one of ``stages`` other than ``other`` prevails in all
    that it states, and its evidence and factors are laid over the rule's. Any
    other model only adds: factors, advice, and its tags after the rule's,
    each once. Without a model the rule stands.
    """
    sure = F.coalesce(model["stage"].isin(*[s for s in stages if s != OTHER]), F.lit(False))
    added = F.array_distinct(F.concat(F.coalesce(rule["tags"], _texts()), F.coalesce(model["tags"], _texts())))
    more_tags = F.when(F.size(F.coalesce(model["tags"], _texts())) > 0, added).otherwise(rule["tags"])
    merged = F.struct(
        F.when(sure, model["stage"]).otherwise(rule["stage"]).alias("stage"),
        F.when(sure, F.coalesce(model["advice"], rule["advice"])).otherwise(F.coalesce(F.nullif(model["advice"], F.lit("")), rule["advice"])).alias("advice"),
        F.when(sure, F.coalesce(model["tags"], rule["tags"])).otherwise(more_tags).alias("tags"),
        F.when(sure, _laid_over(rule["evidence"], model["evidence"])).otherwise(rule["evidence"]).alias("evidence"),
        _laid_over(rule["factors"], model["factors"]).alias("factors"),
    )
    return F.when(model.isNull(), rule).otherwise(merged)


def _tags(stage: Column, *more: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(F.coalesce(stage, F.lit(OTHER)), *more)))


def sql_tags(stage: Column, joins: Column, subqueries: Column) -> Column:
    """The stage, and what makes a statement hard; null counts are none."""
    return _tags(stage, F.when(joins >= MANY_JOINS, "many-joins"), F.when(subqueries >= NESTED, "nested-subqueries"))


def code_tags(stage: Column, problem: Column, failing: Column, got: Column, loops: Column, cyclomatic: Column) -> Column:
    """The stage, the kind of problem, and what the failure shows; nulls show nothing."""
    nothing = (got == "None") | F.coalesce(failing, F.lit("")).contains("None")
    return _tags(stage, F.coalesce(F.nullif(problem, F.lit("")), F.lit("general")), F.when(nothing, "returns-none"), F.when((loops >= LOOPS) | (cyclomatic >= PATHS), "high-complexity"))
