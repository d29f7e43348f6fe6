"""Validity rules of chat records, trainer checks and counts of what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.records import filled

#: Who may speak in a conversation for training, and in a rewritten one.
SPEAKERS = ("human", "gpt", "system")
ROLES = ("system", "user", "assistant")


def valid_sharegpt(turns: Column) -> Column:
    """Of array<struct<from, value>>: every turn has a speaker and a text, and there are a human and a gpt."""
    who = lambda x: F.lower(F.trim(x["from"]))
    sound = F.forall(turns, lambda x: filled(x["from"]) & filled(x["value"]))
    return F.coalesce((F.size(turns) > 0) & sound & F.exists(turns, lambda x: who(x) == "human") & F.exists(turns, lambda x: who(x) == "gpt"), F.lit(False))


def valid_rewrite(m: Column) -> Column:
    """Of array<struct<role, content>>: only system, user and assistant speak, all three do, and no content is blank."""
    role = lambda x: F.lower(F.trim(x["role"]))
    sound = F.forall(m, lambda x: role(x).isin(*ROLES) & filled(x["content"]))
    all_speak = F.size(F.array_intersect(F.array(*map(F.lit, ROLES)), F.transform(m, role))) == len(ROLES)
    return F.coalesce(all_speak & sound, F.lit(False))


def valid_mapped(target: str, c: Column) -> Column:
    """Whether a record in a target format says anything: one part of an alpaca triple's instruction and output, one message, or the text; a format that is not known says something if it is not null."""
    if target == "alpaca":
        said = filled(c["instruction"]) | filled(c["output"])
    elif target in ("chatml", "openai_fine_tune", "jsonl_sft"):
        said = F.exists(c, lambda x: filled(x["content"]))
    elif target in ("jsonl_pt", "llama2_chat"):
        said = filled(c)
    else:
        said = c.isNotNull()
    return F.coalesce(said, F.lit(False))


def filter_counts(df: DataFrame, valid: Column, *by: str) -> DataFrame:
    """total, valid, invalid of the rows, for each value of ``by``; a null verdict is invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def missing_fields(df: DataFrame, fields: tuple[str, ...], *, id_col: str) -> DataFrame:
    """One row for each required field that a row lacks: the id, field; a field that the table lacks is missing everywhere."""
    lacks = [F.when(F.col(f).isNull() if f in df.columns else F.lit(True), F.lit(f)) for f in fields]
    return df.select(id_col, F.explode(F.array_compact(F.array(*lacks))).alias("field"))


def turn_errors(turns: Column) -> Column:
    """What a trainer rejects in array<struct<from, value>>, with the turn's place from 0; empty if nothing. A null is a missing key, a blank value is none."""
    def told(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("turn "), i.cast("string"), F.lit(": "))
        speaker = F.when(x["from"].isNull(), F.concat(at, F.lit("no from"))).when(~x["from"].isin(*SPEAKERS), F.concat(at, F.lit("from is "), x["from"]))
        return F.array_compact(F.array(speaker, F.when(x["value"].isNull(), F.concat(at, F.lit("no value")))))

    return F.flatten(F.transform(turns, told))


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def sample_form(df: DataFrame) -> Column:
    """``conversation`` where a row has conversations, ``alpaca`` where it has instruction and output, else ``unknown``; null and absent are the same."""
    instructed = _field(df, "instruction").isNotNull() & _field(df, "output").isNotNull()
    return F.when(_field(df, "conversations").isNotNull(), "conversation").when(instructed, "alpaca").otherwise("unknown")


def sample_errors(df: DataFrame) -> Column:
    """What a trainer rejects in a row of either form, array<string>; empty if nothing."""
    text = lambda c: F.when(_field(df, c).isNull(), f"no {c}") if dict(df.dtypes).get(c, "string") == "string" else F.lit(f"{c} is no text")
    instructed = F.array_compact(F.array(text("instruction"), text("output")))
    other = F.when(_field(df, "instruction").isNotNull(), instructed).otherwise(F.array(F.lit("neither conversations nor instruction")))
    if "conversations" not in df.columns:
        return other
    if not dict(df.dtypes)["conversations"].startswith("array<struct"):
        return F.when(F.col("conversations").isNotNull(), F.array(F.lit("conversations is no list of turns"))).otherwise(other)
    return F.when(F.col("conversations").isNotNull(), turn_errors(F.col("conversations"))).otherwise(other)


def form_report(df: DataFrame, *, order: str, first: int = 10) -> DataFrame:
    """level, message: what the forms of the first rows say of the whole: forms that are mixed (a warning), or unknown (an error)."""
    forms = df.select(sample_form(df).alias("form"), F.col(order).alias("_o")).orderBy("_o").limit(first).agg(F.collect_set("form").alias("f"))
    mixed = F.when(F.size("f") > 1, F.struct(F.lit("warning").alias("level"), F.lit("several forms").alias("message")))
    unknown = F.when(F.array_contains("f", "unknown"), F.struct(F.lit("error").alias("level"), F.lit("a form that is not supported").alias("message")))
    return forms.select(F.explode(F.array_compact(F.array(mixed, unknown))).alias("m")).select("m.level", "m.message")


def trainer_report(df: DataFrame, *, id_col: str, order: str) -> DataFrame:
    """level, id (null for the whole), message: the forms' report and one row to each error of each sample."""
    each = df.select(F.lit("error").alias("level"), F.col(id_col).cast("string").alias("id"), F.explode(sample_errors(df)).alias("message"))
    return form_report(df, order=order).select("level", F.lit(None).cast("string").alias("id"), "message").unionByName(each)
