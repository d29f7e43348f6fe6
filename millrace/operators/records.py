"""Record schemas, validity rules and target formats of chat and plain-text data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Whether a text has a character that is not white space; false for null."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(c, r"\s+", " "))) > 0, F.lit(False))


def fold_messages(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: messages array<struct<role, content>> in the order of turns."""
    m = F.struct(F.col(turn_col).alias("_t"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    ordered = F.transform(F.sort_array(F.collect_list(m)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return turns.groupBy(id_col).agg(ordered.alias("messages"))


def valid_messages(m: Column) -> Column:
    """Roles are filled, contents too but for system, and there is a user and an assistant."""
    role = lambda x: F.lower(F.trim(x["role"]))
    sound = F.forall(m, lambda x: filled(x["role"]) & ((role(x) == "system") | filled(x["content"])))
    return F.coalesce((F.size(m) > 0) & sound & F.exists(m, lambda x: role(x) == "user") & F.exists(m, lambda x: role(x) == "assistant"), F.lit(False))


def first_content(m: Column, role: str) -> Column:
    return F.try_element_at(F.filter(m, lambda x: F.lower(x["role"]) == role), F.lit(1))["content"]


def ensure_system(m: Column, text: str) -> Column:
    """With a filled system message in front."""
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content")))
    first = F.lower(F.try_element_at(m, F.lit(1))["role"])
    rest = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))
    blank = (first == "system") & ~filled(F.try_element_at(m, F.lit(1))["content"])
    return F.when(blank, F.concat(system, rest)).when(first == "system", m).otherwise(F.concat(system, m))


def alpaca(m: Column) -> Column:
    at = lambda r: F.coalesce(F.trim(first_content(m, r)), F.lit(""))
    return F.struct(at("user").alias("instruction"), at("system").alias("input"), at("assistant").alias("output"))


def masked_system(m: Column, text: str) -> Column:
    """``ensure_system`` with a ``loss_mask`` on each message: false on the system message in front, null (none stated) on the rest."""
    none = F.lit(None).cast("boolean")
    return F.transform(ensure_system(m, text), lambda x, i: F.struct(x["role"].alias("role"), x["content"].alias("content"), F.when(i == 0, F.lit(False)).otherwise(none).alias("loss_mask")))


def triple(df: DataFrame, *, messages: str = "messages") -> Column:
    """struct<instruction, input, output>, trimmed, of rows of either form.

    A row with an instruction or an output is taken as it is. Of messages the
    first filled of each role counts, and the system text stands before the
    instruction, on a line of its own. Nulls and absent columns are empty.
    """
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    own = F.struct(*[trimmed(has(c)).alias(c) for c in ("instruction", "input", "output")])
    if messages not in df.columns:
        return own
    said = lambda r: trimmed(F.try_element_at(F.filter(messages, lambda x: (F.lower(x["role"]) == r) & filled(x["content"])), F.lit(1))["content"])
    asked = F.array_join(F.filter(F.array(said("system"), said("user")), lambda x: x != ""), "\n")
    chat = F.struct(asked.alias("instruction"), F.lit("").alias("input"), said("assistant").alias("output"))
    return F.when(has("instruction").isNotNull() | has("output").isNotNull(), own).otherwise(chat)


def chatml(m: Column) -> Column:
    kept = F.filter(m, lambda x: filled(x["content"]))
    return F.transform(kept, lambda x: F.struct(F.when(F.lower(x["role"]) == "tool", "assistant").otherwise(F.lower(x["role"])).alias("role"), x["content"].alias("content")))


def plain_text(m: Column) -> Column:
    kept = F.filter(m, lambda x: filled(x["content"]))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.initcap(F.lower(x["role"])), F.lit(": "), F.trim(x["content"]))), "\n\n")


def sft_turns(m: Column) -> Column:
    kept = F.filter(m, lambda x: filled(x["content"]) & (F.lower(x["role"]) != "system"))
    return F.transform(kept, lambda x: F.struct(F.when(F.lower(x["role"]).isin("assistant", "tool"), "assistant").otherwise("user").alias("role"), x["content"].alias("content")))


def llama2(m: Column) -> Column:
    """One part for each assistant turn, with the user turn before it; the system text leads the first part."""
    system = F.coalesce(F.trim(first_content(m, "system")), F.lit(""))

    def step(a: Column, x: Column) -> Column:
        head = F.when((a["out"] == "") & (system != ""), F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
        part = F.concat(F.lit("<s>[INST] "), head, a["user"], F.lit(" [/INST] "), F.trim(x["content"]), F.lit(" </s>"))
        role = F.lower(x["role"])
        return F.struct(F.when(role == "user", F.trim(x["content"])).otherwise(a["user"]).alias("user"), F.when(role == "assistant", F.concat(a["out"], part)).otherwise(a["out"]).alias("out"))

    return F.aggregate(m, F.struct(F.lit("").alias("user"), F.lit("").alias("out")), step, lambda a: a["out"])


MAPPERS = {"alpaca": alpaca, "chatml": chatml, "openai_fine_tune": chatml, "jsonl_pt": plain_text, "jsonl_sft": sft_turns, "llama2_chat": llama2}
