"""Which columns of problem files hold what, by the names that their first records use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The names of each role's column ("chosenlabel" is one name).
NAMES = {
    "question": ("question", "prompt", "query", "input", "problem", "instruction", "题目", "问题", "输入", "提示"),
    "target": ("target", "answer", "reference", "gold", "gold_answer", "gt", "chosenlabel", "expected", "标准答案", "答案", "参考答案", "标签"),
    "targets": ("targets", "answers", "references", "gold_answers", "候选答案", "参考答案列表"),
    "prediction": ("generated_ans", "prediction", "pred", "response", "output", "model_output", "generated", "预测", "模型输出", "生成答案", "回答"),
    "choices": ("choices", "options", "candidates", "选项", "候选项"),
    "label": ("label", "answer", "target", "correct_option", "正确选项", "标签"),
    "labels": ("labels", "answers", "targets", "正确选项列表", "标签列表"),
    "better": ("better", "preferred", "winner", "更优答案", "偏好", "更好"),
    "answer": ("chosen", "selected", "preferred", "positive", "pos", "human", "good", "helpful", "harmless", "correct", "accepted", "response_chosen", "output_good", "优", "选中", "正样本"),
    "rejected": ("rejected", "unselected", "unpreferred", "loser", "negative", "neg", "machine", "bad", "harmful", "helpless", "incorrect", "ignored", "response_rejected", "output_bad", "差", "拒绝", "负样本"),
    "text": ("text", "content", "essay", "article", "response", "output", "文本", "内容", "文章", "回答"),
}
# The roles of each kind of evaluation. A name has the first role of its kind that lists it.
KINDS = {
    "key1_text_score": ("text",),
    "key2_qa": ("question", "target", "prediction"),
    "key2_q_ma": ("question", "targets", "prediction"),
    "key3_q_choices_a": ("question", "choices", "label"),
    "key3_q_choices_as": ("question", "choices", "labels"),
    "key3_q_a_rejected": ("question", "answer", "rejected", "better"),
}
# The role of what is scored, its column where no column has the role, and the role of what it is held against.
SCORED = {
    "key1_text_score": ("text", "generated_ans", None),
    "key2_qa": ("prediction", "generated_ans", "target"),
    "key2_q_ma": ("prediction", "generated_ans", "targets"),
    "key3_q_choices_a": (None, "eval_pred", "label"),
    "key3_q_choices_as": (None, "eval_pred", "labels"),
    "key3_q_a_rejected": (None, "generated_ans", "better"),
}
FIRST = 2  # records of a file that are looked at


def role_of(name: Column, kind: str) -> Column:
    """The role that a column's name has in this kind of evaluation; null for none. Case counts."""
    return F.coalesce(*[F.when(name.isin(*NAMES[role]), role) for role in KINDS[kind]])


def column_roles(lines: DataFrame, kind: str, *, file: str, order: str, line: str) -> DataFrame:
    """file, roles (map of role to column), pred, ref: of each file of JSON lines, by its first two records.

    Blank and broken lines, and such that are no objects, are passed over; a
    file without a record has no row. Where several names have one role, the
    last of the later record counts. Of each file only the lines that may be
    its first two are shuffled, so one huge file does no harm.
    """
    named = lines.select(F.col(file), F.col(order).alias("_o"), F.when(F.try_parse_json(line).isNotNull(), F.json_object_keys(line)).alias("_keys")).where("_keys is not null")
    first = named.withColumn("_n", F.row_number().over(W.partitionBy(file).orderBy("_o"))).where(F.col("_n") <= FIRST)
    each = first.select(file, "_n", F.posexplode_outer("_keys").alias("_at", "_name")).withColumn("_role", role_of(F.col("_name"), kind))
    best = each.groupBy(file, "_role").agg(F.max_by("_name", F.struct("_n", "_at")).alias("_name"))
    known = F.collect_list(F.when(F.col("_role").isNotNull(), F.struct("_role", "_name")))
    pred, other, ref = SCORED[kind]
    at = lambda role: F.element_at("roles", role) if role else F.lit(None).cast("string")
    return best.groupBy(file).agg(F.map_from_entries(known).alias("roles")).select(file, "roles", F.coalesce(at(pred), F.lit(other)).alias("pred"), at(ref).alias("ref"))
