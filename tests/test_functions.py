import pytest
from pyspark.sql import functions as F

from millrace.functions import sqltext, text
from millrace.operators import dedup, metrics, records, sampling


def one(spark, made, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(made(F.col("x"))).collect()]


def test_normalize_answer(spark):
    got = one(spark, text.normalize_answer, "x #### The 42.", r"so \boxed{A  cat}", "Long text that goes on and on and on until the answer is An Apple. End", "The  Dog!", None, r"it is \boxed{\frac{1}{2}} I think, and so the answer is no such thing at all", "a\u00a0b\u2003The c")
    assert got == ["42", "cat", "apple", "dog", "", "frac1", "b c"]


def test_choice_keeps_the_one_character_class(spark):
    assert one(spark, text.choice, "Answer: B", "THE ANSWER IS B", "(C)", "none", None) == ["B", "S", "C", None, None]
    assert one(spark, lambda c: text.choice(c, fixed=True), "THE ANSWER IS B", "ANSWER IS: C") == ["B", "C"]


def test_numbers_and_names(spark):
    assert one(spark, text.first_number, "1,000 apples", "-3.5", "none") == [1000.0, -3.5, None]
    assert one(spark, text.safe_name, "a b/c.") == ["a_b_c"]
    assert one(spark, text.truthy, "0", "yes", " OFF ") == [False, True, False]


def test_sql_and_log_text(spark):
    assert one(spark, sqltext.op_type, "with a as (select 1) select 2", " delete from t", "") == ["SELECT", "DELETE", "UNKNOWN"]
    assert one(spark, sqltext.failure_stage, "Operation timed out", "NameError: x", None, "ZeroDivisionError", "no assert here", "nameerror") == ["timeout", "name", "other", "value", "other", "other"]
    assert one(spark, lambda c: sqltext.log_metric(c, "loss"), "{'loss': 0.14, 'epoch': 2.9}", "loss=1e-3 lr: 2e-5", "noise") == [0.14, 1e-3, None]
    assert one(spark, sqltext.intent, "please remove rows", "how many cats", "drop the table", "Set the price", "build table x", None) == ["DELETE", "SELECT", "DELETE", "UPDATE", "DDL", "SELECT"]


@pytest.mark.parametrize("budget", [1, 7, 10, 100])
def test_quotas_add_up(spark, budget):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "f string")
    got = [r.quota for r in sampling.quotas(df, name_col="f", budget=budget).orderBy("f").collect()]
    assert sum(got) == budget and got == sorted(got, reverse=True) and max(got) - min(got) <= 1


def test_decontamination_rules(spark):
    long = "word " * 60
    docs = spark.createDataFrame([(1, long + "tail"), (2, (long * 3)), (3, "Short  TEXT"), (4, None), (5, ""), (6, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(long,), ("short text",), (None,), ("",)], "text string")
    kept = dedup.decontaminate(docs, bench, id_col="doc_id", text_col="text", bench_col="text")
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]


def test_message_validity(spark):
    rows = [(1, 0, "User", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "system", " "), (3, 1, "user", "q"), (3, 2, "assistant", "a"), (4, 0, "user", " "), (4, 1, "assistant", "a")]
    folded = records.fold_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = dict(folded.select("conv_id", records.valid_messages(F.col("messages"))).collect())
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1)], "s double, y int")
    assert metrics.auc(df, score_col="s", label_col="y").first()[0] == 0.75
    assert metrics.auc(df.where("y = 1"), score_col="s", label_col="y").first()[0] is None


def test_validators(spark):
    from millrace.operators import validators

    turns = "array<struct<from: string, value: string>>"
    rows = [([("human", "q"), ("gpt", "a")],), ([("human", "q")],), ([("human", "q"), ("gpt", " ")],), ([("human", "q"), ("gpt", "a"), ("bot", "b")],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"s {turns}")
    assert [r[0] for r in df.select(validators.valid_sharegpt(F.col("s"))).collect()] == [True, False, False, True, False, False]
    assert [r[0] for r in df.select(validators.turn_errors(F.col("s"))).collect()] == [[], [], [], ["turn 2: from is bot"], [], None]
    assert [r[0] for r in spark.createDataFrame([([(None, "a"), ("gpt", None)],)], f"s {turns}").select(validators.turn_errors(F.col("s"))).collect()] == [["turn 0: no from", "turn 1: no value"]]
    chats = df.withColumnRenamed("s", "conversations").withColumns({"instruction": F.lit("i"), "output": F.lit(None).cast("string"), "n": F.monotonically_increasing_id()})
    assert [r[0] for r in chats.orderBy("n").select(validators.sample_errors(chats)).collect()] == [[], [], [], ["turn 2: from is bot"], [], ["no output"]]
    assert sorted(r.message for r in validators.form_report(chats, order="n").collect()) == ["a form that is not supported", "several forms"]
    alpaca = spark.createDataFrame([(1, "a", "b"), (2, None, "b")], "n int, instruction string, output string")
    assert [tuple(r) for r in validators.trainer_report(alpaca.where("n = 1"), id_col="n", order="n").collect()] == []
    assert [r[0] for r in alpaca.orderBy("n").select(validators.sample_errors(alpaca)).collect()] == [[], ["neither conversations nor instruction"]]
    m = spark.createDataFrame([([("system", "s"), ("user", "q"), ("assistant", "a")],), ([("user", "q"), ("assistant", "a")],), ([("system", ""), ("user", "q"), ("assistant", "a")],), ([("system", "s"), ("user", "q"), ("assistant", "a"), ("tool", "t")],), (None,)], "m array<struct<role: string, content: string>>")
    assert [r[0] for r in m.select(validators.valid_rewrite(F.col("m"))).collect()] == [True, False, False, False, False]
    fields = spark.createDataFrame([(1, None), (2, "x")], "id long, a string")
    assert sorted(map(tuple, validators.missing_fields(fields, ("a", "b"), id_col="id").collect())) == [(1, "a"), (1, "b"), (2, "b")]


def test_changes_to_records(spark):
    from millrace.operators import shaping

    kind = "m array<struct<role: string, content: string>>"
    df = spark.createDataFrame([([("User", "q"), ("assistant", "a"), ("assistant", "b")],), ([],), (None,)], kind)
    put = lambda role: [[tuple(x) for x in r[0]] for r in df.select(shaping.upsert_message(F.col("m"), role, F.lit("new"))).collect()]
    assert put("assistant") == [[("User", "q"), ("assistant", "new"), ("assistant", "b")], [("assistant", "new")], [("assistant", "new")]]
    assert put("user")[0] == [("User", "new"), ("assistant", "a"), ("assistant", "b")]
    thought = df.select(shaping.think_first(F.col("m"), F.lit("why"))).first()[0]
    assert [x.content for x in thought] == ["q", "<think>why</think>a", "b"]
    assert df.select(shaping.first_present(df, ("x", "m"), "y").alias("p")).schema["p"].dataType == df.schema["m"].dataType


def test_metrics_by_name(spark):
    from millrace.operators import registry

    df = spark.createDataFrame([("Answer: B", ["(B)"]), ("42", ["42", "43"]), (None, ["x"]), ("no", [" no "])], "p string, r array<string>")
    got = {r.metric: (r.score, r.n) for r in registry.evaluate(df, ("EM", "strict", "choice_accuracy", "acc", "number_rate"), pred="p", refs="r").collect()}
    assert got["strict_match"] == (0.25, 4) and got["choice_accuracy"] == (0.25, 4) and got["accuracy"] == (0.75, 4) and got["extraction_rate"] == (0.25, 4)
    with pytest.raises(KeyError):
        registry.resolve("no such metric")
    rows = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), (None, "a")], "p string, y string")
    assert registry.mcc(rows, pred_col="p", label_col="y").first()[0] == pytest.approx(1.0)
    assert registry.mcc(rows.where("p = 'a'"), pred_col="p", label_col="y").first()[0] == 0.0


def test_statements_with_nested_calls(spark):
    cases = {
        "SELECT lower(a), count(*) FROM t GROUP BY lower(b)": ["lower(a)"],
        "SELECT DISTINCT t.a AS x, sum(coalesce(b, (c + 1))) FROM t GROUP BY a HAVING sum(b) > (SELECT max(d) FROM u)": [],
        "SELECT concat(a, ',', b) x1, max(c) FROM t GROUP BY a, b": ["concat(a, ',', b) x1"],
        "SELECT a FROM t": [],
        "SELECT ((((((((a)))))))), b FROM t GROUP BY b": ["((((((((a))))))))"],
    }
    assert one(spark, sqltext.ungrouped, *cases) == list(cases.values())
