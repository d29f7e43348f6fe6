"""Failure reports, statement counts, other forms of chats, summaries: odd and hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import sqltext, web
from millrace.operators import metrics, records, registry, summaries


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_failure_reports(spark):
    null = F.lit(None).cast("string")
    cases = {
        'File "a.py", line 3\nIndentationError: x TypeError': ("syntax", "SyntaxError", "a.py:3", ""),
        "SyntaxError": ("syntax", "SyntaxError", "", ""),
        "ModuleNotFoundError: No module named 'x.y'": ("import", "ImportError", "", "x.y"),
        "ImportError: cannot": ("import", "ImportError", "", ""),
        "AssertionError: a == b \nrest": ("assert", "AssertionError", "", "a == b"),
        "ZeroDivisionError": ("value", "ZeroDivisionError", "", ""), "ZeroDivisionError ValueError": ("value", "ValueError", "", ""),
        'TIMEOUT File "a", line 1': ("timeout", "Timeout", "", ""), "": ("other", "", "", ""), None: ("other", "", "", ""),
    }
    assert [tuple(x) for x in one(spark, lambda c: sqltext.failure_report(null, c, null), *cases)] == list(cases.values())


def test_statement_counts(spark):
    texts = ["SELECT a, COUNT(b), max(c), sum (d) FROM (SELECT 1) JOIN x JOIN y GROUP BY a ORDER BY a LIMIT 3", "", None]
    want = (len(texts[0]), 2, 2, 1, 2, 1, 1, 1)
    assert [tuple(x) for x in one(spark, sqltext.statement_counts, *texts)] == [want, (0,) * 8, (0,) * 8]


def test_sanitized_schemas(spark):
    ddl = "```sql\nCREATE TABLE t(a);\nINSERT  INTO t VALUES (1);\nSELECT 1;\n```"
    answers = ["insert into t values (1)", "```sql\nINSERT INTO t VALUES (1); SELECT 2\n```", "SELECT 1", "", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [tuple(r.x) for r in df.select("i", sqltext.sanitized(F.lit(ddl), F.col("a")).alias("x")).orderBy("i").collect()]
    rest, all_three = "CREATE TABLE t(a);\nSELECT 1;", "CREATE TABLE t(a);\nINSERT  INTO t VALUES (1);\nSELECT 1;"
    assert got == [(rest, True), (rest, True), (all_three, False), (all_three, False), (all_three, False)]
    assert [tuple(x) for x in one(spark, lambda c: sqltext.sanitized(c, F.lit("x")), None, "")] == [("", False)] * 2


def test_imports_before_a_function(spark):
    prompt = F.lit("import re\ndef f():")
    assert one(spark, lambda c: web.with_imports(c, prompt), "def g(): 1", " def g(): 1", "  def g(): 1", "x = 1", None) == ["import re\ndef g(): 1", "import re\ndef g(): 1", "def g(): 1", "x = 1", None]
    assert one(spark, lambda c: web.with_imports(c, F.lit(None).cast("string")), " def g(): 1") == ["def g(): 1"]


def test_triples_and_masks(spark):
    chat = [("system", " "), ("System", " be "), ("user", None), ("USER", " q\n"), ("assistant", "a"), ("user", "r")]
    rows = [(chat, None, None), (chat, " own ", None), (chat, None, "out"), (None, None, None), ([], "", None), ([("user", "q")], None, None)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string, content:string>>, instruction string, output string")
    assert [tuple(r.r) for r in df.select(records.triple(df).alias("r")).collect()] == [("be\nq", "", "a"), ("own", "", ""), ("", "", "out"), ("", "", ""), ("", "", ""), ("q", "", "")]
    assert tuple(df.drop("messages").select(records.triple(df.drop("messages")).alias("r")).collect()[1].r) == ("own", "", "")
    made = [[tuple(x) for x in r.m] for r in df.where("messages is not null").select(records.masked_system(F.slice("messages", 1, 3), "s").alias("m")).collect()]
    assert made[0] == [("system", "s", False), ("System", " be ", None), ("user", None, None)] and made[3] == [("system", "s", False)] and made[4] == [("system", "s", False), ("user", "q", None)]


def test_class_auc(spark):
    rows = [("a", [0.9, 0.1, 0.0]), ("b", [0.2, 0.5, 0.3]), ("c", [0.3, 0.3, 0.4]), ("a", [0.3, 0.4, 0.3]), ("b", [0.4, 0.4, 0.2]), ("c", [0.1, 0.2, 0.7]), (None, [1.0, 0.0, 0.0]), ("a", None), ("a", [1.0])]
    df = spark.createDataFrame(rows, "y string, s array<double>")

    def brute(k):
        whole = [(y, s[k]) for y, s in rows if y and s and len(s) == 3]
        pairs = [(p, n) for y, p in whole for z, n in whole if y == "abc"[k] != z]
        return sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs)

    got = metrics.class_auc(df, scores_col="s", label_col="y", classes=("a", "b", "c")).first().auc
    assert got == pytest.approx(sum(map(brute, range(3))) / 3)
    assert metrics.class_auc(df.where("y = 'a'"), scores_col="s", label_col="y", classes=("a", "b", "c")).first().auc is None


def test_summaries(spark):
    df = spark.createDataFrame([("a", True, "x"), ("a", None, ""), ("b", False, None), (None, None, None)], "k string, ok boolean, v string")
    assert [tuple(r) for r in summaries.top_values(df, "k", n=2).collect()] == [("a", 2), (None, 1)]
    assert tuple(summaries.pass_rates(df, task="k", passed="ok").first()) == (0.25, 0.3333)
    assert {tuple(r) for r in summaries.field_presence(df, ("k", "v", "absent")).collect()} == {("k", 3), ("v", 1), ("absent", 0)}
    assert {tuple(r) for r in summaries.dominant(df, F.col("v"), "k").collect()} == {("a", "x"), ("b", "N/A"), (None, "N/A")}
    assert one(spark, lambda c: summaries.bins(c.cast("int"), (10, 30)), "10", "11", "30", "31", None) == ["<=10", "11-30", "11-30", ">30", None]
    reasons = spark.createDataFrame([("too short: 3",), ("too short: 4",), ("x" * 99,), ("",), (None,)], "r string")
    assert {tuple(r) for r in summaries.drop_reasons(reasons, F.col("r")).collect()} == {("too short", 2), ("x" * 60, 1)}
    runs = spark.createDataFrame([("a", 3, 0.5), ("a", 2, 0.5), ("a", 1, None), ("b", 9, 0.1), ("c", 1, None)], "run string, step int, loss double")
    best = summaries.best_checkpoint(runs, by="run", loss="loss", step="step")
    saved = spark.createDataFrame([("a", 4), ("a", 0), ("a", None), ("c", 1)], "run string, n int")
    assert {tuple(r) for r in summaries.nearest_checkpoint(best, saved, by="run", step="best", number="n").collect()} == {("a", 2, 0.5, 0), ("b", 9, 0.1, None)}
