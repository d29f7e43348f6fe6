"""Odd cases of evaluation results and programming problems."""

from pyspark.sql import functions as F

from millrace.functions import ddl as schemas
from millrace.functions import problems, sqltext
from millrace.operators import reports


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_problems(spark):
    assert one(spark, problems.problem_type, "Reverse a List of strings", "a bst", "Sorted", "x", "", None) == ["string", "tree", "sorting", "general", "general", "general"]
    got = one(spark, problems.io_difference, "AssertionError: assert f(None) == 3", "E  assert a == b == c\nE  +  where z = 9", "fine", None)
    assert [tuple(r) for r in got] == [("f(None)", "3", "None"), ("a == b", "c", "9"), (None, None, None), (None, None, None)]
    assert one(spark, problems.entry_point, "x = 1\ndef  go (a):", "class A", None) == ["go", "", ""]
    assert one(spark, lambda c: problems.checks(c, F.lit("g")), "assert candidate(1) \n\nassert  x", "no", "", None) == [["assert g(1)", "assert  x"], [], [], []]
    assert one(spark, problems.url_lines, "URL: a\nURL:a\r\nurl: b\n URL: c\nURL:  ", "", None) == [["a"], [], []]


def test_schema_names_and_evidence(spark):
    ddl = 'create table Zoo (\r\n  "first name" TEXT,\n  b INT,\n  FOREIGN KEY (b)\n);\nCREATE TABLE "a" (\n  b INT\n);'
    got = one(spark, schemas.schema_names, ddl, "", None)
    assert [tuple(r) for r in got] == [(["Zoo", "a"], ["b", "first_name"]), ([], []), ([], [])]
    assert one(spark, lambda c: sqltext.evidence(c, F.lit(""), F.lit("")), "last 3 YEARS", "x", None) == ["Evidence: Current year is 2023, so last 3 years means [2023-3+1, 2023].", "", ""]


def test_reports(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 5, "c")], "k int, o int, v string")
    assert sorted(map(str, reports.last_wins(rows, key="k", order="o").collect())) == ["Row(k=1, o=2, v=None)", "Row(k=None, o=5, v='c')"]
    same = lambda a, b: reports.same_rows(a, b).first()[0]
    assert same(rows, rows.union(rows)) and not same(rows, rows.limit(1)) and same(rows.limit(0), rows.limit(0)) and not same(rows.limit(0), rows)
    assert reports.failure_patterns(rows.withColumn("s", F.lit(1.0)), score="s", kind=None, metric="m").count() == 0
    right = rows.select("k", F.col("o").alias("p"))
    assert [tuple(r) for r in reports.join_by_ordinal(rows.drop("v"), right.where("p <> 1"), task="k", left_order="o", right_order="p").collect()] == [(1, 0, 1, 2)]
    assert tuple(reports.merge_results(rows, success=F.col("v") == "a", records="o", error=F.col("v")).first()) == (1, 1, 2)
    assert tuple(reports.merge_results(rows.limit(0), success=F.col("v") == "a", records="o", error=F.col("v")).first()) == (0, 0, 0)
    names = spark.createDataFrame([("GSM8K-Test",), ("gsm8kx",), ("",), (None,)], "n string")
    assert [r.key for r in reports.longest_key(names, ("gsm8k", "GSM8K test"), name="n").collect()] == ["GSM8K test", None, None, None]
    assert reports.find_benches(spark.createDataFrame([("a", ["x"], None, 1)], "n string, al array<string>, tg array<string>, p int"), (), (), name="n", aliases="al", tag_col="tg", place="p").count() == 0
