"""Answers, web text, SQL and code text on small cases."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers, sqltext, web


def one(spark, made, *values):
    rows = [(v if isinstance(v, tuple) else (v, None)) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(made(F.col("x"))).collect()]


def test_numbers(spark):
    got = one(spark, answers.number, "it is 1/2", "about 50% of", "x = -3.5e2", "none", "1,000 #### 42", r"3 \boxed{7} and \boxed{8}", "1/0", None, "")
    assert got == [0.5, 0.5, -350.0, None, 42.0, 8.0, 1.0, None, None]
    assert one(spark, answers.finite, " 1.5", "inf", "nan", "x", None) == [1.5, None, None, None, None]


def test_final_answers(spark):
    got = one(spark, answers.final_answer, r"The final answer is $\frac{1}{2}$. I hope it is correct.", r"so \boxed{\frac{5}{b+1}} .", "The answer is 12 cm.", "first 3 then 1,204", "no number", None)
    assert got == [r"\frac{1}{2}", r"\frac{5}{b+1}", "12 ", "1204", "", ""]
    assert one(spark, answers.strip_math, r"x=\dfrac{1}{2}", r"90^\circ", r"\text{yes}", "5 kg", "50\\%") == [r"\frac{1}{2}", "90", "yes", "5 ", "50\\"]
    assert one(spark, answers.strip_math, r"\frac{a}{b}") == [r"\frac{}{b}"]  # a lone letter a counts as a unit
    assert one(spark, answers.fix_fractions, r"\frac12", r"\frac1{2}", r"\frac{1}{2}", "1") == [r"\frac{1}{2}"] * 3 + ["1"]
    assert one(spark, answers.fix_roots, r"\sqrt3") == [r"\sqrt{3}"]


def test_matches(spark):
    assert one(spark, lambda c: answers.contains_match(c, F.lit("H2O")), "It is H₂O!", "h2o.", "water", "", None) == [True, True, False, False, False]
    assert one(spark, lambda c: answers.number_match(c, F.lit("0.5")), "1/2", "The answer is 0.5", "half", None) == [False, True, False, False]
    assert one(spark, lambda c: answers.option_set(c, F.lit(4)), "A, C", "0 3", "1, 4", "Z", None, '["b", 4, "1", true]', "[b") == [[0, 2], [0, 3], [1, 3], [], [], [1, 3], [1]]
    assert one(spark, answers.loose, "Stra\u00dfe\u3000 \uff12\uff01", "x\u2082 is \ufb01ne.", "A  B??", None) == ["strasse 2", "x2 is fine", "a b?", ""]


def test_markdown(spark):
    text = "see [a](https://x.org/a) [b](#top) https://y.org/b [a](https://x.org/a)\n```python\nprint('a long enough line')\n```\n```\nshort\n```\n"
    assert one(spark, web.links, text) == [["https://x.org/a", "https://y.org/b"]]
    assert [tuple(b) for b in one(spark, web.code_blocks, text)[0]] == [("python", "print('a long enough line')")]
    assert [b.code for b in one(spark, web.code_blocks, "text\n    x = 'indented code line'\n    y = 1\nend")[0]] == ["x = 'indented code line'\ny = 1"]
    assert one(spark, web.last_python, text, "none", None) == ["print('a long enough line')\n", None, None]
    page = one(spark, web.reader_page, "Title: T\nURL Source: https://x.org\nWarning: slow\nMarkdown Content:\n# Body\nTitle: in text", "plain", None)
    assert tuple(page[0]) == ("T", "https://x.org", "slow", "# Body\nTitle: in text") and tuple(page[1]) == (None, None, None, "plain") and page[2].content is None


def test_urls(spark):
    assert one(spark, lambda c: web.blocked(c, ("bad.com",)), "https://sub.BAD.com/x", "https://good.org/bad.com", None) == [True, False, False]
    assert one(spark, web.download, "https://x.org/a.csv", "https://x.org/a.zip?x=1", "https://x.org/issues/1.csv", "https://x.org/a", None) == [True, True, False, False, False]
    base = "https://x.org/d/e/page.html?q=1#f"
    relative = ["a.html", "/b", "../c", "./d?x=../y", "//z.org/e", "https://k.org/f", "?n=2", "../../../g", ".."]
    assert one(spark, lambda c: web.absolute(F.lit(base), c), *relative) == [urljoin(base, r) for r in relative]


def test_json_in_text(spark):
    got = one(spark, web.json_in, '```json\n{"a": 1}\n```', 'Sure: {"b": [1, 2]} done', "list [1, 2] here", "{broken", None)
    assert got == ['{"a":1}', '{"b":[1,2]}', "[1,2]", None, None]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a, SUM(b) FROM t GROUP BY a", []),
        ("SELECT a, b, COUNT(*) FROM t GROUP BY a", ["b"]),
        ("SELECT t.a AS x, max(coalesce(b, c)) FROM t GROUP BY a HAVING count(*) > 1", []),
        ("SELECT a FROM t", []),
        (None, []),
    ],
)
def test_strict_grouping(spark, sql, want):
    assert one(spark, sqltext.ungrouped, sql) == [want]


def test_sql_and_code(spark):
    ddl = "CREATE TABLE t(a INT); SELECT sum(a)  FROM t; create table if not exists U(b INT)"
    assert one(spark, sqltext.tables, ddl) == [["t", "u"]]
    assert one(spark, lambda c: sqltext.leak_free(c, F.lit("select sum(a) from t;")), ddl) == [["CREATE TABLE t(a INT)", "create table if not exists U(b INT)"]]
    assert one(spark, lambda c: sqltext.suspicious_numbers(c, F.lit("over 30")), "SELECT 1 WHERE a > 30 AND y = 2023") == [["2023"]]
    assert one(spark, sqltext.sql_failure_stage, 'near "x"', "no such table: t", "type mismatch", "prototype", None) == ["sql_syntax", "sql_schema", "sql_type", "other", "other"]
    stats = one(spark, sqltext.code_statistics, "def f(x):\n    for i in x:\n        if i:\n            return i")[0]
    assert (stats.lines, stats.defs, stats.loops, stats.branches, stats.cyclomatic) == (4, 1, 1, 1, 3)
    bar = one(spark, sqltext.progress, r"30%| 101/339 [01:48<21:21,  5.39s/it]", "noise")
    assert tuple(bar[0]) == (101, 339, 29.79) and bar[1] is None
