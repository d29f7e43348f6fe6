"""Cleaning chains: counts, empty steps, and what runs again after a break."""

import glob

import pytest
from pyspark.sql import functions as F

from millrace.operators import chain


@pytest.fixture
def docs(spark):
    rows = [(1, "One  text"), (2, ""), (3, None), (4, "one text"), (5, "a long enough text"), (6, " \n"), (6, "x")]
    return spark.createDataFrame(rows, "doc_id int, text string").repartition(3)


def _counts(done):
    return [(c.step, c.total, c.valid, c.error, c.filtered, c.kept_input) for c in done]


def test_counts_of_a_named_chain(spark, docs, tmp_path):
    steps = [(n, chain.REGISTRY[n]()) for n in ("filled", "distinct")] + [("four", chain.REGISTRY["least_length"](least=4)), ("none", chain.REGISTRY["least_length"](least=99)), ("collapse", chain.REGISTRY["collapse"]())]
    df, done = chain.run(docs, steps, home=str(tmp_path / "a"))
    assert _counts(done) == [("filled", 7, 4, 0, 3, False), ("distinct", 4, 3, 0, 1, False), ("four", 3, 2, 0, 1, False), ("none", 2, 0, 0, 2, True), ("collapse", 2, 2, 0, 0, False)]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "One text"), (5, "a long enough text")]
    assert [r.valid for r in chain.report(spark, done).orderBy("place").collect()] == [4, 3, 2, 0, 2]
    df, done = chain.run(docs.limit(0), steps[:2], home=str(tmp_path / "b"))
    assert _counts(done) == [("filled", 0, 0, 0, 0, True), ("distinct", 0, 0, 0, 0, True)] and df.count() == 0


def test_broken_lines_are_errors(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{no",), ("[1]",), ("  ",), ('{"b": "y"}',)], "line string")
    df, done = chain.run(lines, [("read", chain.REGISTRY["lines"]("a int, b string")), ("a", chain.rows(keep=F.col("a") > 0))], home=str(tmp_path / "c"))
    assert [tuple(r) for r in df.collect()] == [(1, "x")]
    assert _counts(done)[1] == ("a", 2, 1, 0, 1, False) and done[0].error == 2 and done[0].valid == 2


def test_only_missing_steps_run_again(spark, docs, tmp_path):
    ran, broken = [], [True]

    def noted(name, step):
        def f(df):
            ran.append(name)
            if name == "third" and broken[0]:
                raise RuntimeError("stop")
            return step(df)

        return name, f

    def steps():
        return [noted("first", chain.REGISTRY["filled"]()), noted("second", chain.REGISTRY["collapse"]()), noted("third", chain.REGISTRY["distinct"]()), noted("fourth", chain.rows(keep=F.col("doc_id") > 1))]

    home = str(tmp_path / "d")
    with pytest.raises(RuntimeError):
        chain.run(docs, steps(), home=home)
    assert ran == ["first", "second", "third"]
    ran.clear()
    broken[0] = False
    df, done = chain.run(docs.repartition(1), steps(), home=home)  # the same rows in another order
    assert ran == ["third", "fourth"] and [c.valid for c in done] == [4, 4, 3, 2]
    want = sorted(map(str, df.collect()))
    ran.clear()
    again, told = chain.run(docs, steps(), home=home)
    assert ran == [] and told == done and sorted(map(str, again.collect())) == want
    chain.run(docs, [*steps()[:3], noted("other", chain.rows())], home=home)
    assert ran == ["other"]
    ran.clear()
    chain.run(docs.where("doc_id <> 5"), steps(), home=home)  # another input: the old folder is set aside
    assert ran == ["first", "second", "third", "fourth"] and len(glob.glob(home + "-aside-*")) == 1
    ran.clear()
    (tmp_path / "d" / "001-second" / "_SUCCESS").unlink()  # a table that was not finished
    chain.run(docs.where("doc_id <> 5"), steps(), home=home)
    assert ran == ["second", "third", "fourth"]
