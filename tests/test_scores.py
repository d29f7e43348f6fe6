"""Scores against plain versions, readers and writers by round trip, logs as a stream."""

import json
import math
import re
from collections import Counter

import pytest

PAIRS = [
    (1, "The cat sat on the mat, quietly.", ["The cat sat on the mat.", "A cat was on the mat, quietly."]),
    (2, "it's 3.5 degrees & <b>cold</b>", ["it is 3.5 degrees and cold"]),
    (3, "a b a b a b a", ["a b a b", "b a b a b a b"]),
    (4, "", ["some words here"]),
    (5, None, [None]),
    (6, "word", [""]),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id long, pred string, refs array<string>")


def _tokens(s):
    from millrace.operators.corpus_metrics import STEPS_13A

    s = f" {s or ''} "
    for pattern, by in STEPS_13A:
        s = re.sub(pattern, by.replace("$", "\\"), s)
    return s.split()


def _grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def test_bleu(spark, pairs):
    from millrace.operators.corpus_metrics import bleu

    hit, tried, mine, ref = [0] * 4, [0] * 4, 0, 0
    for _, p, rs in PAIRS:
        w, us = _tokens(p), [_tokens(r) for r in rs]
        mine, ref = mine + len(w), ref + min((abs(len(u) - len(w)), len(u)) for u in us)[1]
        for n in range(4):
            best = Counter()
            for u in us:
                best |= _grams(u, n + 1)
            hit[n] += sum((_grams(w, n + 1) & best).values())
            tried[n] += max(0, len(w) - n)
    want = math.exp(min(0.0, 1 - ref / mine) + sum(math.log(h / a) for h, a in zip(hit, tried, strict=True)) / 4)
    assert bleu(pairs, id_col="id", pred="pred", refs="refs").first().score == pytest.approx(want)
    assert bleu(pairs.limit(0), id_col="id", pred="pred", refs="refs").first().score == 0.0
    same = spark.createDataFrame([(1, "one two three four five", ["one two three four five"])], "id long, pred string, refs array<string>")
    assert bleu(same, id_col="id", pred="pred", refs="refs").first().score == pytest.approx(1.0)


def test_chrf(pairs):
    from millrace.operators.corpus_metrics import chrf

    def f(stats):
        used = [(h, p, r) for h, p, r in stats if p and r]
        if not used:
            return 0.0
        a, b = sum(h / p for h, p, _ in used) / len(used), sum(h / r for h, _, r in used) / len(used)
        return 5 * a * b / (4 * a + b) if a + b else 0.0

    total = [[0, 0, 0] for _ in range(6)]
    for _, p, rs in PAIRS:
        x, options = re.sub(r"\s", "", p or ""), []
        for r in rs:
            y = re.sub(r"\s", "", r or "")
            options.append([(sum((_grams(x, n) & _grams(y, n)).values()), max(0, len(x) - n + 1), max(0, len(y) - n + 1)) for n in range(1, 7)])
        for n, s in enumerate(max(options, key=f)):
            total[n] = [u + v for u, v in zip(total[n], s, strict=True)]
    assert chrf(pairs, id_col="id", pred="pred", refs="refs").first().score == pytest.approx(f(total))
    assert chrf(pairs.limit(0), id_col="id", pred="pred", refs="refs").first().score == 0.0


def test_token_f1_and_rouge(spark, pairs):
    from millrace.operators.corpus_metrics import rouge_l, token_f1

    got = {r.id: r.score for r in token_f1(pairs, id_col="id", pred="pred", refs="refs").collect()}
    # Without articles: cat sat on mat quietly against cat sat on mat.
    assert got[1] == pytest.approx(2 * 4 / 9) and got[4] == 0.0 and got[5] == 1.0 and got[6] == 0.0
    df = spark.createDataFrame([("a b c d e", "a x c e y"), ("same text", "Same text!"), (None, "x"), ("", "")], "p string, r string")
    assert [r[0] for r in df.select(rouge_l("p", "r")).collect()] == pytest.approx([2 * 3 / 10, 1.0, 0.0, 0.0])


def test_answer_columns(spark):
    from pyspark.sql import functions as F

    from millrace.functions import overlap

    df = spark.createDataFrame([("so #### The Answer!", ["answer"], "A and C"), (None, [None], None), ("", [""], "bd")], "p string, r array<string>, c string")
    got = df.select(overlap.exact_match(F.col("p"), F.col("r")), overlap.multi_choice(F.col("c")), overlap.format_compliance(F.col("p"), F.lit("The")), overlap.keyword_recall(F.col("p"), F.col("r"))).collect()
    assert [r[0] for r in got] == [True, False, True]
    assert [r[1] for r in got] == [["A", "C"], [], ["B", "D"]]
    assert got[0][2] == pytest.approx(3 / 19) and got[1][2] == 0.0
    assert got[0][3] == 1.0 and got[1][3] is None


def test_files(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "p"}\n\n{"x": 2\n{"x": 3, "y": null}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.x for r in good.collect()) == [1, 3] and [r.line for r in bad.collect()] == ['{"x": 2']
    (tmp_path / "b.json").write_text(json.dumps({"meta": 1, "records": [{"v": 1}, {"v": 2}]}))
    assert sorted(r.v for r in files.read_records(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    (tmp_path / "c.tsv").write_text("k\tw\n1\tone\n2\ttwo\n")
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "c.tsv")).collect()] == [(1, "one"), (2, "two")]
    files.write_jsonl(spark.range(25), str(tmp_path / "out"), rows_per_file=10)
    assert spark.read.json(str(tmp_path / "out")).count() == 25 and len(list((tmp_path / "out").glob("part-*"))) >= 3
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.file_catalog(spark, str(tmp_path)).collect()}
    assert kinds["a.jsonl"] == "data" and files.kind_of("x/y.jsonl.gz") == "jsonl"


def test_log_stream(spark, tmp_path):
    from millrace.streaming import logs

    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "1.log").write_text("{'loss': 0.5, 'step': 10}\nnothing to see\n")
    for n in (1, 2):
        logs.append_metrics(logs.follow(spark, str(inbox)), out, str(tmp_path / "ck")).awaitTermination(60)
        assert spark.read.parquet(out).count() == n
        (inbox / "2.log").write_text("{'loss': 0.25, 'step': 20}\n")
    last = logs.latest(spark.read.parquet(out)).first()
    assert last.loss == 0.25 and last.step == 20 and last.total == 2 and last.epoch is None


def test_grams_are_not_shuffled(spark, tmp_path):
    """Only counts of a sample's n-grams are shuffled, whatever their number."""
    from millrace.operators.corpus_metrics import bleu, token_f1

    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, [text + " x", None]), (2, None, None)], "id long, pred string, refs array<string>")
    for score in (bleu, token_f1):
        plan = score(df, id_col="id", pred="pred", refs="refs")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(transform" not in plan and "MapInArrow" in plan
    assert bleu(df, id_col="id", pred="pred", refs="refs").first().score > 0.9
    assert {r.id: r.score for r in token_f1(df, id_col="id", pred="pred", refs="refs").collect()} == {1: pytest.approx(100 / 101), 2: 0.0}
