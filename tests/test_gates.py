"""Verdicts, gates, picks, paths of files, metrics of data sets and scores of generated texts, on odd and hand-made rows."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import verdicts
from millrace.operators import registry, reports, sampling, selections, text_scores, validators
from millrace.sources import routing


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_mapping_verdicts(spark):
    cases = {
        '{"accept": true, "record": {}}': "accept", '{"record": {"a": [1]}}': "accept", '{"accept": "false", "record": {"a": 1}}': "accept",
        '{"accept": false, "record": {}}': "reject", '{"accept": true, "reject_mapping": true, "record": {}}': "reject",
        '{"accept": true, "record": [1]}': "parse_error", '{"accept": true}': "parse_error", "{": "parse_error", "[]": "parse_error", "": "parse_error", None: "parse_error",
    }
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", verdicts.mapping_verdict(F.col("a")).alias("v")).collect()
    assert {r.a: r.v for r in got} == cases


def test_alignment_constraints(spark):
    rows = [("use LIMIT", ["a", "b"], "One. Two\n . ", "evidence: x. Other. EVIDENCE y"), (None, None, None, None), ("", [], "", "no such")]
    df = spark.createDataFrame(rows, "h string, m array<string>, g string, p string")
    got = [tuple(r.x) for r in df.select(verdicts.alignment_constraints(*map(F.col, "hmgp")).alias("x")).collect()]
    assert got == [(["use LIMIT", "a", "b"], ["One", "Two", "evidence: x", "EVIDENCE y"], True), ([], [], False), ([], [], False)]


def test_merged_verdicts(spark):
    rule = ("syntax", "read it", ["r"], {"a": "1", "b": "2"}, {"n": "1"})
    sure = ("type", None, ["m", "r"], {"b": "3", "c": None}, None)
    unsure = ("other", "", ["m", "r", "m"], {"b": "3"}, {"n": "2", "k": "3"})
    strange = ("weather", "new", None, None, {"n": None})
    df = spark.createDataFrame([(0, rule, sure), (1, rule, unsure), (2, rule, strange), (3, rule, None)], f"n int, rule {verdicts.VERDICT}, model {verdicts.VERDICT}")
    got = {r.n: tuple(r.x) for r in df.select("n", verdicts.merged_verdict(F.col("rule"), F.col("model"), ("syntax", "type", "other")).alias("x")).collect()}
    assert got[0] == ("type", "read it", ["m", "r"], {"a": "1", "b": "3", "c": None}, {"n": "1"})
    assert got[1] == ("syntax", "read it", ["r", "m"], {"a": "1", "b": "2"}, {"n": "2", "k": "3"})
    assert got[2] == ("syntax", "new", ["r"], {"a": "1", "b": "2"}, {"n": "1"})
    assert got[3] == rule


def test_tags(spark):
    none = F.lit(None)
    got = one(
        spark,
        verdicts.sql_tags(F.lit("sql_type"), F.lit(3), F.lit(2)).alias("a"), verdicts.sql_tags(none.cast("string"), none.cast("int"), F.lit(1)).alias("b"),
        verdicts.code_tags(F.lit("type"), F.lit("graph"), F.lit("f(None)"), F.lit("3"), F.lit(4), F.lit(1)).alias("c"),
        verdicts.code_tags(none.cast("string"), F.lit(""), none.cast("string"), F.lit("None"), F.lit(3), F.lit(5)).alias("d"),
    )
    assert list(got) == [["sql_type", "many-joins", "nested-subqueries"], ["other"], ["type", "graph", "returns-none", "high-complexity"], ["other", "general", "returns-none"]]


def test_gates(spark):
    rows = [(1, [("user", "x")], 0.2), (2, [], 0.9), (3, [("user", "x")], None), (4, None, 0.9), (5, [("user", "x")], 0.5), (6, [("user", "x")], 0.9)]
    df = spark.createDataFrame(rows, "id int, m array<struct<role:string, content:string>>, s double")
    ids = lambda score: [r.id for r in selections.relevant(df, messages="m", score=score, least=0.5, order="id", n=2).collect()]
    assert ids("s") == [3, 5] and ids(None) == ids("absent") == [1, 3]
    langs = spark.createDataFrame([(True, "Python"), (False, "go"), (True, "cobol"), (None, "c"), (True, None)], "code boolean, lang string")
    assert [r.x for r in langs.select(selections.checkable(F.col("code"), F.col("lang")).alias("x")).collect()] == [True, False, False, False, False]
    gate = spark.createDataFrame([(True, False, True), (True, True, True), (True, None, True), (None, False, True), (True, False, False), (True, False, None)], "r boolean, b boolean, s boolean")
    assert [r.x for r in gate.select(selections.exportable(F.col("r"), F.col("b"), F.col("s")).alias("x")).collect()] == [True, False, False, False, False, False]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("b", 2)], "k string, at int")
    assert [(r.k, r["at"], r["rank"]) for r in selections.latest(df, order="at", n=2).orderBy("rank").collect()] == [("a", 3, 1), ("b", 2, 2)]
    assert sorted((r.k, r["at"]) for r in selections.latest(df, order="at", by="k").collect()) == [("a", 3), ("b", 2)]
    assert selections.latest(df.limit(0), order="at").count() == 0


def test_case_samples(spark):
    rows = [(1, " yes ", ["yes"]), (2, "say yes", ["yes", None]), (3, "no", ["yes", ""]), (4, None, ["a"]), (5, "x", None), (6, "", [" "])]
    df = spark.createDataFrame(rows, "id int, p string, r array<string>")
    ids = lambda **o: sorted(r.id for r in selections.case_samples(df, pred="p", refs="r", id_col="id", **o).collect())
    assert ids(group="positive") == [1, 2, 6] and ids() == ids(group="other") == [3, 4, 5] and ids(group="mixed", n=9) == [1, 2, 3, 4, 5, 6]
    assert len(ids(group="mixed", n=2)) == 2 and ids(group="mixed", n=2) == ids(group="mixed", n=2)


def test_case_samples_of_turns_with_blanks(spark, tmp_path):
    """The query against its SQL where the next turn's first characters end in a blank, begin with one, are blank or are missing."""
    import duckdb

    from millrace.plans import catalog, gates  # noqa: F401  (it adds to the catalog)

    turns = ["it is in", "in the end", " a b", "a b", "   ", "x", "", "y", None, "z", "as a", "is so", "Is it so", "it"]
    rows = [(c, n, "user", s) for c in range(3) for n, s in enumerate(turns[c:])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["case_samples"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["case_samples"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 20


def test_samples_with_problems_and_rates(spark):
    samples = spark.createDataFrame([("t", 2), ("t", 1), ("u", 1), (None, 1)], "task string, n int")
    placed, unknown = selections.with_problems(samples, spark.createDataFrame([("t", "p")], "task string, prompt string"), task="task", order="n")
    assert sorted((r.n, r.prompt, r.completion_id) for r in placed.collect()) == [(1, "p", 0), (2, "p", 1)] and unknown.count() == 2
    df = spark.createDataFrame([("f", "1", "2"), (None, None, None), ("", "", ""), ("f", None, None), (None, "1", "")], "f string, e string, g string")
    assert tuple(selections.parse_rates(df, failing="f", expected="e", got="g").first()) == (3, 3, 1, 0.3333)
    assert tuple(selections.parse_rates(df.limit(0), failing="f", expected="e", got="g").first()) == (0, 0, 0, 0.0)
    info = spark.createDataFrame([("a", i, i) for i in range(12)] + [(None, 1, None)], "k string, n int, l int")
    assert sorted(map(tuple, selections.dataset_info(info, length=F.col("l"), order="n", by="k").collect()), key=str) == [("a", 12, 4), (None, 1, 0)]


def test_paths(spark):
    paths = ["/b/x.jsonl", "/b/s/t/y.tar.csv", "/b/.git/z.json", "/b/s/.hid.json", "/b/state.json", "/b/a.py", "/c/x.json", "/b/node_modules/k.txt", "/b/UP.JSON", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.name for r in routing.benchmark_sources(df, "/b/").collect()} == {"/b/x.jsonl": "x", "/b/s/t/y.tar.csv": "s__t__y.tar", "/b/UP.JSON": "UP"}
    places = spark.createDataFrame([(p,) for p in ("/r/hf/d/a.json", "/r/hf/d/e/b.md", "/r/hf/a.json", "/r/other/d/a.json", "/q/hf/d/a.json")], "path string")
    assert [(r.origin, r.dataset) for r in routing.routed(places, "/r", ("hf", "web")).collect()] == [("hf", "d")] * 2
    stems = spark.createDataFrame([(p,) for p in ("a_part_001.jsonl", "a_part_1.jsonl", "a_part_001.csv", ".x", "n", "/d.e/f", "b_part_002.JSONL")], "p string")
    assert [r.s for r in stems.select(routing.logical_stem(F.col("p")).alias("s")).collect()] == ["a", "a_part_1", "a_part_001", ".x", "n", "f", "b"]


def test_evaluation_inputs_and_registry(spark):
    rows = [("r", "/r/records.json"), ("r", "/r/pred.jsonl"), ("r", "/r/gt.json"), ("s", "/s/pred.json"), ("s", "/s/predict.json"), ("s", "/s/labels.json"), ("p", "/p/pred.json"), ("n", "/n/x")]
    got = {r.b: tuple(r)[1:] for r in routing.eval_inputs(spark.createDataFrame(rows, "b string, path string"), by="b").collect()}
    assert got == {"r": ("records", "/r/records.json", None, None), "s": ("split", None, "/s/predict.json", "/s/labels.json"), "p": ("records", None, None, None), "n": ("records", None, None, None)}
    known = spark.createDataFrame([("a", "/1/a.json"), ("b", "/1/b.json"), ("c", "/1/c.json")], "name string, path string")
    new = spark.createDataFrame([("/1/b.json", 1), ("/2/c.json", 1), ("/3/c.json", 2), ("/3/d.json", 1)], "path string, n int")
    assert {tuple(r) for r in routing.registered(known, new, order="n").collect()} == {("a", "/1/a.json", "kept"), ("b", "/1/b.json", "kept"), ("c", "/3/c.json", "replaced"), ("d", "/3/d.json", "added")}
    benches = spark.createDataFrame([("Math", 1)], "name string, n int")
    now, refused = reports.add_benches(benches, spark.createDataFrame([("MATH", 2), ("Code", 3), ("code", 4), ("", 5), (None, 6)], "name string, n int"), name="name", order="n")
    assert sorted(map(tuple, now.collect())) == [("Code", 3), ("Math", 1)] and sorted(r.n for r in refused.collect()) == [2, 4, 5, 6]


def test_nested_quotas(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3")], "g string, f string")
    for budget in (0, 1, 10, 17):
        got = {(r.g, r.f): r.quota for r in sampling.nested_quotas(df, group_col="g", name_col="f", budget=budget).collect()}
        per = {g: budget // 3 + (i < budget % 3) for i, g in enumerate("abc")}
        n = {"a": 2, "b": 1, "c": 3}
        assert got == {(g, str(i + 1)): per[g] // n[g] + (i < per[g] % n[g]) for g in "abc" for i in range(n[g])} and sum(got.values()) == budget


def test_metrics_of_data_sets(spark):
    before = dict(registry.DATASETS)
    try:
        registry.register_dataset(" One ", ("em",))
        with pytest.raises(KeyError):
            registry.register_dataset("two", ("nothing",))
        df = spark.createDataFrame([("ONE", "a", ["a"]), ("one ", "b", ["a"]), ("other", "a", ["a"]), (None, "a", ["a"])], "d string, p string, r array<string>")
        assert [tuple(r) for r in registry.evaluate_datasets(df, dataset="d", pred="p", refs="r").collect()] == [("one", "exact_match", 0.5, 2)]
        both = registry.evaluate_datasets(df, dataset="d", pred="p", refs="r", default=("strict",)).collect()
        assert sorted(map(tuple, both)) == [("one", "exact_match", 0.5, 2), ("other", "strict_match", 1.0, 1)]
    finally:
        registry.DATASETS.clear()
        registry.DATASETS.update(before)


def test_mapped_records(spark):
    df = spark.createDataFrame([(("", " ", "x"), [("user", None), ("assistant", "y")], "t"), (("", "in", "\n"), [("user", " ")], " "), (None, None, None)], "a struct<instruction:string, input:string, output:string>, m array<struct<role:string, content:string>>, t string")
    got = df.select(*[validators.valid_mapped(k, F.col(c)).alias(k) for k, c in (("alpaca", "a"), ("chatml", "m"), ("jsonl_sft", "m"), ("jsonl_pt", "t"), ("custom", "t"))]).collect()
    assert [tuple(r) for r in got] == [(True,) * 5, (False, False, False, False, True), (False,) * 5]


def brute_scores(pred, ref):
    def grams(w, n):
        return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    words = lambda x: "".join(f" {c} " if "一" <= c <= "鿿" else c for c in x or "").split()
    p, r = words(pred), words(ref)
    low = words("".join(c for c in (pred or "").lower() if c.isalnum() or c == "_" or c.isspace()))
    parts = [(sum((grams(p, n) & grams(r, n)).values()), max(len(p) - n + 1, 0)) for n in range(1, 5)]
    bleu = 0.0 if any(hit == 0 for hit, _ in parts) else math.exp(sum(math.log(h / a) for h, a in parts) / 4) * (math.exp(1 - len(r) / len(p)) if len(p) < len(r) else 1)
    runs = [tuple(low[i : i + 5]) for i in range(len(low) - 4)]
    lex, ngram = len(set(p)) / len(p) if p else 0.0, len(set(runs)) / len(runs) if runs else 0.0
    return bleu, lex, ngram, 0.4 * bleu + 0.3 * lex + 0.3 * ngram


def test_scores_of_generated_texts(spark):
    long = "the cat sat on the mat and the cat sat on the mat again"
    rows = [(long, "the cat sat on the mat"), ("the cat sat on", long), ("我们 走 吧 朋友们", "我们走吧朋友"), ("", "x"), (None, None), ("a b", "a b"), ("Hi, hi! hi hi hi hi.", "hi"), (long, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, p string, r string")
    scores = text_scores.sample_scores(df, id_col="id", pred="p", ref="r")
    got = {r.id: tuple(r)[1:] for r in scores.collect()}
    want = [brute_scores(*r) for r in rows]
    assert all(got[i] == pytest.approx(want[i], abs=6e-5) for i in range(len(rows))) and len(got) == len(rows)
    mean = text_scores.average_scores(scores).first()
    assert mean.samples == len(rows) and mean.overall == pytest.approx(sum(w[3] for w in want) / len(rows), abs=1e-4)
    assert tuple(text_scores.average_scores(scores.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
