"""Field paths, chunks, diverse retrieval and the store on small cases."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

NESTED = "a string, s struct<b:long,c:string>, xs array<string>, ys array<struct<t:string>>, m map<string,long>, n string"


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame([("v", (1, "z"), ["p", None, "q"], [("t1",), (None,), ("t2",)], {"k": 5}, None), (None, None, None, None, None, None)], NESTED)


@pytest.mark.parametrize(
    ("spec", "want"),
    [("a", ["v"]), ("s.b", ["1"]), ("s", ["b. 1", "c. z"]), ("xs", ["p", "q"]), ("xs[0]", ["p"]), ("xs[9]", []), ("ys[*].t", ["t1", "t2"]), ("ys[all].t", ["t1", "t2"]), ("m[]", ["k. 5"]), ("m[*]", ["k. 5"]), ("m.k", ["5"]), ("n", []), ("zz.y", []), ("s[x", []), ("ys", ["t. t1", "t", "t. t2"])],
)
def test_paths(nested, spec, want):
    from millrace.operators import fieldpath

    got = [r[0] for r in nested.select(fieldpath.values(nested, spec)).collect()]
    assert got == [want, []]


def test_builders(nested):
    from millrace.operators import fieldpath

    assert [r[0] for r in nested.select(fieldpath.joined(nested, ["a", "xs"])).collect()] == ["v\np\nq", None]
    assert tuple(nested.select(fieldpath.meta(nested, {"x": "s.c", "lang": "en"}).alias("m")).first().m) == ("z", "en")
    assert [r.text for r in fieldpath.pretrain(nested, ["a", "xs"]).collect()] == ["v p q"]
    made = fieldpath.instruct(nested, [("user", "a"), ("assistant", ["xs"]), ("tool", "n")]).collect()
    assert [[tuple(m) for m in r.messages] for r in made] == [[("user", "v", False), ("assistant", "p\nq", True)]]


def test_chunks(spark):
    from millrace.operators import retrieval

    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    df = spark.createDataFrame([("u1", text), ("u2", text), ("u3", "short"), ("u4", None), ("u5", "x" * 1500)], "url string, text string")
    got = df.select("url", retrieval.chunks(F.col("text")).alias("c")).collect()
    assert all(len(c) <= 600 for r in got for c in r.c) and [len(r.c) for r in got][2:] == [1, 0, 3]
    at, seen = 0, 0  # in order, without a gap, and overlapping
    for c in got[0].c:
        at = text.index(c, max(0, at - 600))
        assert at <= seen + 1
        seen = at + len(c)
    assert seen == len(text) and got[0].c[1].split()[0] in got[0].c[0]
    kept = retrieval.page_chunks(df, url_col="url", text_col="text").collect()
    assert {r.url for r in kept} == {"u1", "u5"} and len({r.sha for r in kept}) == len(kept)


def test_pages_are_cut_few_at_a_time():
    """Of a batch of many pages only a few are Python objects at once; every chunk comes with its page and place."""
    import pyarrow as pa

    from millrace.operators import retrieval

    pages = [" ".join(f"Page {i} has sentence {n}." for n in range(i % 90)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"u{i}" for i in range(300)]), pa.array(pages)], ["url", "text"])
    got = list(retrieval._cut_pages(iter([batch.slice(0, 7), batch.slice(7)]), 600, 120, rows=8))
    assert len(got) == 1 + 37 and max(len(set(b.column(0).to_pylist())) for b in got) <= 8
    want = [(f"u{i}", len(c), n, x) for i, t in enumerate(pages) for c in [retrieval._packed(t, 600, 120)] for n, x in enumerate(c)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_mmr(spark):
    from millrace.operators import retrieval

    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(80, 6)).astype("float32").tolist() + [[0.0] * 6, None]
    vecs[1] = vecs[0]
    near0, far = [x + 0.2 * (n % 3) for n, x in enumerate(vecs[0])], rng.normal(size=6).tolist()  # a query equal to a row would tie everywhere
    rows = spark.createDataFrame(list(enumerate(vecs)), "id long, v array<float>")
    queries = spark.createDataFrame([(7, near0), (8, far)], "query_id long, query array<float>")
    got = {}
    for r in retrieval.mmr(rows, queries, id_col="id", vec_col="v", k=5, fetch_k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    v = np.array(vecs[:80])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for qid, q in ((7, np.array(near0)), (8, np.array(far))):
        q = q / np.linalg.norm(q)
        pool, chosen = sorted(range(80), key=lambda i: (-round(v[i] @ q, 9), i))[:20], []
        while len(chosen) < 5:
            best = max(pool, key=lambda i: 0.5 * v[i] @ q - 0.5 * max((v[i] @ v[j] for j in chosen), default=0.0))
            chosen.append(best)
            pool.remove(best)
        assert got[qid] == chosen
    assert got[7][1] != 1  # an exact copy comes late


def test_nearest_rows_of_a_task(spark):
    """A task hands on no more than its best rows of a query: equal in value, ties and odd vectors to the best of all."""
    from millrace.operators import retrieval

    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(3000, 5)).astype("float32").tolist()
    vecs[100:200] = [vecs[7]] * 100  # ties
    vecs[5], vecs[6], vecs[8], vecs[9], vecs[10] = None, [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [1.0], [float("nan"), 1.0, 1.0, 1.0, 1.0]
    rows = spark.createDataFrame([(i * 37 % 3000, v) for i, v in enumerate(vecs)], "id long, v array<float>").repartition(3)
    queries = spark.createDataFrame([(1, vecs[7]), (2, rng.normal(size=5).tolist()), (3, [0.0] * 5), (4, None), (5, [2.0])], "query_id int, query array<double>")
    got = retrieval._nearest(rows, queries, "id", "v", "query_id", "query", 40)
    assert max(r["count"] for r in got.groupBy("query_id", F.spark_partition_id()).count().collect()) <= 40 and got.count() <= 3 * 2 * 40 + 1
    q = queries.select("query_id", retrieval.unit(F.col("query")).alias("q"))
    plain = rows.select("id", retrieval.unit(F.col("v")).alias("u")).join(q, F.size("u") == F.size("q")).select("query_id", "id", retrieval._dot(F.col("u"), F.col("q")).alias("relevance"), F.col("u").alias("_v"))
    best = lambda df, n: [r for k in (1, 2, 5) for r in map(repr, df.where(f"query_id = {k} and relevance is not null").orderBy(F.desc("relevance"), "id").limit(n).collect())]
    assert best(got, 40) == best(plain, 40) and len(best(got, 40)) == 81
    assert retrieval._nearest(rows.limit(0), queries, "id", "v", "query_id", "query", 40).count() == 0


def test_context(spark):
    from millrace.operators import retrieval

    df = spark.createDataFrame([(1, 1, "u", "aaa"), (1, 2, "u", "bbb"), (1, 3, "w", "c" * 50)], "query_id long, rank int, url string, chunk string")
    assert retrieval.context(df, limit=40).first().context == "\n--- Source: u ---\naaabbb"


def test_store(spark):
    from millrace.operators import store

    t = lambda m: datetime(2026, 1, 1, 0, m)
    old = spark.createDataFrame([(["u", "a"], "k1", '{"x": {"y": 1}}', t(0), t(0), t(5)), (["u", "b"], "k2", '{"f": true}', t(0), t(0), None)], "ns array<string>, key string, value string, created_at timestamp, updated_at timestamp, expires_at timestamp")
    writes = spark.createDataFrame([(["u", "a"], "k1", '{"x": {"y": 2}}', t(1)), (["u", "b"], "k2", None, t(1)), (["v"], "k3", "{}", t(2))], "ns array<string>, key string, value string, updated_at timestamp")
    now = store.put(old, writes, ttl_minutes=10).cache()
    assert {(r.key, r.value, r.created_at, r.expires_at) for r in now.collect()} == {("k1", '{"x": {"y": 2}}', t(0), t(11)), ("k3", "{}", t(2), t(12))}
    assert [r.key for r in store.search(now, ("u",), filters={"x.y": 2}).collect()] == ["k1"]
    assert [r.key for r in store.search(now, filters={"x.y": None}).collect()] == ["k3"]
    assert [r.key for r in store.search(old, filters={"f": True}).collect()] == ["k2"]
    assert [r.key for r in store.live(old, F.lit(t(6))).collect()] == ["k2"]
    assert sorted(r.n for r in store.namespaces(old, depth=1).collect()) == [2]
    assert [r.key for r in store.get(now, writes).orderBy("key").collect()] == ["k1", "k3"]
    points = spark.createDataFrame([("t", "", "1"), ("t", "", "2"), ("t", "", "3")], "thread_id string, checkpoint_ns string, checkpoint_id string")
    pending = spark.createDataFrame([("t", "", "2", "b", 0, "c", "v"), ("t", "", "2", "a", 1, "c", "w")], "thread_id string, checkpoint_ns string, checkpoint_id string, task_id string, idx int, channel string, value string")
    newest = store.latest_checkpoints(points, before="3", limit=2)
    assert {r.checkpoint_id: [w.task_id for w in r.writes] for r in store.with_writes(newest, pending).collect()} == {"2": ["a", "b"], "1": []}
