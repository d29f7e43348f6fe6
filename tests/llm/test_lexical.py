"""Ranked lexical search against brute force over every pair."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [
    (None, "a null id with an odd wordling"), (-5, None), (-4, ""), (-3, " .,;\n"), (-2, "wordling " * 30_000), (9005, "same text wordling"), (9006, "same text wordling"),
    (9006, "same text wordling"), (9007, "É É é 😀 A-B a_b"), (9008, "wordling é"),
]
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k=10):
    counted = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    for item, text in set(items):
        scored = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        yield from ((item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1))


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame(ODD, "doc_id long, text string")).withColumns({c: F.lit("1") for c in ("n", "terms", "item", "score", "rank", "_c")}).cache()


def test_search_against_brute_force(spark, docs):
    from millrace.llm.lexical import rank_documents

    real = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    odd = [(None, "wordling"), (900, None), (901, ""), (902, "nothing has xyzzyx"), (903, "same text wordling"), (903, "same text wordling"), (904, "É"), (905, "wordling " * 9000)]
    items = real.union(spark.createDataFrame(odd, "item_id long, text string")).withColumn("w", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
    want = sorted(_brute(rows, asked), key=repr)
    for how in ({}, {"seeds": 40}, {"items_a_pass": 15}):
        got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in rank_documents(docs, items, **how).collect()]
        assert sorted(got, key=repr) == want, how
    found = {r[2] for r in want if r[0] == 904}
    assert 9007 in found and 9008 not in found
    assert rank_documents(docs, items.limit(0)).count() == 0 == rank_documents(docs.limit(0), items).count()


def test_bounds_cover_and_prune():
    """A node's maxima are at least every row's below it; groups of like rows prune most pairs, whole groups at a time."""
    from millrace.llm.lexical import LEAF, Rows, Search, build

    rng = np.random.default_rng(4)
    size, kinds = 600, 30

    def rows(n, seed):
        r = np.random.default_rng(seed)
        kind = r.integers(0, kinds, n)
        terms = np.sort(np.argsort(r.random((n, 20)), axis=1)[:, :8] + 20 * kind[:, None], axis=1)
        return Rows(np.arange(n + 1) * 8, terms.ravel().astype(np.int64), r.integers(1, 1000, 8 * n))

    docs, items = rows(3000, 5), rows(60, 6)
    tree = build(docs, LEAF)
    assert sorted(tree.order.tolist()) == list(range(3000))
    lower = tree.rows
    for level, begin in zip(tree.levels[::-1], tree.children[::-1], strict=True):
        for node in rng.integers(0, len(level), 20):
            dense = np.zeros(size, np.int64)
            at, _ = lower.pick(np.arange(begin[node], begin[node + 1]))
            np.maximum.at(dense, lower.term[at], lower.value[at])
            held = slice(level.start[node], level.start[node + 1])
            assert (dense[level.term[held]] == level.value[held]).all() and (dense > 0).sum() == level.start[node + 1] - level.start[node]
        lower = level
    search = Search(items, np.zeros(60, np.int64), 10, size)
    search.add(docs, np.arange(3000))
    dense = lambda r: np.stack([np.bincount(r.term[r.start[i] : r.start[i + 1]], r.value[r.start[i] : r.start[i + 1]], size) for i in range(len(r))]).astype(np.int64)
    scores = dense(items) @ dense(docs).T
    want = {(i, int(d), int(scores[i, d])) for i in range(60) for d in sorted(range(3000), key=lambda d: (-scores[i, d], d))[:10] if scores[i, d] > 0}
    assert set(search.found()) == want
    assert search.scored < 0.1 * search.pairs and search.bounds < 0.05 * search.pairs
