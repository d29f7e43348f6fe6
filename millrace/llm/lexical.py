"""Exact ranked lexical search of many items at once, by a dual tree.

Both sides have a hierarchy, over items and over documents, whose nodes hold
the greatest value of every coordinate (term) below them. The sum over terms
of the two maxima bounds each score of the node pair, so the pair is dropped
where that bound is below the weakest k-th score of its items so far: a whole
batch of items against a whole block of documents at a time. What is left at
the leaves is scored in integers.

Documents become sparse vectors over the items' terms in one pass; whole
texts and other terms go no further than that. Vectors are sorted over the
cluster by their two heaviest terms, so that those that score well together
share a block, and every task searches its blocks with all items, starting
from the k-th scores that a bounded sample of documents reached. A task's
k best to each item are merged by a window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.util import batches, written

#: A term is a maximal run of ASCII letters, which are lower-cased, digits, and characters beyond ASCII: all else becomes a space.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Items searched for in one pass over the documents; so their terms, which every task gets, are bounded too.
ITEMS = 20_000
#: Documents in a block and in a leaf, and items in a leaf.
BLOCK, LEAF, ITEM_LEAF = 4096, 16, 4
#: About so many documents are scored first, for the k-th scores that the search starts from.
SEEDS = 20_000
#: Stands for a null id in a task, which is last.
LAST = int(np.iinfo(np.int64).max)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, whose bytes beyond ASCII are all parts of terms."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Rows:
    """Sparse rows: those of row i are at ``start[i]:start[i + 1]``."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of these rows' entries, and where each row's begin among them."""
        size = self.start[rows + 1] - self.start[rows]
        begin = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.start[rows] - begin, size), begin

    def take(self, rows: np.ndarray) -> Rows:
        at, begin = self.pick(rows)
        return Rows(np.append(begin, len(at)), self.term[at], self.value[at])

    def times(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The product of each of ``rows`` with a dense vector."""
        at, begin = self.pick(rows)
        if not len(at):
            return np.zeros(len(rows), np.int64)
        product = np.append(weight[self.term[at]] * self.value[at], 0)
        total = np.add.reduceat(product, begin)
        total[self.start[rows + 1] == self.start[rows]] = 0
        return total


def maxima(rows: Rows, owner: np.ndarray, nodes: int) -> Rows:
    """One row to each node: the greatest value of every term in the rows that it owns."""
    key = np.repeat(owner, np.diff(rows.start))
    order = np.lexsort((rows.term, key))
    key, term, value = key[order], rows.term[order], rows.value[order]
    if not len(key):
        return Rows(np.zeros(nodes + 1, np.int64), term, value)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (term[1:] != term[:-1])))
    return Rows(np.searchsorted(key[first], np.arange(nodes + 1)), term[first], np.maximum.reduceat(value, first))


@dataclass
class Tree:
    """Rows in the order of a hierarchy. ``levels[0]`` is the root; each level has its nodes' maxima and
    where each node's children (on the last level, its rows) begin in the next."""

    order: np.ndarray
    rows: Rows
    levels: list[Rows] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The children of these nodes of a level, or rows of the last."""
        begin, size = self.children[level][nodes], self.children[level][nodes + 1] - self.children[level][nodes]
        return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def build(rows: Rows, leaf: int, fanout: int = 8) -> Tree:
    """Halves the rows, again and again, by having or lacking the term that parts their weight best; then cuts the order.

    Where no term parts the rows of a group they stay in their order. Groups of ``leaf`` rows that
    follow each other are the last level, ``fanout`` of a level make a node of the one above.
    """
    out: list[np.ndarray] = []
    stack = [np.arange(len(rows))]
    while stack:
        group = stack.pop()
        if len(group) <= leaf:
            out.append(group)
            continue
        at, begin = rows.pick(group)
        terms, slot = np.unique(rows.term[at], return_inverse=True)
        count, weight = np.bincount(slot), np.zeros(len(terms))
        np.maximum.at(weight, slot, rows.value[at].astype(float))
        gain = weight**2 * count * (len(group) - count)  # variance of having the term, times what it can add to a score
        best = int(np.argmax(gain)) if len(gain) else -1
        if best < 0 or gain[best] <= 0:
            out.append(group)
            continue
        owner = np.searchsorted(begin, np.flatnonzero(slot == best), side="right") - 1
        has = np.zeros(len(group), bool)
        has[owner] = True
        stack += [group[~has], group[has]]
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    tree = Tree(order, rows.take(order))
    below, size = tree.rows, leaf
    while True:
        n = len(below)
        nodes = max(1, -(-n // size))
        tree.children.insert(0, np.append(np.arange(nodes) * size, n))
        below = maxima(below, np.arange(n) // size, nodes)
        tree.levels.insert(0, below)
        if nodes == 1:
            return tree
        size = fanout


class Search:
    """All items' k best documents, over blocks that are added one by one."""

    def __init__(self, items: Rows, least: np.ndarray, k: int, size: int):
        """``items``: weights; ``least``: each item's k-th score known so far; ``size``: number of terms."""
        self.tree = build(items, ITEM_LEAF)
        self.k, self.floor = k, np.maximum(least[self.tree.order], 1)  # only scores above 0 count
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(items))]
        self.scratch = np.zeros(size, np.int64)
        self.scored = self.bounds = self.pairs = 0

    def _against(self, weights: Rows, node: int, docs: Rows, rows: np.ndarray) -> np.ndarray:
        lo, hi = weights.start[node], weights.start[node + 1]
        terms = weights.term[lo:hi]
        self.scratch[terms] = weights.value[lo:hi]
        total = docs.times(rows, self.scratch)
        self.scratch[terms] = 0
        return total

    def add(self, docs: Rows, ids: np.ndarray) -> None:
        """Searches one block; null ids are given as the greatest number."""
        block = build(docs, LEAF)
        self.pairs += len(docs) * len(self.tree.rows)
        self._visit(block, ids[block.order], 0, 0, 0, np.zeros(1, np.int64))

    def _visit(self, block: Tree, ids: np.ndarray, ql: int, q: int, dl: int, nodes: np.ndarray) -> None:
        """The q-th node of the items' level ql against these nodes of the block's level dl."""
        first, last = q, q + 1
        for c in self.tree.children[ql:]:
            first, last = c[first], c[last]
        at_items = ql == len(self.tree.levels)
        weakest = self.floor[q] if at_items else self.floor[first:last].min()
        weights = self.tree.rows if at_items else self.tree.levels[ql]
        bound = self._against(weights, q, block.levels[dl], nodes)
        self.bounds += len(nodes)
        nodes, bound = nodes[bound >= weakest], bound[bound >= weakest]
        if not len(nodes):
            return
        deepest = dl + 1 == len(block.levels)
        if at_items and deepest:
            self._score(block, ids, q, nodes, bound)
            return
        below = nodes if deepest else block.below(dl, nodes)
        below_level = dl if deepest else dl + 1
        for child in [q] if at_items else self.tree.below(ql, np.array([q])):
            self._visit(block, ids, ql if at_items else ql + 1, int(child), below_level, below)

    def _score(self, block: Tree, ids: np.ndarray, q: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        """Exact scores in the leaves, the most promising ones first, as long as a leaf's bound reaches the k-th score."""
        order = np.argsort(-bound, kind="stable")
        step = 4
        while len(order):
            order = order[bound[order] >= self.floor[q]]
            now, order, step = order[:step], order[step:], 2 * step
            if not len(now):
                return
            rows = block.below(len(block.levels) - 1, leaves[now])
            score = self._against(self.tree.rows, q, block.rows, rows)
            self.scored += len(rows)
            good = score >= self.floor[q]
            if good.any():
                self._keep(q, score[good], ids[rows[good]])

    def _keep(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        first = np.lexsort((ids, -score))[: self.k]
        merged = sorted(self.best[q] + [(-int(s), int(i)) for s, i in zip(score[first], ids[first], strict=True)])[: self.k]
        self.best[q] = merged
        if len(merged) == self.k:
            self.floor[q] = max(self.floor[q], -merged[-1][0])

    def found(self) -> list[tuple[int, int, int]]:
        """(place of the item, document, score)."""
        return [(int(self.tree.order[q]), doc, -minus) for q, best in enumerate(self.best) for minus, doc in best]


def vectors(df: DataFrame, known: dict[bytes, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs over the ``known`` terms: one row to each text with a term at all."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches(stream, 256):
            docs, ns, sizes, terms, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                counts = Counter(found)
                held = [t for t in counts if t in number]
                terms += map(number.__getitem__, held)
                tfs += map(counts.__getitem__, held)
                docs.append(doc)
                ns.append(len(found))
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _rows(terms: pa.ListArray, values: np.ndarray) -> Rows:
    start = terms.offsets.to_numpy().astype(np.int64)
    return Rows(start - start[0], terms.flatten().to_numpy().astype(np.int64), values)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best of all documents by a frequency-saturating score, exactly.

    Scores are the integers of the module's contract: a term's rarity times
    its saturated frequency, over the item's terms, once each. Only scores
    above 0 count, so an item may have fewer than ``k``; ties go to the
    smaller doc_id, null ids last. Null texts, and texts without a term, match
    nothing and are no documents of the statistics. Repeated documents are
    ranked each for itself, repeated items (one id and one text) are one item;
    a null item id is an id. Other columns, whatever their names, are not
    read; an empty table on either side gives an empty one.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    n_items = asked.count()
    passes = max(1, -(-n_items // items_a_pass))
    found = None
    for part in range(passes):
        some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part)
        ranked = _one_pass(docs, some.collect(), k, id_col, text_col, seeds)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _one_pass(docs: DataFrame, items: list, k: int, id_col: str, text_col: str, seeds: int) -> DataFrame:
    spark = docs.sparkSession
    held = [sorted(set(terms_of(bytes(r.text)))) for r in items]
    known = {t: i for i, t in enumerate(sorted({t for terms in held for t in terms}))}
    kept = written(vectors(docs, known, id_col=id_col, text_col=text_col))
    total = kept.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # One row to each of the items' terms, which one pass bounds.
    df = {r[0]: r[1] for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = np.array([int(np.floor(1000 * np.log((2 * total.docs + 2) / (2 * df.get(i, 0) + 1)))) for i in range(len(known))], np.int64)
    ids = [np.array([known[t] for t in terms], np.int64) for terms in held]
    wanted = Rows(np.cumsum([0, *map(len, ids)]), np.concatenate([*ids, np.zeros(0, np.int64)]), weight[np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)])
    shared = spark.sparkContext.broadcast((wanted, weight))
    weighed = _weighed(kept, weight, int(total.docs), int(total.terms))
    schema = "item int, doc_id long, score long"

    def searched(least: list[int]):  # noqa: ANN202
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, weights = shared.value
            search = Search(own, np.array(least, np.int64), k, len(weights))
            for batch in batches(stream, BLOCK):
                doc = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                search.add(_rows(batch.column("terms"), batch.column("weights").flatten().to_numpy().astype(np.int64)), doc)
            cols = list(zip(*search.found(), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["item", "doc_id", "score"])

        return run

    least = [0] * len(items)
    of = max(1, total.docs // seeds)
    if of > 1:  # the k-th best of some documents is at most that of all
        first = _best(weighed.where(F.pmod(F.xxhash64("doc_id"), F.lit(of)) == 0).mapInArrow(searched(least), schema), k).where(F.col("rank") == k)
        for r in first.collect():
            least[r.item] = r.score
    # Sorted by the two heaviest terms, then by the id, so that no term fills a range.
    keys = ["heaviest", "second", F.xxhash64("doc_id", "terms")]
    dealt = weighed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    best = _best(dealt.mapInArrow(searched(least), schema), k)
    names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long"))
    return best.join(names, "item").select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def _weighed(kept: DataFrame, weight: np.ndarray, docs: int, length: int) -> DataFrame:
    """doc_id, terms, weights (saturated frequencies), and the two terms that can add most to a score."""
    shared = kept.sparkSession.sparkContext.broadcast(weight)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, BLOCK):
            rows = _rows(batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype(np.int64))
            owner = np.repeat(np.arange(len(rows)), np.diff(rows.start))
            m = 100 - 90 + (90 * batch.column("n").to_numpy() * docs) // length
            rows.value = (1_000_000_000 * rows.value) // (1000 * rows.value + 8 * m[owner])
            by_worth = np.lexsort((-rows.value * shared.value[rows.term], owner))
            ends = rows.start[1:]
            top = [np.where(rows.start[:-1] + i < ends, np.append(rows.term[by_worth], 0)[np.minimum(rows.start[:-1] + i, len(by_worth))], -1) for i in (0, 1)]
            weights = pa.ListArray.from_arrays(pa.array(rows.start, pa.int32()), pa.array(rows.value, pa.int32()))
            terms = pa.ListArray.from_arrays(pa.array(rows.start, pa.int32()), pa.array(rows.term, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), terms, weights, *(pa.array(x, pa.int32()) for x in top)], ["doc_id", "terms", "weights", "heaviest", "second"])

    return kept.mapInArrow(run, "doc_id long, terms array<int>, weights array<int>, heaviest int, second int")


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = W.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
