"""Exact top-k inner products by dual-tree cover-tree search.

Rows are dealt to cells by nearest pivot and, within a cell, to blocks of
bounded size; every block of data and every group of queries carries its own
cover tree. A pair of nodes is pruned when the covering radii show that no
score in it can reach the worst k-th score of the query group. Spark does the
same above: a query group is held against the cells, then against the blocks
of the cells that are left, before any trees meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.util import checkpoint

#: Radii shrink by this from level to level; a node of so few rows has no children.
BASE, LEAF = 1.3, 16
NONE = -(1 << 62)


class CoverTree:
    """A cover tree with points as centres, over rows of whole numbers.

    A node of level i has a centre, one of its rows, and covers rows that lie
    within BASE**i of it. Its children have level i - 1 and cover all its rows
    (covering); their centres, the node's own first (nesting), lie more than
    BASE**(i - 1) apart (separation). Levels in which a node would have itself
    as its only child are left out. Rows are held in the order of the leaves,
    so that a node is a slice; ``radius`` is the distance of its farthest row.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.at, self.level, self.radius, self.start, self.end, self.kids = [], [], [], [], [], []
        self._rows, self._square, self._filled = rows, (rows**2).sum(axis=1), 0
        order: list[np.ndarray] = []
        if len(rows):
            first = int(np.argmin(self._far(int(np.argmax(self._square)), np.arange(len(rows)))))
            self._add(first, np.arange(len(rows)), self._far(first, np.arange(len(rows))), order)
        perm = np.concatenate(order) if order else np.array([], int)
        place = np.empty(len(perm), int)
        place[perm] = np.arange(len(perm))
        self.rows, self.ids = rows[perm], ids[perm]
        self.at = place[np.array(self.at, int)]
        self.radius, self.start, self.end = np.array(self.radius), np.array(self.start, int), np.array(self.end, int)
        self.center = self.rows[self.at]
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        del self._rows, self._square

    def _far(self, center: int, rows: np.ndarray) -> np.ndarray:
        """Squared distances; exact, as all numbers are whole."""
        return self._square[rows] + self._square[center] - 2 * (self._rows[rows] @ self._rows[center])

    def _add(self, center: int, rows: np.ndarray, far: np.ndarray, order: list[np.ndarray]) -> int:
        me, radius = len(self.at), float(np.sqrt(far.max()))
        level = int(np.ceil(np.log(radius) / np.log(BASE))) if radius else None
        while level is not None and BASE**level < radius:  # rounding of the logarithm
            level += 1
        for kept, value in zip((self.at, self.level, self.radius, self.start, self.end, self.kids), (center, level, radius, self._filled, self._filled + len(rows), []), strict=True):
            kept.append(value)
        if len(rows) <= LEAF or not radius:
            order.append(rows)
            self._filled += len(rows)
            return me
        near = BASE ** (2 * (level - 1))
        own = far <= near
        groups, rest = [(center, rows[own], far[own])], rows[~own]
        while len(rest):  # a net: every next centre lies farther than that from all before it
            some = rest[:64]
            apart = self._square[some][:, None] + self._square[rest][None, :] - 2 * (self._rows[some] @ self._rows[rest].T)
            left = np.ones(len(rest), bool)
            for n, c in enumerate(some.tolist()):
                if left[n]:
                    hit = left & (apart[n] <= near)
                    groups.append((c, rest[hit], apart[n][hit]))
                    left &= ~hit
            rest = rest[left]
        for c, inside, d in groups:
            self.kids[me].append(self._add(c, inside, d, order))
        return me


def _bounds(q: CoverTree, i: int, d: CoverTree, nodes: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of node i with each of ``nodes``; a rounding allowance is added."""
    raw = d.center[nodes] @ q.center[i] + q.norm[i] * d.radius[nodes] + d.norm[nodes] * q.radius[i] + q.radius[i] * d.radius[nodes]
    return raw + 1e-9 * (1 + np.abs(raw))


class Search:
    """The k best rows of ``d`` for each row of ``q``; ``floor``: scores that need not be beaten from below.

    ``products`` counts the scores computed, ``bounds`` the pairs of nodes held against each other.
    """

    def __init__(self, q: CoverTree, d: CoverTree, k: int, floor: dict[int, int] | None = None):
        self.q, self.d, self.k, self.products, self.bounds = q, d, k, 0, 0
        n = len(q.ids)
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.array([(floor or {}).get(int(i), NONE) for i in q.ids], np.int64)
        if n and len(d.ids):
            self._visit(0, np.array([0]))

    def _worst(self, span: slice) -> int:
        return int(np.maximum(self.scores[span, -1], self.least[span]).min())

    def _open(self, i: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = _bounds(self.q, i, self.d, nodes)
        self.bounds += len(nodes)
        left = bound >= self._worst(slice(self.q.start[i], self.q.end[i]))
        return nodes[left], bound[left]

    def _visit(self, i: int, nodes: np.ndarray) -> None:
        nodes, bound = self._open(i, nodes)
        if not len(nodes):
            return
        d = self.d
        if self.q.kids[i]:
            wide = np.array([m for x in nodes.tolist() for m in (d.kids[x] if d.kids[x] and d.radius[x] >= self.q.radius[i] / BASE else [x])])
            for kid in self.q.kids[i]:
                self._visit(kid, wide)
            return
        done_nodes, done_bounds = [], []
        while len(nodes):  # down to the leaves
            inner = np.array([bool(d.kids[x]) for x in nodes.tolist()])
            done_nodes.append(nodes[~inner])
            done_bounds.append(bound[~inner])
            wide = [m for x in nodes[inner].tolist() for m in d.kids[x]]
            nodes, bound = self._open(i, np.array(wide)) if wide else (np.array([], int), np.array([]))
        leaves, bound = np.concatenate(done_nodes), np.concatenate(done_bounds)
        by = np.argsort(-bound, kind="stable")
        leaves, bound = leaves[by], bound[by]
        upto, at, want = np.cumsum(d.end[leaves] - d.start[leaves]), 0, 4 * LEAF
        span = slice(self.q.start[i], self.q.end[i])
        while at < len(leaves) and bound[at] >= self._worst(span):  # the most promising leaves first, then twice as many
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + want, side="right")))
            end = min(end, at + int(np.searchsorted(-bound[at:], -self._worst(span), side="right")))
            self._meet(span, np.concatenate([np.arange(d.start[x], d.end[x]) for x in leaves[at:end].tolist()]))
            at, want = end, 2 * want

    def _meet(self, span: slice, rows: np.ndarray) -> None:
        new, k = (self.q.rows[span] @ self.d.rows[rows].T).astype(np.int64), self.k
        self.products += new.size
        good = new >= np.maximum(self.scores[span, -1], self.least[span])[:, None]
        if len(rows) > k:
            good &= new >= np.partition(new, len(rows) - k, axis=1)[:, len(rows) - k][:, None]
        r, c = np.nonzero(good)
        if not len(r):
            return
        m = span.stop - span.start
        r2 = np.concatenate([r, np.repeat(np.arange(m), k)])
        s2 = np.concatenate([new[r, c], self.scores[span].ravel()])
        i2 = np.concatenate([self.d.ids[rows][c], self.ids[span].ravel()])
        by = np.lexsort((i2, -s2, r2))
        r2, s2, i2 = r2[by], s2[by], i2[by]
        rank = np.arange(len(r2)) - np.searchsorted(r2, np.arange(m))[r2]
        top = rank < k
        self.scores[span.start + r2[top], rank[top]], self.ids[span.start + r2[top], rank[top]] = s2[top], i2[top]

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(query id, id, score), less what cannot reach the floor."""
        for r in range(len(self.q.ids)):
            for s, i in zip(self.scores[r].tolist(), self.ids[r].tolist(), strict=True):
                if s > NONE and s >= self.least[r]:
                    yield int(self.q.ids[r]), i, s


def quantised(c: Column) -> Column:
    """floor(256 * x) of each component; null if the vector or any component is null or not finite."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(c.isNotNull() & fine & (F.size(c) > 0), F.transform(c, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _matrix(vectors: list, width: int = 0) -> np.ndarray:
    """Rows of float64; shorter vectors are filled with zeros."""
    width = max([width, *map(len, vectors)])
    out = np.zeros((len(vectors), width))
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def _blocks(rows: DataFrame, size: int, pivots: int) -> tuple[DataFrame, dict[int, tuple[list[float], float, int]]]:
    """block, tree (a pickled CoverTree), center, radius, n: rows (id, v) by nearest pivot, ``size`` to a block on average.
    And cell -> (pivot, radius, blocks), where block is the cell and a number below its blocks.

    ``rows`` must be checkpointed. At most ``pivots`` of them are chosen to be pivots, by hash, so few come to the driver.
    A cell with many rows, however alike they are, is dealt over many blocks.
    """
    pivots = max(1, min(pivots, -(-rows.count() // size)))  # no more cells than blocks are needed
    some = [r.v for r in rows.select("v", F.xxhash64("id").alias("_h")).orderBy("_h", "v").limit(pivots).collect()]
    base = _matrix(some) if some else np.zeros((1, 1))

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = _matrix(batch.column(1).to_pylist(), base.shape[1])
            p = np.pad(base, ((0, 0), (0, x.shape[1] - base.shape[1])))
            far = (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
            near = np.argmin(far, axis=1)
            away = np.sqrt(np.maximum(far[np.arange(len(x)), near] + (x**2).sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()), pa.array(away)], ["id", "v", "cell", "away"])

    dealt = rows.mapInArrow(assign, "id long, v array<long>, cell long, away double")
    counts = {r[0]: (r[1], r[2]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("away")).collect()}  # one row for each pivot at most
    cells = {c: (base[c].tolist(), far * (1 + 1e-12), max(1, -(-n // size))) for c, (n, far) in sorted(counts.items())}
    pieces = F.create_map(*[F.lit(x) for c, (_, _, many) in cells.items() for x in (int(c), many)]) if cells else F.create_map(F.lit(0), F.lit(1))
    keyed = dealt.withColumn("block", F.concat_ws(":", "cell", F.pmod(F.xxhash64("id"), pieces[F.col("cell")])))

    def build(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        made = CoverTree(_matrix(list(pdf["v"])), pdf["id"].to_numpy(np.int64))
        return pd.DataFrame({"block": [key[0]], "tree": [pickle.dumps(made)], "center": [made.center[0].tolist()], "radius": [float(made.radius[0])], "n": [len(pdf)]})

    made = checkpoint(keyed.groupBy("block").applyInPandas(build, "block string, tree binary, center array<double>, radius double, n long"))
    return made.coalesce(max(1, -(-sum(c[2] for c in cells.values()) // 256))), cells


def _run(pairs: DataFrame, k: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for qt, dt, who, low in zip(*(batch.column(i) for i in range(4)), strict=True):
                floor = dict(zip(who.as_py() or [], low.as_py() or [], strict=True))
                got = list(Search(pickle.loads(qt.as_py()), pickle.loads(dt.as_py()), k, floor).found())
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["query_id", "vec_id", "score"])

    return pairs.select("q_tree", "d_tree", "who", "low").mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(data: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = 2048, group: int = 256, pivots: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``data`` with the highest inner product, ties to the smaller id.

    Vectors are quantised to integers; those null, empty, or with a null or
    non-finite component take no part, nor do null ids. Of rows that repeat an
    id the one with the least vector counts. A query's own id is no candidate.
    Shorter vectors are filled with zeros. Queries without candidates have no rows; empty tables give an empty one.
    Other columns, whatever their names, are not read. Scores are exact up to 2**53.

    Equal vectors score alike, so each distinct vector is indexed once for its
    k + 1 smallest ids, which is all that k results without the query's own id
    can hold, and is searched once for all queries that share it.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"))
        return rows.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))

    alike = F.row_number().over(W.partitionBy("v").orderBy("id"))
    rows = checkpoint(usable(data).withColumn("_n", alike).where(F.col("_n") <= k + 1).select("id", "v"))
    asked = checkpoint(usable(queries))
    once = checkpoint(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    shared = asked.join(once.select("v", F.col("id").alias("_once")), "v").select("id", "_once")
    found = _search(rows, once, k + 1, block, group, pivots).withColumnRenamed("query_id", "_once")
    each = shared.join(found, "_once").where("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    return _best(each, k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, k: int, block: int, group: int, pivots: int) -> DataFrame:
    """query_id, vec_id, score: the k best of ``rows`` (id, v) for each of ``asked`` (id, v); both are checkpointed."""
    made, cells = _blocks(rows, block, pivots)
    d = made.select(*[F.col(c).alias(f"d_{c}") for c in ("block", "tree", "center", "radius")])
    q = _blocks(asked, group, pivots)[0].select(*[F.col(c).alias(f"q_{c}") for c in ("block", "tree", "center", "radius", "n")])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))

    def bound(center: Column, radius: Column) -> Column:
        raw = dot("q_center", center) + size("q_center") * radius + size(center) * F.col("q_radius") + F.col("q_radius") * radius
        return raw + 1e-9 * (1 + F.abs(raw))

    # ``pivots`` cells at most, written out; a group of queries meets these first.
    kind = "array<struct<center: array<double>, radius: double, blocks: int, cell: bigint>>"
    places = F.array(*[F.struct(F.lit(p).cast("array<double>"), F.lit(float(r)), F.lit(n), F.lit(int(c))) for c, (p, r, n) in cells.items()]).cast(kind) if cells else F.array().cast(kind)
    near = q.select("q_block", "q_center", "q_radius", "q_n", F.explode(places).alias("_c")).select("q_block", "q_center", "q_radius", "q_n", F.col("_c.cell").alias("cell"), F.col("_c.blocks").alias("blocks"), bound(F.col("_c.center"), F.col("_c.radius")).alias("c_bound"))
    near = checkpoint(near)
    d_short = d.select("d_block", "d_center", "d_radius")

    def blocks(of: DataFrame) -> DataFrame:
        """Of the cells' blocks, by number, those that the bound leaves; no cell is a single key."""
        each = of.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("d_block", F.concat_ws(":", "cell", "_n")).drop("_n")
        return each.join(d_short, "d_block").withColumn("bound", bound(F.col("d_center"), F.col("d_radius"))).drop("d_center", "d_radius", "q_center", "q_radius")

    best = near.groupBy("q_block").agg(F.max_by("cell", F.struct("c_bound", "cell")).alias("cell"))
    first = checkpoint(blocks(near.join(best, ["q_block", "cell"])).groupBy("q_block").agg(F.max_by("d_block", F.struct("bound", "d_block")).alias("d_block")))
    trees_q, trees_d = q.select("q_block", "q_tree"), d.select("d_block", "d_tree")
    no = F.expr("cast(null as array<bigint>)")
    start = checkpoint(_best(_run(first.join(trees_q, "q_block").join(trees_d, "d_block").withColumns({"who": no, "low": no}), k), k))
    floors = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("low"))
    member = q.select("q_block", "q_tree").mapInArrow(_members, "q_block string, query_id long")
    low = member.join(floors, "query_id", "left").groupBy("q_block").agg(F.collect_list(F.when(F.col("low").isNotNull(), F.struct("query_id", "low"))).alias("_l"), F.min("low").alias("least"), F.count(F.lit(1)).alias("of"))
    reach = lambda b: (F.size("_l") < F.col("of")) | (F.col(b) >= F.col("least"))
    left = blocks(near.join(low, "q_block").where(reach("c_bound"))).where(reach("bound"))
    rest = left.join(first.withColumn("_done", F.lit(True)), ["q_block", "d_block"], "left").where("_done is null")
    more = _run(rest.select("q_block", "d_block", F.col("_l.query_id").alias("who"), F.col("_l.low").alias("low")).join(trees_q, "q_block").join(trees_d, "d_block").repartition("q_block", "d_block"), k)
    return _best(start.select("query_id", "vec_id", "score").union(more), k).select("query_id", "vec_id", "score")


def _members(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for block, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = pickle.loads(tree.as_py()).ids
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids)), pa.array(ids, pa.int64())], ["q_block", "query_id"])
