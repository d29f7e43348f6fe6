"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words of the labelled examples. None is left
out; those that labels prove telling weigh more. The nearest examples by exact
cosine come from an inverted index in blocks: scores over rarer words are
summed from their postings, the blocks' largest weights bound what common
words can add, and blocks that cannot reach the k-th best score are left out.
Distance-weighted votes of the neighbours give the score, calibrated on a
fifth of the examples that had no part in saying which words are telling, and
the neighbours are its evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from millrace.llm.util import batches, checkpoint, texts

_WORDS = re.compile(r"[^\W\d_]+").findall
#: One example in so many calibrates the votes.
FOLDS = 5
#: Features that an index keeps as columns, those in most examples.
COMMON = 512
#: Portions in which the driver takes in the examples.
PARTS = 8
Vector = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Votes:
    """max_labelled: most labelled rows that are learnt from, those of least hash of the id: a sample
    of a bounded size, so that the index has a bounded size too.
    chance: a feature's log-likelihood ratio that chance may give; what is above it adds to the
    feature's weight. k: neighbours. block: examples in a block of the index."""

    max_labelled: int = 10_000
    chance: float = 15.0
    k: int = 15
    block: int = 64
    threshold: float = 0.5


def gain(pos: np.ndarray, neg: np.ndarray, all_pos: int, all_neg: int) -> np.ndarray:
    """Signed log-likelihood ratios of features' documents against the label."""
    share, out = (pos + neg) / (all_pos + all_neg), np.zeros(len(pos))
    for got, of in ((pos, all_pos), (neg, all_neg)):
        for n, expected in ((got, of * share), (of - got, of * (1 - share))):
            out += 2 * n * np.log(np.where(n > 0, n, 1) / np.where(n > 0, expected, 1))
    return np.where(pos * all_neg > neg * all_pos, out, -out)


class Index:
    """Block-max inverted index of unit vectors, examples ordered so that like ones share blocks."""

    def __init__(self, examples: list[tuple[int, int, dict[int, float]]], n_terms: int, block: int):
        flat = [x for e in examples for x in sorted(e[2].items())]
        self._build(np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.float64), np.array([len(e[2]) for e in examples], np.int64), np.array([t for t, _ in flat], np.int32), np.array([w for _, w in flat], np.float64), np.ones(len(examples)), n_terms, block)

    @classmethod
    def of(cls, *columns) -> Index:
        """From columns: ids, labels, features of each example, then their places and weights one after another; the examples' lengths, by which weights are divided; the number of features, the block.
        With a weight of each feature last, the weights are counts."""
        made = cls.__new__(cls)
        made._build(*columns)
        return made

    def _build(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, lengths: np.ndarray, n_terms: int, block: int, scale: np.ndarray | None = None) -> None:
        n = len(ids)
        row, seen = np.repeat(np.arange(n, dtype=np.int32), sizes), np.bincount(terms, minlength=n_terms)
        most = np.argsort(-seen, kind="stable")[:COMMON]
        most = most[50 * seen[most] > n]
        self.column = np.full(n_terms, -1, np.int16)
        self.column[most] = np.arange(len(most))
        col = self.column[terms]
        own = col >= 0
        rows, cols, values = row[own], col[own], weights[own] if scale is None else (1 + np.log(weights[own].astype(np.float64))) * scale[terms[own]]
        by = np.lexsort((values, rows))
        top = by[np.flatnonzero(np.append(np.diff(rows[by]) != 0, True))] if len(by) else by  # each example's heaviest common feature
        kind, size = np.full(n, -1), np.zeros(n)
        kind[rows[top]], size[rows[top]] = cols[top], values[top] / lengths[rows[top]]
        order = np.lexsort((ids, size, kind))
        small = np.uint16 if n <= 1 << 16 else np.int32
        place = np.empty(n, small)
        place[order] = np.arange(n, dtype=small)
        self.ids, self.labels, self.lengths, self.block = ids[order], labels[order], lengths[order], block
        self.starts = np.arange(0, n, block)
        self.rows, self.cols, self.values, self.n_common = place[rows], cols, values, len(most)
        del rows, cols, values
        by = np.argsort(terms, kind="stable").astype(np.int32)
        by = by[~own[by]]
        self.docs = place[row[by]]
        del row, own, col
        self.weights, self.scale = weights[by], scale
        self.first = np.concatenate([[0], np.cumsum(np.where(self.column >= 0, 0, seen))])
        self.head: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Arrays packed; counts are few different numbers."""
        return {k: (zlib.compress(v.tobytes(), 1), v.dtype.str) if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: np.frombuffer(zlib.decompress(v[0]), v[1]) if isinstance(v, tuple) else v for k, v in state.items()})

    def _open(self) -> None:
        """Unit weights, made where they are used; common features as columns, with the largest weights of each block."""
        if self.scale is not None:
            self.weights = (1 + np.log(self.weights.astype(np.float64))) * np.repeat(self.scale, np.diff(self.first))
        self.weights = self.weights / self.lengths[self.docs]
        self.head = np.zeros((len(self.ids), self.n_common))
        self.head[self.rows, self.cols] = self.values / self.lengths[self.rows]
        self.tops = np.maximum.reduceat(self.head, self.starts, axis=0)
        self.rows = self.cols = self.values = None  # all of them are in the columns now

    def nearest_all(self, queries: list[Vector], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, places and cosines of the k nearest examples with a cosine over zero, ties to the smaller id."""
        if self.head is None:
            self._open()
        n, ask, sums = len(self.ids), np.zeros((len(queries), self.head.shape[1])), np.empty((len(queries), len(self.ids)))
        for i, (terms, weights) in enumerate(queries):
            col = self.column[terms]
            own = col >= 0
            ask[i, col[own]] = weights[own]
            terms, weights = terms[~own], weights[~own]
            first = self.first[terms]
            many = self.first[terms + 1] - first
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            sums[i] = np.bincount(self.docs[at], weights=self.weights[at] * np.repeat(weights, many), minlength=n)
            if but is not None:
                sums[i, self.ids == but[i]] = -np.inf
        bound = ask @ self.tops.T + np.maximum.reduceat(sums, self.starts, axis=1)
        worst = np.zeros(len(queries))
        done = np.zeros(bound.shape, bool)
        # The best block of each query first: its scores raise what the other blocks must reach.
        for want in (bound >= bound.max(axis=1, keepdims=True), None):
            if want is None:
                if n > k:
                    worst = np.maximum(np.partition(sums, n - k, axis=1)[:, n - k], 0.0)
                want = ~done & (bound > 0) & (bound >= worst[:, None] - 1e-9)
            for b in np.flatnonzero(want.any(axis=0)):
                mine, a = np.flatnonzero(want[:, b]), self.starts[b]
                sums[mine, a : a + self.block] += ask[mine] @ self.head[a : a + self.block].T
            done |= want
        out = []
        for i in range(len(queries)):
            got = np.flatnonzero((sums[i] > 1e-15) & (sums[i] >= worst[i] - 1e-9))
            best = got[np.lexsort((self.ids[got], -np.round(sums[i][got], 12)))[:k]]
            out.append((best, sums[i][best]))
        return out

    def nearest(self, query: dict[int, float], k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(list(query), np.int64)
        return self.nearest_all([(terms, np.array(list(query.values()), np.float64))], k, None if but is None else [but])[0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps fitted to y over x by pooling neighbours that fall: (x of each step, its mean)."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        steps.append([a, b, 1.0])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]):
            last = steps.pop()
            steps[-1] = [last[0] if steps[-1][0] == last[0] else steps[-1][0], steps[-1][1] + last[1], steps[-1][2] + last[2]]
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1.0) for s in steps])


class Model:
    """Features by hash, their weights and index."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, base: float, empty: float):
        self.hashes, self.weight, self.base, self.empty = hashes, weight, base, empty
        self.index: Index | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weight": zlib.compress(self.weight.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"weight": np.frombuffer(zlib.decompress(state["weight"]))})

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> Vector:
        """Places and TF-IDF weights of the features that the examples have too."""
        if not len(self.hashes):
            return np.array([], np.int64), np.array([])
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return at[known], (1 + np.log(counts[known])) * self.weight[at[known]]

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> Vector:
        """The same, of unit length."""
        at, made = self.weights(hashes, counts)
        return at, made / max(math.sqrt(float(made @ made)), 1e-300)

    def votes(self, queries: list[Vector], k: int, but: list[int] | None = None) -> list[tuple[float, list[tuple[int, float, int]]]]:
        out = []
        for places, scores in self.index.nearest_all(queries, k, but):
            labels = self.index.labels[places]
            raw = (float(scores @ labels) + 0.1 * self.base) / (float(scores.sum()) + 0.1)
            out.append((raw, [(int(i), float(s), int(y)) for i, s, y in zip(self.index.ids[places], scores, labels, strict=True)]))
        return out

    def scores(self, found: list[Vector], k: int, steps: Vector) -> list[tuple[float, list]]:
        """Score, calibrated by ``steps``, and neighbours of texts, given as hashes of their features and counts."""
        queries = [self.vector(h, c) for h, c in found]
        some = [i for i, (t, _) in enumerate(queries) if len(t)] if self.index else []
        out: list[tuple[float, list]] = [(self.empty, [])] * len(queries)
        for i, (raw, near) in zip(some, self.votes([queries[i] for i in some], k) if some else [], strict=True):
            out[i] = (float(np.interp(raw, *steps)), near)
        return out


def count_terms(text: str) -> Vector:
    """Hashes, in order, of its words in lower case; how often each occurs."""
    found = Counter(_WORDS(text.lower()))
    keys, counts = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)).view(np.int64), np.fromiter(found.values(), np.int32, len(found))
    order = np.argsort(keys)
    return keys[order], counts[order]


def _packed(found: list[Vector]) -> list[pa.Array]:
    return [pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in found], pa.binary())]


def _unpacked(hashes: pa.Array, counts: pa.Array) -> list[Vector]:
    return [(np.frombuffer(h, np.int64), np.frombuffer(zlib.decompress(c), np.int32)) for h, c in zip(hashes.to_pylist(), counts.to_pylist(), strict=True)]


def learn(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, votes: Votes) -> tuple[Broadcast, Vector]:
    """The model, sent to the executors, and the steps that calibrate it.

    Conflicting labels of one id: the largest counts; null ids and labels are
    left out. Texts that share a labelled id are an example each; rows that
    repeat id and text are one. Texts without words are counted, but no
    examples. No labels: a model that scores 0. ``labels`` must hold only rows
    that may be learnt from.
    """
    spark = df.sparkSession
    docs = texts(df, id_col, text_col)
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("_y")).where("doc_id is not null and _y is not null").groupBy("doc_id").agg(F.max("_y").alias("_y"))
    known = checkpoint(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(votes.max_labelled))
    # Bounded by max_labelled rows of two numbers, so small enough to send to every task.
    own = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "_y", F.xxhash64("text").alias("_h"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) > 0).alias("_fits"))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 128):
            found = [count_terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[2:], *_packed(found)], ["doc_id", "_y", "_h", "_fits", "hashes", "counts"])

    held = checkpoint(own.mapInArrow(count, "doc_id long, _y int, _h long, _fits boolean, hashes binary, counts binary"))
    n_rows, n_kinds = held.agg(F.count(F.lit(1)), F.countDistinct("doc_id", "_h")).first()
    if n_rows > n_kinds:
        held = held.dropDuplicates(["doc_id", "_h"])
    if n_kinds > votes.max_labelled:  # many texts of one id
        held = checkpoint(held.orderBy("doc_id", "_h").limit(votes.max_labelled))

    def tell(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1024):
            parts = [np.frombuffer(h, np.int64) for h in batch.column(2).to_pylist()]
            hashes, at = np.unique(np.concatenate(parts), return_inverse=True)
            y, fits = (np.repeat(np.array(c), [len(p) for p in parts]) for c in (np.array(batch.column(0).to_pylist()) > 0, batch.column(1).to_pylist()))
            pos, neg = (np.bincount(at[m & fits], minlength=len(hashes)) for m in (y, ~y))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes, np.bincount(at, minlength=len(hashes)), pos, neg)], ["f", "seen", "pos", "neg"])

    counts = held.select("_y", "_fits", "hashes").mapInArrow(tell, "f long, seen long, pos long, neg long").groupBy("f").agg(*[F.sum(n).alias(n) for n in ("seen", "pos", "neg")]).toArrow()
    hashes, seen, pos, neg = (counts.column(n).to_numpy() for n in ("f", "seen", "pos", "neg"))
    order = np.argsort(hashes)
    hashes, seen, pos, neg = hashes[order], seen[order], pos[order], neg[order]
    tally = [(bool(y), bool(fits), bool(some), n) for y, fits, some, n in held.groupBy(F.col("_y") > 0, "_fits", F.length("hashes") > 0).agg(F.count(F.lit(1))).collect()]
    many = lambda test: sum(t[3] for t in tally if test(*t[:3]))
    total, positive = many(lambda y, fits, some: True), many(lambda y, fits, some: y)
    fit_pos, fit_neg = many(lambda y, fits, some: y and fits), many(lambda y, fits, some: fits and not y)
    none, none_pos = many(lambda y, fits, some: not some), many(lambda y, fits, some: y and not some)
    weight = np.log((1 + total) / (1 + seen)) + 1
    if fit_pos and fit_neg:
        weight *= 1 + np.maximum(gain(pos, neg, fit_pos, fit_neg) - votes.chance, 0)
    base = positive / max(1, total)
    model = Model(hashes, weight, base, (none_pos + base) / (none + 1) if total > 1 else 0.0)
    steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not len(hashes):
        return spark.sparkContext.broadcast(model), steps
    held = held.where("length(hashes) > 0")
    del counts, order, seen, pos, neg
    # The labelled rows, bounded, some at a time.
    ids, kinds, terms, often, lengths, sizes = [], [], [], [], [], []
    for part in range(PARTS):
        got = held.where(F.pmod("_h", F.lit(PARTS)) == part).select("doc_id", "_y", "hashes", "counts").toArrow()
        for batch in got.to_batches(512):
            ids += batch.column(0).to_pylist()
            kinds += batch.column(1).to_pylist()
            some = _unpacked(batch.column(2), batch.column(3))  # all their features are the model's
            made = [model.weights(*found) for found in some]
            lengths += [math.sqrt(float(w @ w)) for _, w in made]
            sizes += [len(t) for t, _ in made]
            terms.append(np.concatenate([t for t, _ in made]).astype(np.int32))
            times = np.concatenate([c for _, c in some])
            often.append(times.astype(np.uint16) if times.max() < 1 << 16 else times)
            del some, made
        del got
    terms = np.concatenate(terms)
    often = np.concatenate(often)
    model.index = Index.of(np.array(ids), np.array([float(y > 0) for y in kinds]), np.array(sizes), terms, often, np.array(lengths), len(hashes), votes.block, weight)
    del terms, often
    shared = spark.sparkContext.broadcast(model)

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches(stream, 128):
            queries = [own.vector(*found) for found in _unpacked(batch.column(2), batch.column(3))]
            raw = [r for r, _ in own.votes(queries, votes.k, but=batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column(1)], ["raw", "_y"])

    apart = held.where("NOT _fits")
    if len({y for y, fits, some, _ in tally if some and not fits}) < 2:
        apart = held  # too few examples: all of them calibrate
    raw = apart.select("doc_id", "_y", "hashes", "counts").mapInArrow(judge, "raw double, _y int").toArrow()
    return shared, isotonic(raw.column(0).to_numpy(), (raw.column(1).to_numpy() > 0).astype(float))


def toxicity(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", votes: Votes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, evidence (nearest examples: doc_id, cosine, label) of each row, and the columns ``keep`` of the input.

    Null and empty texts, and texts that share no word with any example, get
    the rate of label 1 among labelled texts without words (with one more of the
    rate of all), with no evidence. Whole texts are read, however long. Equal
    cosines go to the smaller id. Repeated rows and rows with a null id each
    give a row; other columns of the input, whatever their names, are not read.
    An empty table gives an empty one.
    """
    votes = votes or Votes()
    shared, steps = learn(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, votes=votes)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches(stream, 64):
            got = own.scores([count_terms(t) for t in batch.column(1).to_pylist()], votes.k, steps)
            near = [[{"doc_id": i, "cosine": s, "label": y} for i, s, y in n] for _, n in got]
            scores = [s for s, _ in got]
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= votes.threshold) for s in scores], pa.int32()), pa.array(near, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *made, *batch.columns[2:]], [f.name for f in schema.fields])

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep)
    schema = StructType([*StructType.fromDDL("doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>").fields, *[given.schema[c] for c in keep]])
    return given.mapInArrow(run, schema)
