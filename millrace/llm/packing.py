"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pattern packing: few-document length patterns are enumerated, non-negative
least squares fits how often each repeats to the histogram of lengths, the
counts are rounded down to what the histogram holds, and a best-fit greedy
packs the residual lengths. The plan is made from the histogram alone, which
has one row for each length at most; placing the pieces is a Spark job.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.util import batches, checkpoint, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _byte_chars() -> list[str]:
    """The printable character that byte-level models write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


#: Lower-case Latin-1 letters (one pre-token), then ASCII punctuation (another one).
_WORD = re.compile("([a-zß-öø-ÿ]*)([!-/:-@\\[-`{-~]*)").fullmatch


class WordMemo(dict):
    """White-space-delimited chunk of a text -> its ids, as little-endian uint32 bytes.

    The pre-tokenizer never joins characters across a space, so a text's ids
    are those of its chunks. A chunk of lower-case Latin letters is a single
    pre-token and goes to the model itself, as does a run of punctuation; any
    other chunk goes through the whole tokenizer. Two generations of ``size`` chunks are kept at most.
    """

    def __init__(self, path: str, size: int = 150_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size, self.chars = size, _byte_chars()
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        made = self.old.get(chunk)
        if made is None:
            made = self._encode(chunk)
        self[chunk] = made
        return made

    def _encode(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not (found := _WORD(chunk)):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if tail := found[2]:
            return self[found[1]] + (self[tail] if chunk != tail else self._model(tail))
        return self._model(chunk)

    def _model(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.chars.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def text(self, text: str) -> bytes:
        if text.isascii() or _latin(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_MEMOS: dict[str, WordMemo] = {}


def word_memo(path: str) -> WordMemo:
    """One memo for each Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _MEMOS:
        _MEMOS[path] = WordMemo(path)
    return _MEMOS[path]


def _latin(text: str) -> bool:
    """Latin-1 only: there, lower case and normal form need no context."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Tokenised pieces of at most ``limit`` ids: PIECES, where ids are little-endian uint32.

    A document is its ids and then ``end_id``; only longer ones are cut. Null
    and empty texts are the end id alone. With ``keep_ids`` false the ids
    column is null and only lengths and checksums leave the task. Whole texts
    are cut up, however long. Repeated rows and rows with a null id are pieces
    of their own; other columns, whatever their names, are not read. An empty
    table gives an empty one. ``path`` must be a tokenizer that lower-cases and
    parts words at white space and punctuation, as the public one does.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end, step = word_memo(path), np.array([end_id], "<u4").tobytes(), 4 * limit
        for batch in batches(stream, 256):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memo.text(text) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, PIECES)


def enumerate_patterns(counts: np.ndarray, limit: int, partners: int) -> list[tuple[int, ...]]:
    """Patterns of two or three lengths that fill a sequence exactly.

    Pairs: every length and its complement. Triples: every length with each
    of the ``partners`` commonest lengths and what is then missing. Lengths
    that do not occur make no pattern; all patterns are sorted and distinct.
    """
    there = np.flatnonzero(counts)
    there = there[there < limit]
    common = there[np.argsort(-counts[there], kind="stable")][:partners]
    found = set()
    for a in there.tolist():
        if counts[limit - a]:
            found.add(tuple(sorted((a, limit - a))))
        for b in common.tolist():
            c = limit - a - b
            if c > 0 and counts[c]:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found)


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that minimise |A x - counts|, by accelerated projected gradient."""
    if not patterns:
        return np.zeros(0)
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.concatenate([np.array(p) for p in patterns])
    weight = 1.0 / np.sqrt(np.maximum(counts, 1.0))  # rare lengths count as much as common ones
    size, target = len(counts), weight * counts

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * np.bincount(length, x[owner], size)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, (weight * r)[length], len(patterns))

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A sets the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1.0 / max(1e-12, 1.05 * float(np.linalg.norm(back(forward(v)))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * back(forward(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(histogram: dict[int, int], limit: int = 2048, partners: int = 6) -> list[tuple[dict[int, int], int]]:
    """[(length -> how many in the sequence), repeats] that uses up the histogram exactly."""
    left = np.zeros(limit + 1, dtype=np.int64)
    for k, v in histogram.items():
        left[k] = v
    made: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: float) -> None:
        n = int(min(most, *(int(left[k]) // m for k, m in pattern.items())))
        if n > 0:
            for k, m in pattern.items():
                left[k] -= n * m
            made.append((pattern, n))

    if left[limit]:
        take({limit: 1}, left[limit])
    patterns = enumerate_patterns(left, limit, partners)
    fitted = fit_repeats(patterns, left.astype(float))
    for i in np.argsort(-fitted, kind="stable").tolist():
        if fitted[i] < 1:
            break
        take({k: patterns[i].count(k) for k in patterns[i]}, fitted[i] + 1e-9)
    there = sorted(np.flatnonzero(left).tolist())
    while there:  # residual: the longest piece first, then always the longest that still fits
        room, pattern, high = limit, {}, len(there)
        while room and (at := bisect_right(there, room, 0, high)):
            k = there[at - 1]
            m = min(int(left[k]), room // k)
            pattern[k], room, high = m, room - m * k, at - 1
        take(pattern, np.inf)
        there = [k for k in there if left[k]]
    return made


def _slots(made: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, how many in a sequence, offset) of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, n in made:
        offset = 0
        for k in sorted(pattern, reverse=True):
            runs.setdefault(k, []).append((used.get(k, 0), base, pattern[k], offset))
            used[k] = used.get(k, 0) + n * pattern[k]
            offset += k * pattern[k]
        base += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(parts: DataFrame, *, limit: int = 2048, partners: int = 6, spread: int = 256) -> DataFrame:
    """Places every piece: the input's columns and sequence_id, offset.

    ``parts`` has doc_id, piece and length (1 to ``limit``). Only its
    histogram comes to the driver, ``limit`` rows at most. The rank of a piece among those
    of its length is the rank within one of ``spread`` hash buckets plus the
    pieces in the buckets before, so no length, however common, is one group.
    Bucket counts number ``limit * spread`` at most. Repeated rows are
    pieces of their own. An empty table gives an empty table.
    """
    spark = parts.sparkSession
    numbered = parts.withColumn("_row", F.monotonically_increasing_id())
    keyed = checkpoint(numbered.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(spread)).cast("int")))
    cells = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    histogram = {int(r[0]): int(r[1]) for r in cells.groupBy("length").agg(F.sum("_n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, limit, partners)))
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "_row")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        k, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
        for n in np.unique(k):
            at = k == n
            first, base, many, offset = slots.value[int(n)]
            i = np.searchsorted(first, r[at], side="right") - 1
            inner = r[at] - first[i]
            seq[at], off[at] = base[i] + inner // many[i], offset[i] + inner % many[i] * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn("_at", place("length", (F.col("_rank") + F.col("_start")).cast("long")))
    return placed.select(*parts.columns, "_at.sequence_id", "_at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: sequence_id, length, ids (little-endian uint32), doc_ids.

    A sequence holds ``limit`` pieces at most, so its group is bounded.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(inside.alias("_p"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
