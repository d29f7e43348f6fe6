"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregation over the edges, so nothing is
gathered on the driver; the number of steps grows with the logarithm of the
longest path. Each round is checkpointed to the shared folder.

Rounds cost the driver a plan, threads and records of tasks, however few the
edges are. So each partition first joins its own edges, ``EACH`` at a time;
edges that are worth one partition only are settled by that, without rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.util import checkpoint, fewer

#: Edges that a task joins at a time.
EACH = 50_000


def _least(links: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return links.join(least, "u")


def _joined(edges: DataFrame, each: int) -> DataFrame:
    """(u, v): every node of a partition's edges with the least that it reaches by ``each`` or a batch more of them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        rows = 0

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["u", "v"])

        for batch in stream:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            rows += batch.num_rows
            if rows > each:
                yield stars()
                up.clear()
                rows = 0
        yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, *, each: int = EACH) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), any orderable type; root is the least node reachable.

    Loops, repeated edges and edges with a null end add nothing. No edges: an empty table.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    current, before = checkpoint(ordered), None
    rows = current.count()
    current, settled = fewer(current, rows, each), False
    if {kind for _, kind in current.dtypes} == {"bigint"}:
        current, settled = checkpoint(_joined(current, each)), rows <= each
    while not settled:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        pulled = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        current = checkpoint(pulled.where("u <> v").distinct())
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        current = fewer(current, now[0])
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
