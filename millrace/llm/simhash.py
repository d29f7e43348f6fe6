"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in
three bits at most, one half differs in one at most, so with one bit of that
half made a wildcard both have the same variant. Every fingerprint is listed
under its 64 one-wildcard variants; an equality join finds the buckets, and
the bits of their members are compared in full.

No pair list of a bucket is ever written. A bucket of two is compared where
it is counted. A bucket of up to ``TILE`` is compared in one task, which
returns links to the least member of each local component. A larger bucket
is listed again under one-wildcard variants of its free half, cut in two,
and then once more; the third time it can hold no more than ``TILE``
different fingerprints, so every link is found whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.util import SPACE, ascii_lower, checkpoint, let, texts

#: Fingerprints that agree in all but eleven fixed bits: the most a bucket of the third level can hold.
TILE = 2048
NEAR = 3


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of each shingle, repeats included; of the whole sequence if shorter; null if there is no word."""
    def hashes(parts: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(parts) - (words - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(parts, i, words))))
        return F.when(F.size(parts) >= words, many).when(F.size(parts) > 0, F.array(F.xxhash64(F.concat_ws(" ", parts))))

    return let(F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != ""), hashes)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">i8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (long) of each row; null and empty texts have fingerprint zero.

    Whole texts are read, however long; repeated rows each give a row, an empty table none.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            made = [majority(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.int64())], ["doc_id", "fp"])

    hashed = texts(df, id_col, text_col).select("doc_id", F.coalesce(shingle_hashes(F.col("text"), words), F.expr("cast(array() as array<bigint>)")).alias("h"))
    return hashed.mapInArrow(run, "doc_id long, fp long")


def _variants(part: Column, bits: int) -> Column:
    """The one-wildcard variants of a number of ``bits`` bits, each with its position above."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda p: p.cast("long") * F.lit(1 << 32) + part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), p))))


def _listed(low: Column, high: Column, bits: int) -> Column:
    """Variants of two parts of ``bits`` bits; bit 40 tells which part."""
    return F.concat(_variants(low, bits), F.transform(_variants(high, bits), lambda v: v + F.lit(1 << 40)))


def _cut(c: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def local_links(fps: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links from members of a bucket to the least of their component, by comparing all bits."""
    bits = fps.view(np.uint64)
    root = np.full(len(fps), -1)
    for i in np.argsort(fps, kind="stable"):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                break
            hit = np.zeros(len(rest), dtype=bool)
            for f in front:
                hit |= np.bitwise_count(bits[rest] ^ bits[f]) <= near
            front = rest[hit]
            root[front] = i
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _compare(members: DataFrame, keys: list[str], near: int) -> DataFrame:
    """Links of buckets that hold ``TILE`` fingerprints at most.

    A bucket is gathered by an aggregation: rows repartitioned by their key may
    stay as a join before dealt them, and of a large one Spark deals the rows
    of one key over several tasks.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column(0)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            got = [local_links(values[a:b], near) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], ["u", "v"])

    return members.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "u long, v long")


def _buckets(listed: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets with two members or more; of buckets with the same members only one."""
    whole = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor(F.xxhash64("fp")).alias("s1"), F.bit_xor(F.xxhash64("fp", F.lit(7))).alias("s2")).where("n > 1")
    one = F.min(F.struct(*keys)).alias("_k")
    return whole.groupBy("n", "a", "b", "s1", "s2").agg(one).select("n", "a", "b", *[F.col(f"_k.{k}").alias(k) for k in keys])


def links(distinct: DataFrame, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning set of the links between fingerprints that differ in ``near`` (3 at most) bits or fewer."""
    fp = F.col("fp")
    listed = distinct.select("fp", F.explode(_listed(_cut(fp, 0, 32), _cut(fp, 32, 32), 32)).alias("k1"))
    found, keys = None, ["k1"]
    for level in (1, 2, 3):
        buckets = checkpoint(_buckets(listed, keys))
        pairs = buckets.where(f"n = 2 and bit_count(a ^ b) <= {near}").select(F.col("a").alias("u"), F.col("b").alias("v"))
        found = pairs if found is None else found.union(pairs)
        more = buckets.where("n > 2").select(*keys, "n")
        if more.isEmpty():
            break
        members = listed.join(more, keys)
        found = found.union(_compare(members.where(F.col("n") <= (tile if level < 3 else TILE)), keys, near))
        large = members.where(F.col("n") > tile)
        if level == 3 or buckets.where(F.col("n") > tile).isEmpty():
            break
        if level == 1:  # the half that the variant leaves free
            free = F.when(F.shiftright("k1", 40) == 1, _cut(fp, 0, 32)).otherwise(_cut(fp, 32, 32))
            listed, keys = large.select("fp", "k1", F.explode(_listed(_cut(free, 0, 16), _cut(free, 16, 16), 16)).alias("k2")), ["k1", "k2"]
        else:
            free = F.when(F.shiftright("k1", 40) == 1, _cut(fp, 0, 32)).otherwise(_cut(fp, 32, 32))
            free = F.when(F.shiftright("k2", 40) == 1, _cut(free, 0, 16)).otherwise(_cut(free, 16, 16))
            listed, keys = large.select("fp", "k1", "k2", F.explode(_listed(_cut(free, 0, 8), _cut(free, 8, 8), 8)).alias("k3")), ["k1", "k2", "k3"]
    return found


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row.

    component_id is the least doc_id reachable over fingerprints that differ
    in ``near`` bits or fewer. Null and empty texts have fingerprint zero and
    are linked like any other. Rows with a null doc_id take part; they never
    name a component, which is null if it has no other rows. Repeated rows
    each give a row. Other columns, whatever their names, are not read. An
    empty table gives an empty one.
    """
    docs = checkpoint(fingerprints(df, id_col=id_col, text_col=text_col, words=words))
    cores = df.sparkSession.sparkContext.defaultParallelism
    distinct = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("first")).repartition(4 * cores))  # each has 64 variants
    roots = components(links(distinct.select("fp"), near, tile)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
