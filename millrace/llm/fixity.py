"""Merkle fixity audit of WARC files.

Records and ordered offset ranges are hashed into trees, the roots of two
replicas are compared, and only mismatching branches are descended to locate
what is damaged. Every level is one aggregation over groups of ``fanout``
nodes; the comparison joins only the children of nodes that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.util import checkpoint

RECORD = "file long, seq long, start long, end long, digest string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, start, end, digest of the records of WARC files, plain or with a gzip member to each record.

    Offsets and digests are those of the file's bytes as they are stored. A
    file is one task's work. What starts neither with ``WARC/`` nor as a sound
    gzip member ends its file with one record that reaches to the end. An empty
    file has no records.
    """
    import hashlib
    import zlib

    def after(body: bytes, at: int) -> int:
        """Where the record that starts at a place ends."""
        if body.startswith(b"\x1f\x8b", at):
            member, end = zlib.decompressobj(31), at
            try:
                while not member.eof and end < len(body):  # in parts, so that the rest of the file is not copied for each member
                    part = body[end : end + 65536]
                    member.decompress(part)
                    end += len(part) - len(member.unused_data)
            except zlib.error:
                return len(body)
            return end if member.eof else len(body)
        head = body.find(b"\r\n\r\n", at)
        if head < 0 or not body.startswith(b"WARC/", at):
            return len(body)
        size = next((int(x.split(b":")[1]) for x in body[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        return len(body) if size is None else min(len(body), head + 4 + size + 4)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, at, rows = raw.as_py(), 0, []
                while at < len(body):
                    end = after(body, at)
                    rows.append((name, len(rows), at, end, hashlib.sha256(body[at:end]).hexdigest()))
                    at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["name", "seq", "start", "end", "digest"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "name string, seq long, start long, end long, digest string")


def record_text(url: Column, body: Column) -> Column:
    """A response record: header lines and body. Nulls are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records(df: DataFrame, *, id_col: str, url_col: str, body_col: str, per_file: int = 1024) -> DataFrame:
    """RECORD rows of the files that hold ``df``: ids in order, ``per_file`` ids to a file.

    Offsets run within a file. Null ids are in file -1, which is one task's
    work. Rows that repeat an id are further records, ordered by their digests.
    Whole bodies are hashed, however long; other columns, whatever their names,
    are not read. An empty table has no records.
    """
    raw = df.select(F.col(id_col).cast("long").alias("_id"), record_text(F.col(url_col), F.col(body_col)).alias("_t"))
    each = raw.select(F.coalesce(F.floor(F.col("_id") / per_file), F.lit(-1)).cast("long").alias("file"), "_id", F.octet_length("_t").cast("long").alias("_n"), F.sha2("_t", 256).alias("digest"))
    inside = W.partitionBy("file").orderBy("_id", "digest")
    upto = F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return each.select("file", (F.row_number().over(inside) - 1).cast("long").alias("seq"), (upto - F.col("_n")).alias("start"), upto.alias("end"), "digest")


def tree(leaves: DataFrame, fanout: int = 16, levels: int | None = None) -> list[DataFrame]:
    """Levels of the files' trees, leaves first: file, idx, start, end, hash.

    A node's hash is of its children's places, offset ranges and hashes in
    order; it has ``fanout`` children at most. ``levels``: how many above the leaves; by
    default until every file has one root.
    """
    level = leaves.select("file", F.col("seq").alias("idx"), "start", "end", F.col("digest").alias("hash"))
    if levels is None:
        longest = leaves.agg(F.max("seq")).first()[0] or 0
        levels = 0
        while longest:
            longest, levels = longest // fanout, levels + 1
    made = [level]
    for _ in range(levels):
        child = F.concat_ws(":", F.col("idx").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "hash")
        kids = F.sort_array(F.collect_list(F.struct("idx", "start", child.alias("t"))))
        joined = F.sha2(F.array_join(F.transform(kids, lambda k: k["t"]), ","), 256)
        level = level.groupBy("file", F.floor(F.col("idx") / fanout).cast("long").alias("idx")).agg(F.min("start").alias("start"), F.max("end").alias("end"), joined.alias("hash"))
        level = checkpoint(level)  # the level above is made from stored hashes, and the audit reads these
        made.append(level)
    return made


def replica_root(top: DataFrame, fanout: int = 16) -> str | None:
    """The root over the files' roots, built level by level as within a file; None if there is no file."""
    level = top.select((F.col("file") + 1).alias("file"), "hash")  # file -1 holds null ids
    while (last := level.agg(F.max("file")).first()[0]) is not None:
        kids = F.sort_array(F.collect_list(F.struct("file", "hash")))
        joined = F.sha2(F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["file"].cast("string"), k["hash"])), ","), 256)
        level = checkpoint(level.groupBy(F.floor(F.col("file") / fanout).cast("long").alias("file")).agg(joined.alias("hash")))
        if last < fanout:
            return level.first()["hash"]
    return None


def audit(a: DataFrame, b: DataFrame, *, fanout: int = 16, levels: int | None = None) -> DataFrame:
    """level (0: records), file, idx, start, end, state, hash_a, hash_b of every node that differs.

    ``a`` and ``b`` have RECORD columns. state: changed, missing (not in b) or
    extra (not in a); the range is that of a, or of b for extra nodes. Equal
    replicas, empty ones among them, give no rows. ``levels``: as in tree().
    """
    a, b = checkpoint(a), checkpoint(b)
    if levels is None:
        longest, levels = a.select("seq").union(b.select("seq")).agg(F.max("seq")).first()[0] or 0, 0
        while longest:
            longest, levels = longest // fanout, levels + 1
    left, right = tree(a, fanout, levels), tree(b, fanout, levels)
    found, parents = None, None
    for n in range(levels, -1, -1):
        x, y = left[n], right[n]
        if parents is not None:  # only the children of nodes that differ
            kids = parents.select(F.col("file").alias("_f"), F.col("idx").alias("_i"))
            x, y = (z.join(kids, (F.col("file") == F.col("_f")) & (F.floor(F.col("idx") / fanout) == F.col("_i")), "left_semi") for z in (x, y))
        x = x.select("file", "idx", F.col("start").alias("sa"), F.col("end").alias("ea"), F.col("hash").alias("hash_a"))
        y = y.select("file", "idx", F.col("start").alias("sb"), F.col("end").alias("eb"), F.col("hash").alias("hash_b"))
        both = x.join(y, ["file", "idx"], "full").where("NOT (sa <=> sb AND ea <=> eb AND hash_a <=> hash_b)")
        state = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
        parents = checkpoint(both.select(F.lit(n).alias("level"), "file", "idx", F.coalesce("sa", "sb").alias("start"), F.coalesce("ea", "eb").alias("end"), state.alias("state"), "hash_a", "hash_b"))
        found = parents if found is None else found.union(parents)
    return found
