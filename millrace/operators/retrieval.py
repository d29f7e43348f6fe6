"""Text chunks and diverse retrieval over their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Where texts may be cut, best first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")


def _cut(text: str, size: int, seps: tuple[str, ...]) -> Iterator[str]:
    """Pieces of at most ``size`` characters; each separator stays at the head of what follows."""
    if len(text) <= size:
        yield text
        return
    at = next((n for n, s in enumerate(seps) if s in text), None)
    if at is None:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    first, *rest = text.split(seps[at])
    for part in filter(None, [first, *(seps[at] + r for r in rest)]):
        yield from _cut(part, size, seps[at + 1 :])


def _packed(text: str, size: int, overlap: int) -> list[str]:
    out, held, length = [], [], 0
    for part in _cut(" ".join(text.split()), size, SEPARATORS):
        if held and length + len(part) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    return [c for c in [*out, "".join(held).strip()] if c]


def chunks(c: Column, size: int = 600, overlap: int = 120) -> Column:
    """array<string>: a text, white space collapsed, in chunks of at most ``size`` characters that share up to ``overlap``; null has none."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _packed(t, size, overlap) if isinstance(t, str) else [])

    return run(c)


def _cut_pages(stream: Iterator[pa.RecordBatch], size: int, overlap: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """url, total_chunks, chunk_id, chunk of pages (url, text), of ``rows`` pages at a time, so that few texts are Python objects at once."""
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            cut = [_packed(t, size, overlap) for t in part.column(1).to_pylist()]
            from_page = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int32())
            totals = pa.array([len(c) for c in cut for _ in c], pa.int32())
            places = pa.array([n for c in cut for n in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(from_page), totals, places, pa.array([x for c in cut for x in c], pa.string())], ["url", "total_chunks", "chunk_id", "chunk"])


def page_chunks(pages: DataFrame, *, url_col: str, text_col: str, least_page: int = 50, least: int = 80, size: int = 600, overlap: int = 120) -> DataFrame:
    """url, chunk_id, total_chunks, sha, chunk: short pages and chunks left out; of equal chunks the first by url and place stays."""
    long = pages.where(F.length(F.trim(text_col)) >= least_page).select(F.col(url_col).alias("url"), F.col(text_col).cast("string").alias("text"))
    cut = long.mapInArrow(lambda stream: _cut_pages(stream, size, overlap), f"url {dict(long.dtypes)['url']}, total_chunks int, chunk_id int, chunk string")
    each = cut.where(F.length("chunk") >= least)
    row = F.struct("url", "chunk_id", "total_chunks", "chunk")
    first = each.groupBy(F.sha1("chunk").alias("sha")).agg(F.min_by(row, F.struct("url", "chunk_id")).alias("r"))
    return first.select("r.url", "r.chunk_id", "r.total_chunks", "sha", "r.chunk")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(c: Column) -> Column:
    """A vector as doubles of length one; null for zero vectors and where a component is null."""
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.nullif(F.sqrt(_dot(v, v)), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(v, lambda x: x / norm))


def _units(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which lists are vectors of ``dim`` components, no null among them, and of a length; these at length one, by columns). Sums run in order, as in ``unit``."""
    starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    nulls = np.concatenate([[0], np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))])
    at = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (ends - starts == dim) & (nulls[ends] == nulls[starts]))
    v = lists.values.to_numpy(zero_copy_only=False)[starts[at][None, :] + np.arange(dim)[:, None]]
    total = np.zeros(len(at))
    for x in v:
        total += x * x
    norm = np.sqrt(total)
    return at[norm != 0], v[:, norm != 0] / norm[norm != 0]


def _nearest(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, query_id: str, query_vec: str, fetch_k: int) -> DataFrame:
    """query_id, id, relevance, _v (at length one): of each query the ``fetch_k`` most similar rows of every task."""
    q = queries.select(F.col(query_id).alias("query_id"), unit(F.col(query_vec)).alias("_q")).where("_q is not null")
    asked = q.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((asked.column(0).combine_chunks(), asked.column(1).to_pylist()))
    narrow = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    types = dict(narrow.dtypes) | dict(q.dtypes)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pd.DataFrame] = {}
        kind, (names, wanted) = None, shared.value
        for batch in stream:
            kind = batch.schema.field(0).type
            for dim in {len(x) for x in wanted}:
                at, v = _units(batch.column(1), dim)
                ids = batch.column(0).take(pa.array(at)).to_pandas(integer_object_nulls=True)
                for i, x in enumerate(wanted):
                    if len(x) != dim or not len(at):
                        continue
                    relevance = np.zeros(len(at))
                    for a, b in zip(v, x, strict=True):
                        relevance += a * b
                    least = held[i]["relevance"].iloc[-1] if i in held and len(held[i]) == fetch_k else -np.inf
                    few = np.flatnonzero(~(relevance < least))
                    if len(few) > 4 * fetch_k:  # most of them are settled without a sort
                        few = few[~(relevance[few] < np.partition(relevance[few], -fetch_k)[-fetch_k])]
                    new = pd.DataFrame({"id": ids.iloc[few], "relevance": relevance[few], "_v": list(v[:, few].T.copy())})
                    both = pd.concat([held[i], new]) if i in held else new
                    held[i] = both.sort_values(["relevance", "id"], ascending=[False, True], na_position="first").head(fetch_k)
        for i, kept in held.items():
            again = names.take(pa.array([i] * len(kept)))
            yield pa.RecordBatch.from_arrays([again, pa.array(kept["id"].tolist(), kind), pa.array(kept["relevance"].to_numpy()), pa.array(kept["_v"].tolist(), pa.list_(pa.float64()))], ["query_id", "id", "relevance", "_v"])

    return narrow.mapInArrow(run, f"query_id {types['query_id']}, id {types['id']}, relevance double, _v array<double>")


def mmr(rows: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, query_id: str = "query_id", query_vec: str = "query", k: int = 15, fetch_k: int = 60, weight: float = 0.5) -> DataFrame:
    """query_id, rank, id, relevance: the ``k`` rows of most marginal relevance out of the ``fetch_k`` most similar ones.

    ``queries`` is a stated set that goes to every task and meets all rows in
    one pass; each task keeps its own ``fetch_k`` rows of a query, and only they
    are shuffled and ranked. Null and zero vectors take no part; ties go to the
    smaller id.
    """
    near = _nearest(rows, queries, id_col, vec_col, query_id, query_vec, fetch_k)
    order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fetch_k).drop("_n")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["relevance", "id"], ascending=[False, True], ignore_index=True)
        v = np.array(group["_v"].tolist(), dtype=np.float64)
        rel, near, chosen = group["relevance"].to_numpy(), np.zeros(len(group)), []
        open_ = np.ones(len(group), dtype=bool)
        for _ in range(min(k, len(group))):
            best = int(np.argmax(np.where(open_, weight * rel - (1 - weight) * near, -np.inf)))
            near = np.maximum(near if chosen else -np.inf, v @ v[best])
            open_[best] = False
            chosen.append(best)
        out = group.loc[chosen, ["query_id", "id", "relevance"]]
        return out.assign(rank=range(1, len(out) + 1))[["query_id", "rank", "id", "relevance"]]

    types = dict(near.dtypes)
    return near.groupBy("query_id").applyInPandas(pick, f"query_id {types['query_id']}, rank int, id {types['id']}, relevance double")


def context(picked: DataFrame, *, url_col: str = "url", text_col: str = "chunk", limit: int = 18_000) -> DataFrame:
    """query_id, context: chunks by rank under one header for each source, until the next would pass ``limit`` characters."""
    row = F.struct(F.col("rank"), F.col(url_col).alias("u"), F.col(text_col).alias("t"))

    def step(a: Column, x: Column) -> Column:
        head = F.when(F.array_contains(a["seen"], x["u"]), "").otherwise(F.concat(F.lit("\n--- Source: "), x["u"], F.lit(" ---\n")))
        more = F.concat(a["out"], head, x["t"])
        full = a["full"] | (F.length(more) > limit)
        return F.struct(F.when(full, a["out"]).otherwise(more).alias("out"), F.array_union(a["seen"], F.array(x["u"])).alias("seen"), full.alias("full"))

    start = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("full"))
    known = picked.where(F.col(url_col).isNotNull() & F.col(text_col).isNotNull())
    return known.groupBy("query_id").agg(F.aggregate(F.sort_array(F.collect_list(row)), start, step, lambda a: a["out"]).alias("context"))
