"""Places of rows in an order over the whole table, and joins by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(key: list[str], bounds: list[tuple], low: int = 0, high: int | None = None) -> Column:
    """How many of the sorted bounds are at most the row's key, by halving."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    bound = F.struct(*(F.lit(v).alias(c) for c, v in zip(key, bounds[mid], strict=True)))
    return F.when(F.struct(*key) >= bound, _bucket(key, bounds, mid + 1, high)).otherwise(_bucket(key, bounds, low, mid))


def positions(df: DataFrame, *order: str, name: str = "position", buckets: int = 64, sampled: int = 4096) -> DataFrame:
    """``df`` and each row's place, from 0, in the ascending order of the named columns, nulls first.

    The order is cut into ``buckets`` ranges at bounds from a sample of about
    ``sampled`` keys. A place is the rank within the range plus the rows of the ranges
    before it, so no task sees more than a range. Name columns that tell rows
    apart: rows alike in all of them have places of their own, in no fixed
    order, and are all in one range.
    """
    key = list(order)
    total = df.count()
    share = min(1.0, sampled / max(1, total))
    sample = df.select(*key).sample(share, seed=17).dropna().distinct().limit(4 * sampled).collect()
    rows = sorted(tuple(r) for r in sample)
    bounds = [rows[len(rows) * i // buckets] for i in range(1, buckets)] if rows else []
    dealt = df.withColumn("_b", _bucket(key, sorted(set(bounds))))
    sizes = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # one row to a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_b", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(*key))
    return dealt.withColumn("_r", inside).join(F.broadcast(starts), "_b").select(*df.columns, (F.col("_start") + F.col("_r") - 1).alias(name))


def by_position(details: DataFrame, records: DataFrame, *, details_order: tuple[str, ...], records_order: tuple[str, ...]) -> DataFrame:
    """Each detail with the record of the same place in its own order: position, the details' columns, the records'.

    Details beyond the last record have nulls, records beyond the last detail go. Columns of one name
    on both sides come twice; rename one of them first.
    """
    return positions(details, *details_order).join(positions(records, *records_order), "position", "left")


def zero_samples(details: DataFrame, records: DataFrame, *, score: str, details_order: tuple[str, ...], records_order: tuple[str, ...], k: int = 10) -> DataFrame:
    """The first ``k`` details with score 0, in their order, each with the record of its place. Null scores are not 0."""
    wrong = positions(details, *details_order).where(F.col(score) == 0).orderBy("position").limit(k)
    return wrong.join(positions(records, *records_order), "position", "left")
