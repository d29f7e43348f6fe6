"""Namespaced key-value items and checkpoints as tables: the newest write of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("ns", "key", "value", "created_at", "updated_at", "expires_at")


def put(items: DataFrame, writes: DataFrame, *, ttl_minutes: int | None = None) -> DataFrame:
    """Items after writes of (ns, key, value, updated_at): a null value deletes, the first creation time stays.

    Of several writes of a key at one time the largest value counts.
    """
    ends = F.col("updated_at") + F.make_interval(mins=F.lit(ttl_minutes)) if ttl_minutes is not None else F.lit(None).cast("timestamp")
    new = writes.select("ns", "key", "value", F.col("updated_at").alias("created_at"), "updated_at", ends.alias("expires_at"))
    both = items.select(*COLUMNS, F.lit(0).alias("_new")).union(new.select(*COLUMNS, F.lit(1).alias("_new")))
    newest = F.max_by(F.struct("value", "updated_at", "expires_at"), F.struct("updated_at", "_new", F.col("value").isNull().cast("int"), "value"))
    merged = both.groupBy("ns", "key").agg(newest.alias("r"), F.min("created_at").alias("created_at"))
    return merged.where("r.value is not null").select("ns", "key", "r.value", "created_at", "r.updated_at", "r.expires_at")


def live(items: DataFrame, now: Column | None = None) -> DataFrame:
    """Items that have not expired at ``now``."""
    return items.where(F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now)))


def get(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items of (ns, key) pairs."""
    return items.join(keys.select("ns", "key").distinct(), ["ns", "key"], "left_semi")


def matches(value: Column, filters: dict[str, str | int | float | bool | None]) -> Column:
    """Whether a JSON value holds each member as asked; None asks for null or absence. Paths may be nested by dots."""
    hit = F.lit(True)
    for path, want in filters.items():
        got = F.get_json_object(value, f"$.{path}")
        text = str(want).lower() if isinstance(want, bool) else want
        hit = hit & (got.isNull() if want is None else F.coalesce((got.try_cast("double") if isinstance(text, int | float) else got) == F.lit(text), F.lit(False)))
    return hit


def search(items: DataFrame, prefix: tuple[str, ...] = (), *, filters: dict | None = None, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """Items under a namespace prefix whose value fits, newest first, then by ns and key; ``limit`` None gives all."""
    head = F.lit(True)
    for n, part in enumerate(prefix):
        head = head & F.coalesce(F.get("ns", F.lit(n)) == part, F.lit(False))
    found = items.where(head & matches(F.col("value"), filters or {}))
    return found if limit is None else found.orderBy(F.desc("updated_at"), "ns", "key").offset(offset).limit(limit)


def namespaces(items: DataFrame, prefix: tuple[str, ...] = (), *, depth: int | None = None) -> DataFrame:
    """ns, n: the distinct namespaces under a prefix, cut at ``depth``, and their items."""
    ns = F.slice("ns", 1, depth) if depth else F.col("ns")
    return search(items, prefix, limit=None).groupBy(ns.alias("ns")).agg(F.count(F.lit(1)).alias("n"))


def latest_checkpoints(checkpoints: DataFrame, *, before: str | None = None, limit: int = 1) -> DataFrame:
    """The newest ``limit`` checkpoints of each thread and namespace, below the id ``before``."""
    order = W.partitionBy("thread_id", "checkpoint_ns").orderBy(F.desc("checkpoint_id"))
    older = checkpoints if before is None else checkpoints.where(F.col("checkpoint_id") < before)
    return older.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def with_writes(checkpoints: DataFrame, writes: DataFrame) -> DataFrame:
    """Checkpoints with ``writes``: their pending writes by task and place; an empty array where there are none."""
    on = ["thread_id", "checkpoint_ns", "checkpoint_id"]
    w = writes.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("task_id", "idx", "channel", "value"))).alias("writes"))
    return checkpoints.join(w, on, "left").withColumn("writes", F.coalesce("writes", F.filter(F.array(F.struct(*[F.lit(None).cast(writes.schema[c].dataType).alias(c) for c in ("task_id", "idx", "channel", "value")])), lambda x: F.lit(False))))
