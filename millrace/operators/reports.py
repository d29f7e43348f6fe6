"""Results of evaluations: aligned with their samples, summed up, and the benchmarks and metrics they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_by_ordinal(left: DataFrame, right: DataFrame, *, task: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of a task on the left with its k-th on the right: task, ordinal (from 0) and both sides' other columns. Rows without a partner go."""
    placed = lambda df, by: df.withColumn("ordinal", F.row_number().over(W.partitionBy(task).orderBy(by)) - 1)
    return placed(left, left_order).join(placed(right, right_order), [task, "ordinal"])


def last_wins(df: DataFrame, *, key: str, order: str) -> DataFrame:
    """Of each key the whole row of greatest ``order``; no sort, only a partial aggregation."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """same: whether two results hold the same rows, whatever their order and number. Columns are matched by place; nulls are equal."""
    sides = a.withColumn("_s", F.lit(1)).union(b.withColumn("_s", F.lit(2)))
    masks = sides.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.bit_or("_s").alias("_s"))
    return masks.agg(F.coalesce(F.bool_and(F.col("_s") == 3), F.lit(True)).alias("same"))


def failure_patterns(df: DataFrame, *, score: str, kind: str | None, metric: str) -> DataFrame:
    """name, count, metric of the rows that score 0, by the kind of match; an empty kind is unknown, and without kinds there is one pattern."""
    name = F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("unknown")) if kind else F.lit("primary_metric_failure")
    return df.where(F.col(score) == 0).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("metric", F.lit(metric))


def primary_metric(df: DataFrame, *, by: str, name: str, primary: Column, place: str) -> DataFrame:
    """Of each group the first metric that is marked primary, else the first."""
    rank = F.struct(F.when(primary, 0).otherwise(1), F.col(place))
    return df.groupBy(by).agg(F.min_by(name, rank).alias("metric"))


def merge_results(df: DataFrame, *, success: Column, records: str, error: Column) -> DataFrame:
    """records of what succeeded, sources of these that have any, errors: one row."""
    ok = F.coalesce(success, F.lit(False))
    return df.agg(F.coalesce(F.sum(F.when(ok, F.col(records))), F.lit(0)).alias("records"), F.count_if(ok & (F.col(records) > 0)).alias("sources"), F.count_if(F.coalesce(error != "", F.lit(False))).alias("errors"))


def buckets(c: Column, edges: tuple[int, ...] = (0, 3, 8)) -> Column:
    """The range of a count: ``0``, ``1-3``, ``4-8``, ``>8`` by the given last counts of each."""
    out, low = F.lit(f">{edges[-1]}"), [0, *(e + 1 for e in edges)]
    for a, b in reversed(list(zip(low, edges, strict=False))):
        out = F.when(c <= b, str(a) if a == b else f"{a}-{b}").otherwise(out)
    return out


def plain_key(c: Column) -> Column:
    """A name in lower case between underscores, which stand for all but letters and digits."""
    return F.concat(F.lit("_"), F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("_"))


def longest_key(names: DataFrame, keys: tuple[str, ...], *, name: str) -> DataFrame:
    """``names`` with the longest of ``keys`` that its name holds as whole words, the earlier of two as long; null without one.

    The keys are those of a configuration, so they travel in the plan: no join, whatever the size of ``names``.
    """
    ordered = F.array(*map(F.lit, sorted(keys, key=len, reverse=True))) if keys else F.array().cast("array<string>")
    own = plain_key(F.col(name))
    return names.withColumn("key", F.try_element_at(F.filter(ordered, lambda k: own.contains(plain_key(k))), F.lit(1)))


def find_benches(benches: DataFrame, named: tuple[str, ...], tags: tuple[str, ...], *, name: str, aliases: str, tag_col: str, place: str) -> DataFrame:
    """name, found: ``specified`` for what is asked for by name, else by the first alias that holds the words; ``recommended`` for others that share a tag. Each bench once.

    ``named`` and ``tags`` are a user's words: one pass marks every bench, and an aggregation of one row a word finds the first.
    """
    words = [w.strip().lower() for w in named if w.strip()]
    wanted = [g.strip().lower() for g in tags if g.strip()]
    none = F.array().cast("array<string>")
    shared = F.arrays_overlap(F.transform(tag_col, lambda x: F.lower(F.trim(x))), F.array(*map(F.lit, wanted)) if wanted else none)

    def rank(w: str) -> Column:
        return F.when(F.lower(name) == w, 0).when(F.exists(aliases, lambda x: F.lower(x).contains(w)), 1)

    marked = benches.select(name, place, F.coalesce(shared, F.lit(False)).alias("_tag"), *[rank(w).alias(f"_w{i}") for i, w in enumerate(words)])
    first = [F.min(F.when(F.col(f"_w{i}").isNotNull(), F.struct(F.col(f"_w{i}"), F.col(place), F.col(name)))).alias(f"_w{i}") for i in range(len(words))]
    chosen = marked.agg(*first).select(F.array_compact(F.array(*[F.col(f"_w{i}")[name] for i in range(len(words))])).alias("_all")) if words else None
    both = marked.crossJoin(F.broadcast(chosen)) if words else marked.withColumn("_all", none)
    found = F.when(F.array_contains("_all", F.col(name)), "specified").when(F.col("_tag"), "recommended")
    return both.select(name, found.alias("found")).where("found is not null").distinct()


def add_benches(benches: DataFrame, new: DataFrame, *, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(benches with what is new, what was refused): a new bench needs a name that none has in any case; of several with one name the first is taken."""
    key = F.lower(F.col(name))
    ranked = new.withColumn("_key", key).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(order)))
    known = benches.select(key.alias("_key"), F.lit(True).alias("_known")).distinct()
    told = ranked.join(known, "_key", "left").withColumn("_ok", F.col("_known").isNull() & (F.col("_n") == 1) & F.coalesce(F.trim(name) != "", F.lit(False)))
    return benches.unionByName(told.where("_ok").select(*benches.columns)), told.where("not _ok").select(*new.columns)
