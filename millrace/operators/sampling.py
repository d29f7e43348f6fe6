"""Quotas, seeded samples and stratified picks. Samples order rows by a seeded md5, so they are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: int, c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def quotas(df: DataFrame, *, name_col: str, budget: int) -> DataFrame:
    """Shares of a budget: the rest goes to the first slots, by name."""
    n = df.select(name_col).distinct()
    counted = n.crossJoin(n.agg(F.count(F.lit(1)).alias("_n")))  # one row beside each slot
    pos = F.row_number().over(W.orderBy(name_col)) - 1  # slots are files or datasets, few by nature
    return counted.select(name_col, (F.floor(F.lit(budget) / F.col("_n")) + (pos < F.lit(budget) % F.col("_n")).cast("int")).cast("long").alias("quota"))


def nested_quotas(df: DataFrame, *, group_col: str, name_col: str, budget: int) -> DataFrame:
    """group, name, quota: the groups' shares of a budget, each dealt to the group's names in turn; the rest goes to the first by name."""
    names = df.select(group_col, name_col).distinct()
    share = quotas(names, name_col=group_col, budget=budget).withColumnRenamed("quota", "_q")
    within = W.partitionBy(group_col)
    placed = names.join(share, group_col).withColumn("_n", F.count(F.lit(1)).over(within)).withColumn("_at", F.row_number().over(within.orderBy(name_col)) - 1)
    return placed.select(group_col, name_col, (F.floor(F.col("_q") / F.col("_n")) + (F.col("_at") < F.col("_q") % F.col("_n")).cast("int")).cast("long").alias("quota"))


def sample_per_group(df: DataFrame, *, group_col: str, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group, uniformly; ties by id."""
    order = W.partitionBy(group_col).orderBy(seeded(seed, F.col(id_col)), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool(df: DataFrame, *, id_col: str, size: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(id_col)), id_col).limit(size)


def round_robin(df: DataFrame, *, group_col: str, id_col: str, limit: int = 20) -> DataFrame:
    """One row of each group in turn, smaller groups first, until ``limit``. Only ``limit`` rows of a group can be picked."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("group_size"))
    order = W.partitionBy(group_col).orderBy(id_col)
    ranked = df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)
    return ranked.join(sizes, group_col).orderBy("rn", "group_size", group_col).limit(limit)
