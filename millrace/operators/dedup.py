"""Benchmark decontamination and exact dedup."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import collapse

#: Characters of a text that its quick key takes.
KEY = 500
#: A text holds another only where their lengths are alike.
RATIO = (0.8, 1.25)


def winnowed(c: Column, shared: int) -> Column:
    """array<bigint>: hashes of some shingles, so that two texts with ``shared`` characters in common have a hash in common.

    Of each window of neighbouring shingles the least hash is taken. A window
    and its shingles together are ``shared`` characters long, so a common part
    of that length covers the same window in both. Shorter texts have none.
    """
    size = min(32, (shared + 1) // 2)
    window = shared - size + 1

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray | None:
            if text is None or len(text) < shared:
                return None
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            n = len(codes) - size + 1
            h = np.zeros(n, np.uint64)
            for i in range(size):
                h = h * np.uint64(0x100000001B3) + codes[i : i + n]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            span = 1
            while 2 * span <= window:  # least of 2, 4, 8, ... neighbours
                h, span = np.minimum(h[:-span], h[span:]), 2 * span
            if rest := window - span:
                h = np.minimum(h[:-rest], h[rest:])
            return np.unique(h).view(np.int64)

        return texts.map(one)

    return hashes(c)


def _alike(docs: DataFrame, items: DataFrame, longer_than: int, *, by_key: bool) -> DataFrame:
    """Ids of ``docs`` (_id, _t) whose text holds one of ``items`` (_b), or the other way round, at like lengths; ``by_key``: or begins alike.

    Texts are normalised once, in one pass that leaves ids and hashes alone;
    only documents that share a hash with an item are read again and compared
    as texts. Texts too short or too long for any item are not cut up.
    """
    long_items = items.where(F.length("_b") > longer_than)
    ends = long_items.agg(F.min(F.length("_b")), F.max(F.length("_b"))).first()
    low, high = (int(RATIO[0] * ends[0]), int(RATIO[1] * ends[1]) + 1) if ends[0] else (1, 0)
    key = lambda n: F.xxhash64(F.substring(n, 1, KEY))
    near = lambda n: F.when((F.length(n) > longer_than) & F.length(n).between(low, high), n)
    once = F.transform(F.array(collapse(F.col("_t"))), lambda n: F.struct(F.when(n != "", key(n)).alias("key"), near(n).alias("near")))[0]
    hashes = [F.array(F.col("_s.key"))] * by_key + [F.coalesce(winnowed(F.col("_s.near"), longer_than + 1), F.array().cast("array<bigint>"))]
    marks = docs.select("_id", once.alias("_s")).select("_id", F.explode(F.concat(*hashes)).alias("_f")).where("_f is not null")
    named = items.withColumn("_k", F.xxhash64("_b"))
    cut = named.where(F.length("_b") > longer_than).select("_k", F.explode(winnowed(F.col("_b"), longer_than + 1)).alias("_f"))
    targets = cut.union(named.select("_k", key(F.col("_b")).alias("_f"))) if by_key else cut
    pairs = marks.join(targets, "_f").select("_id", "_k").distinct()
    met = docs.join(pairs, "_id").join(named, "_k").select("_id", "_b", collapse(F.col("_t")).alias("_n"))
    like = (F.length("_n") > longer_than) & (F.length("_b") > longer_than) & (F.length("_n") / F.length("_b")).between(*RATIO)
    same = like & (F.col("_n").contains(F.col("_b")) | F.col("_b").contains(F.col("_n")))
    return met.where(same | (F.substring("_n", 1, KEY) == F.substring("_b", 1, KEY)) if by_key else same).select("_id")


def contaminated(df: DataFrame, bench: DataFrame, *, id_col: str, text_col: str, bench_col: str, longer_than: int = 100) -> DataFrame:
    """Ids whose text has the first 500 characters of a benchmark text, or contains or is contained in one of like length.

    Texts are compared in lower case with white space collapsed. Containment
    asks for more than ``longer_than`` characters on both sides and a length
    ratio of 0.8 to 1.25. Null and blank texts match nothing; an id that
    repeats is named if one of its rows matches, and a null id never.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    items = bench.select(collapse(F.col(bench_col)).alias("_b")).where("_b <> ''").distinct()
    return _alike(docs, items, longer_than, by_key=True).distinct()


def decontaminate(df: DataFrame, bench: DataFrame, *, id_col: str, text_col: str, bench_col: str, longer_than: int = 100) -> DataFrame:
    hits = contaminated(df, bench, id_col=id_col, text_col=text_col, bench_col=bench_col, longer_than=longer_than)
    return df.join(hits, df[id_col] == hits["_id"], "left_anti")


def chat_sides(messages: Column, *, user: tuple[Column, ...] = (), assistant: tuple[Column, ...] = ()) -> list[Column]:
    """The first filled user and assistant contents of a chat, else the first filled one of the other columns; as ``user`` and ``assistant``."""

    def first(role: str, others: tuple[Column, ...]) -> Column:
        said = F.transform(F.filter(messages, lambda x: F.lower(x["role"]) == role), lambda x: x["content"])
        return F.coalesce(F.try_element_at(F.filter(F.concat(said, F.array(*others).cast("array<string>")), lambda x: x != ""), F.lit(1)), F.lit("")).alias(role)

    return [first("user", user), first("assistant", assistant)]


def contaminated_chats(df: DataFrame, bench: DataFrame, *, id_col: str, user_col: str = "user", assistant_col: str = "assistant", longer_than: int = 50) -> DataFrame:
    """Ids of chats like one of the benchmark, which has the same two columns.

    Alike are chats whose first 500 characters agree on both sides, whose
    user sides are equal, or one of whose user sides holds the other at more
    than ``longer_than`` characters and like lengths. Compared in lower case
    with white space collapsed; null is empty, and an empty user side equals an empty one.
    """
    plain = lambda c: collapse(F.coalesce(F.col(c), F.lit("")))
    chats = df.select(F.col(id_col).alias("_id"), F.col(user_col).alias("_t"), plain(user_col).alias("_n"), F.substring(plain(assistant_col), 1, KEY).alias("_a"))
    known = bench.select(plain(user_col).alias("_b"), F.substring(plain(assistant_col), 1, KEY).alias("_a")).distinct()
    keys = known.select(F.substring("_b", 1, KEY).alias("_u"), "_a").distinct()
    by_key = chats.join(keys, (F.substring("_n", 1, KEY) == F.col("_u")) & (chats["_a"] == keys["_a"]), "left_semi").select("_id")
    items = known.select("_b").distinct()
    by_user = chats.join(items, F.col("_n") == F.col("_b"), "left_semi").select("_id")
    return by_key.union(by_user).union(_alike(chats.select("_id", "_t"), items, longer_than, by_key=False)).distinct()


def first_by_hash(df: DataFrame, *, text_col: str, order_col: str) -> DataFrame:
    """The first row, by ``order_col``, of each different stripped text."""
    hashed = df.withColumn("_sha", F.sha1(F.trim(F.col(text_col))))
    firsts = hashed.groupBy("_sha").agg(F.min(order_col).alias("_first"))
    return hashed.join(firsts, "_sha").where(F.col(order_col) == F.col("_first")).drop("_sha", "_first")
