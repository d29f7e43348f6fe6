"""Near copies for corpora: one row of each group of texts alike in four fifths of their shingles stays.

Candidates come from the SimHash fingerprints of the sets of shingles: those
that the deletion-variant index of ``simhash`` links, by others too, are one
bucket. At a similarity of 0.8, though, ten of the 64 bits differ on average,
and a segment short enough to stay intact would be shared by everyone. So for
the rest the same index is used over a second signature, the least values of
the set of shingles under ``SEGMENTS * LONG`` hash functions: it is cut into
segments, every segment is listed with one value made a wildcard, and an
equality join finds the buckets. In buckets of either kind the exact
similarity of the sets of shingles decides.

A bucket of ``TILE`` members at most is compared in one task, which returns
links that span it; of two sets a bitmap of their hashes tells at once that
they differ in too many, so few are compared in full. The members of a larger
bucket are held against its least one, which settles a family of near copies
at once. What that leaves apart is settled in one step, whatever its size:

* By blocks: the bucket is cut into blocks and every two of them are compared
  in a task of their own, but for those that hold one component only.
* Where that is more work, as for pages with one frame that otherwise differ,
  by rarity: those that are not alike to the least one are listed anew by their
  rarest shingles. Of two sets alike in four fifths, ordered from rare to
  common, the first fifth and one more of either have a shingle in common, so
  the frame that all of them share brings none together and no link is lost. A
  link between a text that is alike to such a hub and one that is not spans at
  most twice the allowed distance from the hub, as Jaccard distances obey the
  triangle inequality: the texts within that reach which nothing has joined
  with the hub's by then are held against all of them that can be near enough.

So the number of steps follows neither the number of texts nor the size of a
family of texts of which few are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.simhash import NEAR, majority
from millrace.llm.simhash import links as fingerprint_links
from millrace.llm.util import SPACE, ascii_lower, checkpoint, fewer, hash_filter, join_hot, let, written

#: Of two texts with a similarity of 0.8, six values agree in all but one or none with 0.655; one segment of five does with 0.995.
SEGMENTS, LONG = 5, 6
_ODD = np.random.default_rng(42).integers(0, 1 << 63, SEGMENTS * LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are hashed with all functions at a time.
STEP = 1 << 15
#: Most members of a bucket that is compared in one task, and half of those of a block of a larger one.
TILE = 256
#: Bits of a set's bitmap.
WIDE = 1024
#: Bitmaps that are compared in the time that a pair of whole sets takes where both are sent.
BRIDGE = 100
#: Signatures that a partition is worth; each is listed ``SEGMENTS * LONG`` times.
SIGNED_EACH = 5_000


@dataclass(frozen=True)
class Alike:
    """words: of a shingle. least: Jaccard similarity of the sets of shingles from which on two texts are near copies. bits: in which two fingerprints may differ to bring texts together, 3 at most."""

    words: int = 5
    least: float = 0.8
    bits: int = NEAR


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set of 64-bit shingle hashes under each hash function; zeros for none."""
    out = np.full(len(_ODD), np.iinfo(np.uint64).max) if len(shingles) else np.zeros(len(_ODD), np.uint64)
    for at in range(0, len(shingles), STEP):
        mixed = shingles[at : at + STEP, None] * _ODD
        out = np.minimum(out, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return out


def _keyed(df: DataFrame) -> DataFrame:
    """The rows as one column, and 128 bits that tell rows apart."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*columns).alias("_row"), F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("r2"))


def _shingles(text: Column, words: int) -> Column:
    """Hashes of the different shingles of a text, made from those of its words; of the whole sequence if shorter."""

    def hashes(own: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(own) - words), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(words)]))
        return F.when(F.size(own) >= words, many).when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.expr("cast(array() as array<bigint>)"))

    parts = F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), lambda w: w != "")
    return F.array_distinct(let(F.transform(parts, lambda w: F.xxhash64(w)), hashes))


def _signed(keyed: DataFrame, id_col: str, text_col: str, alike: Alike) -> DataFrame:
    """doc_id, r1, r2, c1, c2 (which set of shingles), n (its size), fp (its SimHash fingerprint), sig of each row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            c1 = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            c2 = np.array([(s * _ODD[0]).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            sigs = np.array([signature(s) for s in sets], np.uint64).reshape(len(sets), -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, len(_ODD)), pa.int32()), pa.array(sigs.view(np.int64).ravel()))
            fps = pa.array([majority(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), fps, flat], ["doc_id", "r1", "r2", "c1", "c2", "n", "fp", "sig"])

    own = F.col("_row").getField(text_col)
    narrow = keyed.select(F.col("_row").getField(id_col).cast("long").alias("doc_id"), "r1", "r2", _shingles(own, alike.words).alias("h"))
    return narrow.mapInArrow(run, "doc_id long, r1 long, r2 long, c1 long, c2 long, n long, fp long, sig array<long>")


def _listed(kinds: DataFrame) -> DataFrame:
    """cid, key: the one-wildcard variants of every segment."""
    sig = F.col("sig")
    keys = [F.xxhash64(F.lit(s * LONG + p), *[sig[s * LONG + i] for i in range(LONG) if i != p]) for s in range(SEGMENTS) for p in range(LONG)]
    return kinds.where("n > 0").select("cid", F.explode(F.array(*keys)).alias("key"))


def _alike_fingerprints(kinds: DataFrame, bits: int) -> DataFrame:
    """cid, key: the class of each set's fingerprint, by fingerprints that differ in ``bits`` bits at most; classes of one set are left out."""
    some = kinds.where("n > 0")
    cores = kinds.sparkSession.sparkContext.defaultParallelism
    fps = checkpoint(some.groupBy("fp").agg(F.count(F.lit(1)).alias("sets")).repartition(4 * cores))  # each has 64 variants
    classes = fps.join(components(fingerprint_links(fps.select("fp"), bits)).withColumnRenamed("node", "fp"), "fp", "left").where("root is not null or sets > 1")
    return checkpoint(some.select("cid", "fp").join(classes, "fp").select("cid", F.xxhash64(F.lit(-2), F.coalesce("root", "fp")).alias("key")))


def _sets(keyed: DataFrame, wanted: DataFrame, text_col: str, alike: Alike) -> DataFrame:
    """cid, h: the sets of shingles of ``wanted`` (cid, r1, r2); other rows' texts are not shuffled."""
    passes = hash_filter(wanted, "r1")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pa.array(passes(batch.column(0).to_numpy())))

    narrow = keyed.select("r1", "r2", F.col("_row").getField(text_col).cast("string").alias("text"))
    some = narrow.mapInArrow(run, narrow.schema).join(wanted, ["r1", "r2"]).dropDuplicates(["cid"])
    return some.select("cid", _shingles(F.col("text"), alike.words).alias("h"))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set ``WIDE`` bits: whether an odd number of its hashes has that place. Two sets differ in as many hashes at least as their bitmaps in bits."""
    out = np.zeros((len(sets), WIDE // 8), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.packbits(np.bincount(s & (WIDE - 1), minlength=WIDE).astype(np.uint8) & 1)
    return out.view(np.uint64)


def span(ids: list[int], sets: list[np.ndarray], least: float, roots: list[int] | None = None, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all of a few sets that are alike, directly or by others.

    roots: what is known to be joined already. second: which sets are of a second block; then only sets of different blocks are compared.
    """
    found: list[tuple[int, int]] = []
    root, sizes, bits = np.array(ids if roots is None else roots), np.array([len(s) for s in sets]), bitmaps(sets)
    against = np.arange(len(ids)) if second is None else np.flatnonzero(~second)
    for j in range(1, len(ids)) if second is None else np.flatnonzero(second):
        rest = against[:j] if second is None else against
        rest = rest[(root[rest] != root[j]) & (least * np.maximum(sizes[rest], sizes[j]) <= np.minimum(sizes[rest], sizes[j]) + 1e-9)]
        differ = np.bitwise_count(bits[rest] ^ bits[j]).sum(axis=1)
        # Two alike sets differ in at most this share of both their sizes.
        some = np.flatnonzero(differ <= (sizes[rest] + sizes[j]) * ((1 - least) / (1 + least)) + 1e-6)
        for i in rest[some[np.argsort(differ[some], kind="stable")]].tolist():
            if root[i] != root[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                    found.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
    return found


def _different(members: DataFrame) -> DataFrame:
    """key: of buckets with the same members one."""
    same = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("s1"), F.sum(F.col("cid").cast("decimal(20,0)")).alias("s2"))
    return same.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")


def _tiles(members: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """Links of buckets that have ``TILE`` members at most; of buckets with the same members one is compared."""

    def compare(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        got = span(pdf["cid"].tolist(), list(pdf["h"]), alike.least)
        return pd.DataFrame({"u": [u for u, _ in got], "v": [v for _, v in got]}, dtype="int64")

    return members.join(_different(members), "key", "left_semi").join(sets, "cid").groupBy("key").applyInPandas(compare, "u long, v long")


def _parted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, cid, root, rows (of the key), core (its largest component), inside (rows of that); buckets of one component are left out."""
    rooted = checkpoint(members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("root", "cid").alias("root")))
    most = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "root")).alias("most"))
    parts = most.where("rows > most.n").select("key", "rows", F.col("rows").alias("_rows"), F.col("most.root").alias("core"), F.col("most.n").alias("inside"))
    return join_hot(rooted, parts, "key", rows="_rows", total=max(1, rooted.count()))


def _blocks(parted: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """Links of buckets of any size, as ``_parted`` gives them: every two blocks are compared in one task, unless both are of the core."""
    each = 2 * TILE
    outer, inner = (F.ceil(c / each).cast("int") for c in (F.col("rows") - F.col("inside"), F.col("inside")))
    outer, is_core = F.when(F.col("rows") <= each, 1).otherwise(outer), (F.col("rows") > each) & (F.col("root") == F.col("core"))
    own = F.when(is_core, outer + F.pmod(F.xxhash64("cid"), inner)).otherwise(F.pmod(F.xxhash64("cid"), outer)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_core | (F.col("rows") <= each), outer).otherwise(outer + inner) - 1))
    dealt = parted.select("key", "cid", "root", own.alias("own"), other.alias("other"))
    dealt = dealt.select("key", "cid", "root", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        a, b, block = pdf["a"].iloc[0], pdf["b"].iloc[0], pdf["own"].to_numpy()
        got = span(pdf["cid"].tolist(), list(pdf["h"]), alike.least, pdf["root"].tolist(), block == b if a != b else None)
        return pd.DataFrame({"u": [u for u, _ in got], "v": [v for _, v in got]}, dtype="int64")

    return dealt.join(sets, "cid").groupBy("key", "a", "b").applyInPandas(compare, "u long, v long")


def _rarest(cids: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """key, cid: the rarest shingles of each set, as many as two alike sets need to have one in common; those of one set alone are left out."""
    listed = sets.join(cids, "cid", "left_semi").select("cid", F.size("h").alias("n"), F.explode("h").alias("t"))
    often = checkpoint(listed.groupBy("t").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("df", F.col("rows")))
    total = often.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not total:
        return listed.select(F.col("t").alias("key"), "cid").limit(0)
    ordered = join_hot(listed, often, "t", rows="rows", total=total).groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    alone = F.col("n") - F.size("ts")
    wanted = (F.col("n") - F.ceil(alike.least * F.col("n") - 1e-9) + 1 - alone).cast("int")
    return ordered.where(wanted > 0).select(F.explode(F.slice("ts", F.lit(1), wanted)).alias("x"), "cid").select(F.xxhash64(F.lit(-1), "x.t").alias("key"), "cid")


def links(kinds: DataFrame, keyed: DataFrame, text_col: str, alike: Alike) -> DataFrame | None:
    """(u, v) of different sets of shingles that are alike, spanning; None if no bucket has two members."""
    n_kinds = kinds.count()
    kinds = fewer(kinds, n_kinds, SIGNED_EACH)
    classes = _alike_fingerprints(kinds, alike.bits)
    n_classes = classes.count()
    classes = fewer(classes, n_classes)
    listed = _listed(kinds).unionByName(classes)
    buckets = checkpoint(listed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    if not (n_buckets := buckets.count()):
        return None
    members = checkpoint(join_hot(listed, fewer(buckets, n_buckets), "key", rows="rows", total=SEGMENTS * LONG * n_kinds + n_classes).select("key", "cid"))
    members = fewer(members, members.count())
    wanted = kinds.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "k.r1", "k.r2")
    sets = written(_sets(keyed, checkpoint(wanted), text_col, alike))
    hubs = members.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("rows"))
    found = checkpoint(_tiles(members.join(hubs.where(F.col("rows") <= TILE), "key", "left_semi"), sets, alike))
    large = checkpoint(hubs.where(F.col("rows") > TILE))
    return found if large.isEmpty() else _settled(found, members, large, sets, alike)


def _settled(found: DataFrame, members: DataFrame, large: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """``found``, and links of the ``large`` buckets (key, hub, rows), in a number of steps that does not follow their size."""
    is_alike = F.col("sim") >= alike.least - 1e-9
    members = checkpoint(join_hot(members, large, "key", rows="rows", total=max(1, members.count())))
    n_members = members.count()
    members = fewer(members, n_members)
    new = checkpoint(members.where("cid <> hub").select("cid", "hub").distinct())
    n_new = new.count()
    # A hub of many pairs is one of few: its set goes to every task, whatever the number of its pairs.
    each = new.groupBy("hub").agg(F.count(F.lit(1)).alias("rows")).join(sets.select(F.col("cid").alias("hub"), F.col("h").alias("h2")), "hub")
    both = join_hot(new.join(sets, "cid"), each, "hub", rows="rows", total=max(1, n_new), parts=64)
    common = F.size(F.array_intersect("h", "h2"))
    tested = fewer(checkpoint(both.select("cid", "hub", (common / (F.size("h") + F.size("h2") - common)).alias("sim"))), n_new)
    found = checkpoint(found.unionByName(tested.where(is_alike).select(F.col("cid").alias("u"), F.col("hub").alias("v"))))
    one = members.join(_different(members), "key", "left_semi")
    parted = checkpoint(_parted(one.select("key", "cid"), checkpoint(components(found))))
    if not (n_parted := parted.count()):
        return found
    parted = fewer(parted, n_parted)
    # Pairs to compare: by blocks, and where rare shingles list those anew that are not alike to their hub.
    apart = checkpoint(members.join(parted.select("key").distinct(), "key", "left_semi").join(tested.where(~is_alike), ["cid", "hub"], "left_semi").select("key", "cid"))
    anew = checkpoint(_rarest(apart.select("cid").distinct(), sets, alike))
    many = checkpoint(anew.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    anew = checkpoint(join_hot(anew, many.join(_different(anew), "key", "left_semi").withColumn("n", F.col("rows")), "key", rows="rows", total=max(1, anew.count())))
    share = apart.groupBy("cid").agg(F.count(F.lit(1)).alias("buckets")).join(anew.groupBy("cid").agg(F.sum("n").alias("pairs")), "cid").select("cid", (F.col("pairs") / F.col("buckets")).alias("pairs"))
    rarely = apart.join(share, "cid", "left").groupBy("key").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    past = tested.groupBy("hub").agg((BRIDGE * F.count_if(is_alike) * F.count_if(~is_alike & (F.col("sim") >= 2 * alike.least - 1 - 1e-9))).alias("past"))
    blocks = parted.select("key", "rows", "inside").distinct().join(rarely, "key").join(large.select("key", "hub"), "key").join(past, "hub")
    blocks = checkpoint(blocks.select("key", (F.col("pairs") + F.col("past") >= F.col("rows") * (F.col("rows") - F.col("inside"))).alias("whole")))
    found = checkpoint(found.unionByName(_blocks(parted.join(blocks.where("NOT whole"), "key", "left_anti"), sets, alike)))
    listed = blocks.where("NOT whole").select("key")
    if listed.isEmpty():
        return found
    cids = apart.join(listed, "key", "left_semi").select("cid").distinct()
    anew = anew.join(cids, "cid", "left_semi").select("key", "cid")
    found = checkpoint(found.unionByName(_blocks(checkpoint(_parted(anew, checkpoint(components(found)))), sets, alike)))
    hubs = large.join(listed, "key", "left_semi").select("hub").distinct()
    return _bridged(found, tested.join(hubs, "hub", "left_semi"), sets, alike)


def _bridged(found: DataFrame, tested: DataFrame, sets: DataFrame, alike: Alike) -> DataFrame:
    """``found``, and the links between texts alike to a hub (cid, hub, sim in ``tested``) and texts that are not, where ``found`` joins them in no way."""
    reach = tested.where((F.col("sim") < alike.least - 1e-9) & (F.col("sim") >= 2 * alike.least - 1 - 1e-9))
    if reach.isEmpty():
        return found
    roots = components(found)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = reach.join(root("cid"), "cid", "left").join(root("hub"), "hub", "left").where(F.coalesce("cid_root", "cid") != F.coalesce("hub_root", "hub"))
    apart = checkpoint(apart.select(F.col("cid").alias("v"), "hub", F.col("sim").alias("far")))
    if apart.isEmpty():
        return found
    near = tested.where(F.col("sim") >= alike.least - 1e-9).select(F.col("cid").alias("u"), "hub", "sim")
    # Two distances from the hub differ by no more than the texts are apart.
    pairs = near.join(apart, "hub").where(F.col("sim") - F.col("far") <= 1 - alike.least + 1e-9).select("u", "v").distinct()
    sized = sets.select("cid", F.size("h").alias("n"))
    like = F.least("n", "n2") >= alike.least * F.greatest("n", "n2") - 1e-9
    pairs = pairs.join(sized.withColumnRenamed("cid", "u"), "u").join(sized.select(F.col("cid").alias("v"), F.col("n").alias("n2")), "v").where(like)
    both = pairs.join(sets.select(F.col("cid").alias("u"), "h"), "u").join(sets.select(F.col("cid").alias("v"), F.col("h").alias("h2")), "v")
    common = F.size(F.array_intersect("h", "h2"))
    return found.unionByName(both.where(common >= alike.least * (F.col("n") + F.col("n2") - common) - 1e-9).select("u", "v"))


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alike: Alike | None = None) -> DataFrame:
    """r1, r2 (128 bits of a row), copies (equal rows), kept: of each group of near copies the row of least id is kept.

    Similarity is closed transitively. Texts without words are copies of each
    other; shorter ones than a shingle are one shingle. Null ids come last.
    """
    alike = alike or Alike()
    keyed = _keyed(df)
    signed = written(_signed(keyed, id_col, text_col, alike))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2"))
    kinds = checkpoint(signed.groupBy("c1", "c2", "n").agg(F.first("fp").alias("fp"), F.first("sig").alias("sig"), least.alias("k")).select(F.xxhash64("c1", "c2", "n").alias("cid"), "c1", "c2", "n", "fp", "sig", "k"))
    found = links(kinds, keyed, text_col, alike)
    rooted = kinds.select("cid", "k", F.col("cid").alias("root"))
    if found is not None:
        roots = components(found).withColumnRenamed("node", "cid")
        rooted = kinds.select("cid", "k").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    keepers = rooted.groupBy("root").agg(F.min("k").alias("k")).select("k.r1", "k.r2", F.lit(True).alias("kept"))
    rows = signed.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(keepers, ["r1", "r2"], "left").select("r1", "r2", "copies", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alike: Alike | None = None) -> DataFrame:
    """The input less all but one row of each group of near copies.

    A row is told apart by all its columns, so rows that share an id are
    decided each by their own text, rows with a null id too; of equal rows one
    stays. Null and empty texts are copies of each other. Whole texts are
    compared, however long. Columns may have any name, but no map type. An
    empty table gives an empty one.
    """
    marks = checkpoint(groups(df, id_col=id_col, text_col=text_col, alike=alike))
    gone = marks.where("NOT kept").select("r1", "r2")
    twice = marks.where("kept AND copies > 1").select("r1", "r2")
    left = _keyed(df).join(gone, ["r1", "r2"], "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, ["r1", "r2"], "left_anti").unionByName(left.join(twice, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]))
    return left.select("_row.*")
