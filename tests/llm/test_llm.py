"""The operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [(None, "a null id"), (9001, None), (9002, ""), (9003, " \t\n "), (9004, "x" * 30_000), (9005, "same text here"), (9006, "same text here"), (9006, "same text here"), (9007, "é😀 mail a.b@c.d_e@f.gg 1.2.3.4.5 +1 (988) 555-2485 and 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    clash = real.union(odd).withColumns({c: F.lit(1) for c in ("score", "fp", "length", "ids", "key", "pos", "n_lines", "base", "spans", "h")})
    return clash.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sentencepiece_parity_and_round_trip(docs, rows, empty):
    import sentencepiece

    from millrace.llm import spiece

    path = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = spiece.decode(spiece.encode(docs, path), path).collect()
    want = sorted((str(d), own.encode(t or ""), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == want
    assert all(r.parity for r in got)
    assert spiece.encode(empty, path).count() == 0


@pytest.mark.parametrize(("kind", "spaces", "exact"), [(1, False, True), (1, True, True), (1, False, False), (2, False, True)])
def test_sentencepiece_of_either_model_type(tmp_path, rows, kind, spaces, exact):
    """The public pieces as a unigram model, or as the BPE model that they are; scores that single precision holds exactly, or not."""
    import sentencepiece

    from millrace.llm import spiece

    proto = spiece.parse(P.path("piece_bpe_32k.model"))
    proto.trainer_spec.model_type = kind
    proto.normalizer_spec.remove_extra_whitespaces = spaces
    if kind == 1:
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                p.score = -(8 + i // 64 / 64) if exact else -float(np.log(i + 10))
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, own, back = sentencepiece.SentencePieceProcessor(model_file=path), spiece.Codec(path), spiece.Decoder(path)
    rng = random.Random(3)
    odd = ["<s>", "</s>", "<unk>", "<0x41>", "a<0x0A>b", " ", "▁", "é\u0301", "😀 한국어", "\x00\t", "  two  blanks ", "x\n\ny", "\ufffd", "1,000.5!"]
    many = odd + ["".join(rng.choice([*odd, "word ", "the", " of", "ß", "#"]) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    many += [t for _, t in rows if t and len(t) < 20_000]
    got, want = own.encode(many), [library.encode(t) for t in many]
    differ = [t for t, (ids, _), w in zip(many, got, want, strict=True) if np.frombuffer(ids, "<u4").tolist() != w]
    if exact:
        assert not differ and all(same for _, same in got)
    else:  # only where the scores of both are the same in single precision
        score = lambda ids: sum(proto.pieces[i].score for i in ids)
        assert len(differ) < 0.02 * len(many)
        assert all(abs(score(library.encode(t)) - score(np.frombuffer(own.encode([t])[0][0], "<u4").tolist())) < 1e-5 * abs(score(library.encode(t))) for t in differ)
    assert all(back.decode(np.array(w, "<u4").tobytes()) == library.decode(w) for w in want)


def test_packing_is_exact_and_tight(docs, rows, empty):
    from tokenizers import Tokenizer

    from millrace.llm import packing

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[d, n, at, len(part) // 4, zlib.crc32(part)] += 1
    placed = packing.pack(packing.pieces(docs, path)).cache()
    got = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048 and len(room) <= 1.02 * sum(room.values()) / 2048 + 1
    whole = packing.sequences(placed).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in whole} == room
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_plan_uses_up_any_histogram():
    from millrace.llm.packing import plan

    rng = np.random.default_rng(1)
    for _ in range(20):
        h = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 20), rng.integers(1, 50, 20), strict=True)}
        used = Counter()
        for pattern, n in plan(h, 64):
            assert sum(k * m for k, m in pattern.items()) <= 64
            for k, m in pattern.items():
                used[k] += n * m
        assert used == h


def test_fixity_finds_changed_missing_and_extra(spark):
    from millrace.llm import fixity

    pages = spark.createDataFrame([(i, f"http://h/{i}", "body %d" % i) for i in range(300)] + [(None, None, None), (7, "http://h/7", "again")], "page_id long, url string, html string")
    a = fixity.records(pages, id_col="page_id", url_col="url", body_col="html", per_file=100)
    assert fixity.audit(a, a).count() == 0
    b = a.withColumn("digest", F.when((F.col("file") == 1) & (F.col("seq") == 50), "bad").otherwise(F.col("digest"))).where("NOT (file = 2 AND seq = 3)")
    got = {(r.level, r.file, r.idx, r.state) for r in fixity.audit(a, b, fanout=4).collect()}
    assert {g for g in got if g[0] == 0} == {(0, 1, 50, "changed"), (0, 2, 3, "missing")}
    assert {(r.file, r.idx, r.state) for r in fixity.audit(b, a).where("level = 0").collect()} == {(1, 50, "changed"), (2, 3, "extra")}
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    assert fixity.replica_root(fixity.tree(a)[-1]) == fixity.replica_root(fixity.tree(a)[-1]) != fixity.replica_root(fixity.tree(b)[-1])


def test_warc_reader_covers_the_file(spark, tmp_path):
    from millrace.llm import fixity

    record = b"WARC/1.0\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3 + b"junk")
    got = fixity.read_warc(spark, str(tmp_path / "a.warc")).orderBy("seq").collect()
    assert [(r.start, r.end) for r in got] == [(i * len(record), (i + 1) * len(record)) for i in range(3)] + [(3 * len(record), 3 * len(record) + 4)]
    assert got[0].digest == hashlib.sha256(record).hexdigest()
    import gzip

    members = [gzip.compress(record * n) for n in (1, 9000, 2)]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members) + b"junk")
    (tmp_path / "c.warc.gz").write_bytes(members[0] + members[1][:40])
    got = fixity.read_warc(spark, str(tmp_path / "b.warc.gz")).orderBy("seq").collect()
    assert [r.end - r.start for r in got] == [*map(len, members), 4] and got[1].digest == hashlib.sha256(members[1]).hexdigest()
    assert [r.end - r.start for r in fixity.read_warc(spark, str(tmp_path / "c.warc.gz")).orderBy("seq").collect()] == [len(members[0]), 40]


def test_cover_tree_is_exact(spark):
    from millrace.llm.covertree import top_k

    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(150)]
    vectors.append((3000, [0.1, 0.2]))
    bad = [(2000, None), (2001, [float("nan")] * 8), (2002, [1.0, None, *[0.0] * 6]), (2003, [float("inf")] * 8), (None, [1.0] * 8), (100, vectors[100][1])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "v", "block", "cell", "query_id", "score")})
    got = top_k(df, df.where("vec_id % 50 = 0"), block=64, group=4, pivots=6).collect()
    q = {i: np.floor(256 * np.array([*v, *[0.0] * (8 - len(v))], np.float32).astype(float)).astype(int) for i, v in vectors}
    want = {(i, n + 1, j, s) for i in q if i % 50 == 0 for n, (s, j) in enumerate((-s, j) for s, j in sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5])}
    assert {tuple(r) for r in got} == want
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def _clusters(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, width)) * 400
    return np.floor(centers[rng.integers(0, 20, n)] + rng.normal(size=(n, width)) * 12)


@pytest.mark.parametrize("rows", [_clusters(1500, 16, 1), np.floor(np.random.default_rng(2).normal(size=(700, 64)) * 50), np.ones((90, 3)), np.zeros((1, 4))])
def test_cover_tree_covers_nests_and_separates(rows):
    from millrace.llm.covertree import BASE, LEAF, CoverTree

    t = CoverTree(rows, np.arange(len(rows)))
    assert sorted(t.ids.tolist()) == list(range(len(rows))) and np.array_equal(t.rows, rows[t.ids])
    for i in range(len(t.at)):
        own = t.rows[t.start[i] : t.end[i]]
        far = np.sqrt(((own - t.center[i]) ** 2).sum(axis=1))
        assert t.start[i] <= t.at[i] < t.end[i] and far.max() <= t.radius[i] + 1e-6
        kids = t.kids[i]
        if not kids:
            assert len(own) <= LEAF or t.radius[i] == 0
            continue
        assert far.max() <= BASE ** t.level[i] + 1e-6 and t.at[kids[0]] == t.at[i]  # covered by its level; nested
        assert [(t.start[a], t.end[a]) for a in kids] == list(zip([t.start[i], *[t.end[a] for a in kids[:-1]]], [t.end[a] for a in kids], strict=True))
        apart = np.sqrt(((t.center[kids][:, None] - t.center[kids][None]) ** 2).sum(axis=2))
        assert apart[~np.eye(len(kids), dtype=bool)].min(initial=np.inf) > BASE ** (t.level[i] - 1) - 1e-6
        assert all(t.radius[a] <= BASE ** (t.level[i] - 1) + 1e-6 for a in kids)


@pytest.mark.parametrize(("rows", "most"), [(_clusters(4000, 16, 3), 0.5), (np.floor(np.random.default_rng(4).normal(size=(800, 64)) * 50), 1.0)])
def test_dual_tree_search_is_exact_and_prunes(rows, most):
    from millrace.llm.covertree import CoverTree, Search

    n = len(rows) // 10
    found = Search(CoverTree(rows[:n], np.arange(n)), CoverTree(rows, np.arange(len(rows))), 5)
    got = {}
    for q, i, s in found.found():
        got.setdefault(q, []).append((-s, i))
    scores = (rows[:n] @ rows.T).astype(int)
    assert all(got[q] == sorted((-int(s), i) for i, s in enumerate(scores[q]))[:5] for q in range(n))
    assert found.products <= most * n * len(rows)


def _fp(text, k=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash_components(spark, docs, rows, tile):
    from millrace.llm import simhash

    rng = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog and runs away from here".split() * 4
    near = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        near.append((5000 + i, " ".join(words)))
    small = [r for r in rows if r[1] is None or len(r[1]) < 3000] + near
    fps = [_fp(t) for _, t in small]
    kinds = sorted(set(fps))
    root = {k: k for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(small, fps, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    want = sorted((str(d), f"{f:016x}", str(least.get(find(f)))) for (d, _), f in zip(small, fps, strict=True))
    got = simhash.near_duplicates(spark.createDataFrame(small, "doc_id long, text string"), tile=tile)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want


def test_simhash_buckets_of_split_partitions(spark):
    """A bucket is compared whole even where Spark splits the partition that a join has dealt it to."""
    from millrace.llm import simhash
    from millrace.llm.components import components

    split = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in split}
    listed = spark.range(0, 2000, 1, 8).select(F.lit(7).cast("long").alias("k1"), F.col("id").alias("fp")).union(spark.range(300).select("id", (F.col("id") * 2**40).alias("fp")).where("id <> 7"))
    more = spark.range(300).select(F.col("id").alias("k1"), F.lit(3).alias("n"))
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        found = simhash._compare(listed.join(more, "k1"), ["k1"], 3).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    roots = {r.node: r.root for r in components(spark.createDataFrame(found, "u long, v long")).collect()}
    assert roots == dict.fromkeys(range(2000), 0)


@pytest.mark.parametrize("tile", [256, 2])
def test_near_copies_against_brute_force(spark, docs, rows, monkeypatch, tile):
    from millrace.llm import near_copies
    from millrace.llm.near_copies import keep_one

    monkeypatch.setattr(near_copies, "TILE", tile)

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 120, 200, 400, 80) for _ in range(8)]
    made = []
    for b, words in enumerate(base):
        for j in range(6):
            w = list(words)
            for _ in range(max(1, len(w) * rng.choice([1, 2, 3, 5, 9]) // 150)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            made.append((1000 * (j + 1) + b, " ".join(w)))
    for c in range(12):  # chains, of which only neighbours are alike
        words = [rng.choice(vocabulary) for _ in range(130)]
        made += [(9000 + 10 * c + j, " ".join(words[8 * j : 100 + 8 * j])) for j in range(4)]
    made += [(None, made[0][1] + " tail"), (7, "short text"), (8, "Short  text"), (9, None), (10, ""), (10, ""), (11, "a b c d e"), (11, "e d c b a")]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_pairs = 0
    for i in range(len(made)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                n_pairs += sets[i] != sets[j]
    least = {}
    for i, (d, t) in enumerate(made):
        r = find(i)
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    df = spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("r1", "cid", "n", "sig", "kept", "_gone")})
    got = keep_one(df).collect()
    assert n_pairs > 50 and got[0].asDict().keys() == set(df.columns)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(None if none else d) for none, d in least.values())
    assert keep_one(df.limit(0)).count() == 0
    if tile == 2:
        return
    odd = keep_one(docs.select("doc_id", "text"))
    assert odd.where("doc_id in (9005, 9006)").count() == 1 and odd.where("doc_id in (9001, 9002, 9003)").count() == 1


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """Near copies are found by SimHash fingerprints alone where the least values list nothing, and unlike texts of one fingerprint class stay."""
    from millrace.llm import near_copies

    words = [f"w{i}" for i in range(400)]
    made = [(i, " ".join(words[:399] + [f"end{i}"])) for i in range(1, 5)] + [(9, " ".join(reversed(words)))]
    made += [(20 + i, " ".join(f"{i}x{j}" for j in range(50))) for i in range(3)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    fps = [near_copies.majority(np.unique(np.array(h, np.int64))) for h, in df.where("doc_id < 5").select(near_copies._shingles(F.col("text"), 5)).collect()]
    assert len(set(fps)) > 1 and all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a in fps for b in fps[:1])
    monkeypatch.setattr(near_copies, "_listed", lambda kinds: kinds.select("cid", F.col("cid").alias("key")))
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [1, 9, 20, 21, 22]
    monkeypatch.setattr(near_copies, "majority", lambda hashes: 5)  # one class of all: the shingles decide
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [1, 9, 20, 21, 22]


def test_links_past_a_hub(spark):
    from millrace.llm import near_copies

    rng = random.Random(3)
    whole = list(range(1000, 1300))
    sets = {0: set(whole[:100])} | {i: set(whole[s : s + 100]) for i in range(1, 60) for s in [rng.randrange(45)]}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    tested = [(i, 0, sim(i, 0)) for i in range(1, 60)]
    found = [(i, 0) for i, _, s in tested if s >= 0.8]
    table = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "cid long, h array<long>")
    got = near_copies._bridged(spark.createDataFrame(found, "u long, v long"), spark.createDataFrame(tested, "cid long, hub long, sim double"), table, near_copies.Alike()).collect()
    alike = {u for u, _ in found}
    want = {(u, v) for u in alike for v in range(1, 60) if v not in alike and sim(u, v) >= 0.8}
    assert want and {tuple(r) for r in got} - set(found) == want


def test_components_of_a_long_path(spark):
    from millrace.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (7, None)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_few_edges_take_few_jobs(spark):
    """Each job costs the driver memory; edges that are worth one partition take no rounds."""
    from millrace.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    spark.sparkContext.setJobGroup("few-edges", "")
    try:
        got = dict(components(edges).collect())
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got == dict.fromkeys(range(41), 0)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 10


@pytest.mark.parametrize(("each", "kind"), [(50_000, "long"), (100, "long"), (7, "long"), (100, "string")])
def test_components_of_edges_joined_in_parts(spark, each, kind):
    from millrace.llm.components import components

    rng = random.Random(9)
    pairs = [(i, i + rng.randrange(1, 3)) for i in range(0, 300, 2)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(-(2**63), 2**63 - 1), (2000, 2000), (2001, None)]
    pairs += [(1000, 1001 + i) for i in range(150)]  # a star
    node = {"long": lambda x: x, "string": lambda x: None if x is None else f"{x:05d}"}[kind]
    pairs = [(node(u), node(v)) for u, v in pairs]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    rows = components(spark.createDataFrame(pairs, f"u {kind}, v {kind}").repartition(5), each=each).collect()
    assert len(rows) == len(root) and dict(rows) == {x: find(x) for x in root}


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_pii_base_spans_and_redaction(docs, rows, empty):
    from millrace.llm import pii

    want = []
    for d, t in rows:
        spans = sorted((m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(KINDS[k], t or "") if _valid(k, m[0]))
        want.append((str(d), ",".join(f"{list(KINDS)[i]}:{a}:{b}" for a, i, b in spans)))
    found = pii.find(docs).select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()
    assert sorted((str(r.doc_id), r.base) for r in found) == sorted(want)
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in found)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "[EMAIL]" in clean[9007] and "988" not in clean[9007] and clean[9001] == ""
    assert all(clean[d] == t for d, t in rows if d is not None and d < 9000 and not next(r.spans for r in found if r.doc_id == d))
    assert pii.find(empty).count() == 0


def test_pii_finds_what_no_rule_finds(spark):
    from millrace.llm import pii

    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "5" + digits(14)
        return next(body + c for c in "0123456789" if _valid("card", body + c))

    def cut(x, by):
        return by.join(x[i : i + 4] for i in range(0, 16, 4))

    name = lambda: "".join(rng.choice("abcdefgklmnorst") for _ in range(6))
    hidden = [f"{name()}.{name()} at {name()} dot example dot org" for _ in range(15)] + [f"{name()} [at] {name()}.example.net" for _ in range(15)]
    hidden += [f"({digits(3)}) 555-{digits(4)}" for _ in range(15)] + [f"{digits(3)}.{digits(3)}.{digits(4)}" for _ in range(15)]
    hidden += [cut(card(), by) for by in "./_" for _ in range(8)]
    hidden += ["[.]".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(15)]
    hidden += ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(15)] + [f"api_key: {name()}{digits(9)}{name()}" for _ in range(10)]
    clean = [f"order {digits(3)}-{digits(3)}-{digits(4)}" for _ in range(20)] + [f"it was at {name()}.Then they" for _ in range(20)] + [f"version {rng.randrange(300, 900)}.{rng.randrange(300, 900)}.1.2" for _ in range(20)]
    clean += [f"commit {''.join(rng.choice('0123456789abcdef') for _ in range(40))}" for _ in range(20)] + [f"{digits(2)}.{digits(3)}.{digits(3)} people" for _ in range(20)] + ["12:30:45:10", "Licensed under CC BY-NC 4.0.", "the year 2024 and 1,000,000 more"]
    clean += [next(x for x in (cut("5" + digits(15), ".") for _ in range(50)) if not _valid("card", x)) for _ in range(20)]
    rows = [(i, f"some words before {x} and some behind") for i, x in enumerate(hidden)] + [(1000 + i, f"some words before {x} and some behind") for i, x in enumerate(clean)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[i].base for i, _ in enumerate(hidden))
    hits, wrong = sum(bool(found[i].spans) for i, _ in enumerate(hidden)), sum(bool(found[1000 + i].spans) for i, _ in enumerate(clean))
    assert hits >= 0.9 * len(hidden) and hits >= 0.95 * (hits + wrong), ([x for i, x in enumerate(hidden) if not found[i].spans], [x for i, x in enumerate(clean) if found[1000 + i].spans])


def test_tree_sql_equals_apply(spark):
    from millrace.llm.boosting import boost, threshold

    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (400, 4))
    y = ((x[:, 0] > 2) ^ (x[:, 1] == 1)).astype(float)
    model = boost(x, np.ones(400), y, 20, 3)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], "a int, b int, c int, d int")
    assert np.allclose([r[0] for r in df.selectExpr(model.sql(list("abcd"))).collect()], model.margin(x), atol=1e-6)
    assert ((model.margin(x) > 0) == (y > 0)).mean() > 0.98
    assert threshold(np.array([1.0, 2.0, 3.0]), np.ones(3), np.array([0.0, 1.0, 1.0]), 0.9) == pytest.approx(1.5)


def test_pii_redacts_overlapping_and_adjacent_spans(spark):
    from millrace.llm import pii

    rows = [(1, "a@b.cc a@b.cc"), (2, "1.2.3.4@b.cc"), (3, "+1 (988) 555-2485+1 (988) 555-2485"), (4, None), (4, None), (None, "a@b.cc"), (5, "x " * 40_000 + "a@b.cc " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("s"), "base": F.lit("b")})
    got = pii.redact(df, keep=("text", "spans", "doc_id"))
    assert got.columns == ["text", "spans", "doc_id"]
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert out[1] == ["[EMAIL] [EMAIL]"] and out[2] == ["[EMAIL]"] and out[3] == ["[PHONE][PHONE]"] and out[4] == ["", ""] and out[None] == ["[EMAIL]"]
    assert out[5] == ["x " * 40_000 + "[EMAIL] " * 3000]


def test_line_templates(spark):
    from millrace.llm.templates import Tree, drop_templates

    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(i, f"own line {chr(97 + i)} alone\n{passage}\npage {i} of 40\nposted in the public garden by {chr(97 + i) * 3} today\n\n") for i in range(24)]
    rows += [(100, None), (101, ""), (None, "only here"), (102, "twice\ntwice"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = {}
    for r in drop_templates(df).collect():
        got.setdefault(r.doc_id, r)
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 24):
        assert got[i].text == f"own line {chr(97 + i)} alone\n\n" and got[i].n_dropped == 3
    assert got[100].text is None and got[101].text == "" and got[102].text == "twice\ntwice" and got[None].text == "only here"
    assert drop_templates(df.limit(0)).count() == 0
    assert drop_templates(df, tree=Tree(docs_short=1000, docs_long=1000)).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_templates_count_documents(spark):
    from millrace.llm.templates import drop_templates

    def dropped(lines):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "template", "rows", "first", "n", "_drop")})
        got = drop_templates(df)
        assert got.columns[:2] == ["doc_id", "text"]
        return {r.doc_id for r in got.where("n_dropped > 0").collect()}

    named = lambda names, each: [f"posted in the public garden by {'abcdefghijk'[i % names] * 3} today" for i in range(names * each)]
    assert dropped(named(9, 9)) == set(range(1, 81))
    assert len(dropped(named(5, 6))) == 29
    assert dropped(named(3, 3)) == set()
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    one = [" ".join([*words[:p], "other", *words[p + 1 :]]) for p in (10, 40)]
    assert dropped([" ".join(words), *one]) == {1, 2}
    assert dropped([one[0], " ".join([*words[:8], "two", *words[9:]])]) == {1}
    assert dropped([" ".join(words), " ".join([*words[:20], *reversed(words[20:])])]) == set()
    assert dropped(["y " * 300_000, "y " * 300_000]) == {1}
    tie = spark.createDataFrame([(4, " ".join(words)), (4, " ".join(words) + " more"), (5, " ".join(words))], "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in drop_templates(tie).collect()} == {(4, 0), (5, 1)}


def test_line_templates_with_common_field_values(spark):
    """However many documents have each value of a field, a template leaves one line; prose of the same shape stays."""
    from millrace.llm.templates import drop_templates

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    names, towns, prose = [word() for _ in range(100)], [word() for _ in range(100)], [word() for _ in range(400)]
    of = {
        "ten": [f"this article was written by {names[i % 10]} from {towns[i // 10]} today" for i in range(100)],
        "hundred": [f"that entry here stands under {names[i % 100]} since {towns[i // 100]} closed" for i in range(10_000)],
        "one": [f"the shop offers since long ago only {word()}{i} and {names[0]} to friends" for i in range(2000)],
        "two in a leaf": [f"our page shows {('all of', 'none for')[i % 2]} {names[i % 7]} {('beside the road', 'under a bridge')[i // 7 % 2]}" for i in range(300)],
    }
    rows = [(n, line) for n, line in enumerate(x for lines in of.values() for x in lines)]
    clean = [" ".join(["we think that", *rng.choices(prose, k=6)]) for _ in range(3000)]
    rows += [(100_000 + i, x) for i, x in enumerate(clean)]
    got = {r.doc_id: r.n_dropped for r in drop_templates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    at = 0
    for kind, lines in of.items():
        left = [d for d in range(at, at + len(lines)) if not got[d]]
        assert len(left) <= (4 if kind == "two in a leaf" else 1), (kind, len(left))
        at += len(lines)
    assert not any(got[100_000 + i] for i in range(3000))


def test_line_templates_against_brute_force(spark):
    from millrace.llm.templates import FIELD, Tree, drop_templates, parse

    rng, tree = random.Random(9), Tree(long_tokens=8, docs_short=4, docs_long=2)
    pool = [" ".join(rng.choice("abcd") + rng.choice("xyz") for _ in range(n)) for n in (4, 4, 5, 6, 9, 9, 10) for _ in range(5)]
    rows = []
    for i in range(120):
        lines = []
        for x in rng.choices(pool, k=rng.randint(1, 4)):
            t = x.split()
            if rng.random() < 0.5:
                t[rng.randrange(3, len(t))] = rng.choice(["one", "two", "three", "5", "66"])
            lines.append(" ".join(t))
        rows.append((i, "\n".join(lines)))
    docs = {}
    for i, text in rows:
        for x in text.split("\n"):
            docs.setdefault(tuple(parse(x.encode())), set()).add(i)
    leaf = lambda t: (len(t), t[: tree.depth])
    least = lambda t: tree.docs_long if len(t) >= tree.long_tokens else tree.docs_short
    at = Counter()
    for t, d in docs.items():
        for p, x in enumerate(t):
            if x != FIELD:
                at[leaf(t), p, x] += len(d)
    groups = {}
    for t, d in docs.items():
        groups.setdefault((t, least(t)), []).append(t)
        everyone = sum(len(docs[o]) for o in docs if leaf(o) == leaf(t))
        for halved in range(1, tree.shares + 2):
            least_docs = max(tree.docs_short, everyone / 2**halved if halved <= tree.shares else 0)
            fixed = tuple((p, x) for p, x in enumerate(t) if x != FIELD and at[leaf(t), p, x] >= least_docs)
            behind = sum(p >= tree.depth for p, _ in fixed)
            ok = behind >= tree.constant * (len(t) - tree.depth) and len(t) > tree.depth if halved <= tree.shares else len(fixed) >= tree.constant * len(t)
            if ok and t not in groups.setdefault((leaf(t), fixed, tree.docs_short), []):
                groups[leaf(t), fixed, tree.docs_short].append(t)
        if len(t) >= tree.long_tokens:
            for j in range(tree.runs):
                a, b = (tree.depth + (len(t) - tree.depth) * x // tree.runs for x in (j, j + 1))
                groups.setdefault((leaf(t), j, t[:a], t[b:], tree.docs_long), []).append(t)
    first = {}
    for g, members in groups.items():
        ids = set().union(*(docs[t] for t in members))
        if len(ids) >= g[-1]:
            for t in members:
                first[t] = min(first.get(t, min(ids)), min(ids))
    want = {i: "\n".join(x for x in text.split("\n") if first.get(tuple(parse(x.encode())), i) == i) for i, text in rows}
    got = {r.doc_id: r.text for r in drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), tree=tree).collect()}
    assert got == want and any(want[i] != text for i, text in rows)


def test_toxicity_index_is_exact_and_learns(spark):
    from millrace.llm.toxicity import Index, toxicity

    rng = np.random.default_rng(3)
    examples = []
    for i in range(300):
        v = {int(t): float(w) for t, w in zip(rng.choice(40, 4, replace=False), rng.random(4), strict=True)}
        size = sum(w * w for w in v.values()) ** 0.5
        examples.append((i, i % 2, {t: w / size for t, w in v.items()}))
    index = Index(examples, 40, 8)
    for _, _, q in examples[:40]:
        brute = sorted((-round(sum(w * e[2].get(t, 0) for t, w in q.items()), 12), e[0]) for e in examples)
        places, scores = index.nearest(q, 5)
        assert [int(x) for x in index.ids[places]] == [i for s, i in brute[:5] if s < 0]
    bad, good = ["vile", "rotten", "filth"], ["sun", "tree", "river", "stone", "cloud"]
    rows = [(i, " ".join(rng.choice(good, 30)) + (" " + str(rng.choice(bad)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(df, labels).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert all(got[r[0]].predicted == r[2] for r in held) and got[999].predicted == 0 and len(got) == 401
    assert all(got[r[0]].evidence for r in held if r[2])
    assert toxicity(df, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_searches_all_words(spark):
    from millrace.llm.toxicity import toxicity

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words, 12)), int(i % 7 == 0)) for i in range(120)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(500, " ".join(words[:3])), (501, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")).collect()}
    # No word is telling here, so the plain TF-IDF of every word is what must be searched.
    tf = {i: Counter(t.split()) for i, t, _ in [*rows, (500, " ".join(words[:3]), 0)]}
    seen = Counter(f for i, _, _ in rows for f in tf[i])

    def vector(i):
        v = {f: (1 + np.log(n)) * (np.log(121 / (1 + seen[f])) + 1) for f, n in tf[i].items() if f in seen}
        return {f: w / sum(x * x for x in v.values()) ** 0.5 for f, w in v.items()}

    vectors = {i: vector(i) for i in tf}
    for i in tf:
        brute = sorted((-round(sum(w * vectors[j].get(f, 0) for f, w in vectors[i].items()), 9), j) for j, _, _ in rows)
        want = [(-s, j) for s, j in brute[:15] if s < 0]
        assert [round(e.cosine, 9) for e in got[i].evidence] == pytest.approx([s for s, _ in want], abs=2e-9) and len(want) > 0
    assert got[501].evidence == []


def test_toxicity_of_odd_tables(spark):
    from millrace.llm.toxicity import toxicity

    rows = [(i, "vile rotten filth" if i % 3 == 0 else "sun tree river") for i in range(60)] + [(None, "vile rotten"), (7, "sun tree"), (7, "sun tree"), (70, None), (71, "sun " * 200_000), (72, "!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "_y", "_h", "_fits", "hashes")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (8, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = toxicity(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[3].predicted == 1 and by[7].predicted == 0 and by[71].predicted == 0
    assert by[70].evidence == by[72].evidence == [] and by[70].score == by[72].score
    assert toxicity(df.limit(0), labels).count() == 0


def _quality(text):
    text = text or ""
    words, n = re.findall(r"[^\x20\x09-\x0D]+", text), 0
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen = set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), n, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def _kept(rows, bands):
    """doc -> verdict, by brute force."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=bands.level)
    share = lambda raw: len(packer.compress(raw)) / len(raw)
    size = lambda n: int(np.floor(2 * np.log2(n)))
    passed = {}
    for _, t in rows:
        raw = (t or "").encode()
        if not _quality(t)[5]:
            passed.setdefault(size(len(raw)), []).append(round(1000 * share(raw) + 1e-9))
    limits = {}
    for b, steps in passed.items():
        if len(steps) >= bands.least_rows:
            q1, q2, q3 = (sorted(steps)[int(np.ceil(p * len(steps))) - 1] / 1000 for p in (0.25, 0.5, 0.75))
            limits[b] = (q2 - bands.width * (q3 - q1), q2 + bands.width * (q3 - q1))

    def within(raw):
        wide = next((low, high) for below, low, high in bands.whole if len(raw) < below)
        return all(low <= share(raw) <= high for low, high in (wide, limits.get(size(len(raw)), wide)))

    out = []
    for d, t in rows:
        raw = (t or "").encode()
        starts = [a for a in range(0, len(raw), bands.chunk_bytes) if a == 0 or len(raw) - a >= bands.least_chunk]
        bad = sum(b - a for a, b in zip(starts, [*starts[1:], len(raw)], strict=True) if not within(raw[a:b])) if raw else 0
        out.append((str(d), bool(raw) and not _quality(t)[5] and within(raw) and bad <= bands.bad_share * len(raw)))
    return sorted(out)


def test_quality_counts_and_bands(spark, docs, rows, empty):
    from millrace.llm.quality import Bands, compression_bands

    got = compression_bands(docs).collect()
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted((str(d), *_quality(t)) for d, t in rows)
    assert compression_bands(empty).count() == 0
    few = Bands(least_rows=8)
    assert sorted((str(r.doc_id), r.kept) for r in compression_bands(docs, bands=few).collect()) == _kept(rows, few)


def test_quality_rejects_repetition_and_noise(spark):
    from millrace.llm.quality import compression_bands

    rng = random.Random(8)
    syllables = ["the", "an", "ver", "so", "li", "mo", "ta", "res", "in", "ka", "ou", "pel", "di", "un", "gro", "fe"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(9)) for _ in range(420))
    counted = " ".join(f"item{i}" for i in range(600))
    rows = [(i, prose(rng.randint(600, 640))) for i in range(300)] + [(900, noise), (901, counted), (902, prose(500) + "\n" + counted), (903, prose(2000))]
    got = {r.doc_id: r for r in compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i].base_failed for i, _ in rows)
    assert [got[i].kept for i in (900, 901, 902, 903)] == [False, False, False, True]
    assert all(got[i].kept for i in range(300))


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed to the Foundation under one agreement. Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not use this file except in compliance\nwith the License.",
    "gpl-2.0": "Foo is free software; you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free\nSoftware Foundation; either version 2 of the License, or (at your\noption) any later version.",
    "gpl-3.0": "Bar is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
    "agpl-3.0": "Baz is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation.\n3. Neither the name of the author nor the names of contributors may be used\nto endorse or promote products derived from this software.",
    "cc-by-4.0": "This article is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "The text is licensed under CC BY-SA 4.0.",
    "cc-by-nc-nd-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "proprietary": "Copyright 2019 Example Press. All rights reserved.",
}


def test_licences(spark):
    from millrace.llm.licences import ANCHORS, MARKS, TEMPLATES, scan_licences

    assert len(TEMPLATES) >= 20 and MARKS.keys() == TEMPLATES.keys()
    assert all(any(a in t.lower()[:120] for a in ANCHORS) for ts in TEMPLATES.values() for t in ts)
    prose = "invented words of no licence at all\nand another line of the text"
    rows = [(i, f"{prose}\n{t}\n{prose}") for i, t in enumerate(NOTICES.values())]
    none = ["the terms of the contest are free of charge", "the license of the old driver was copied", "all rights and wrongs were reserved for later", "This work is licensed under the GNU General Public License.", "licensed under the terms of some other agreement, version 3", None, "", "Redistribution and use of the land was permitted"]
    rows += [(100 + i, t) for i, t in enumerate(none)] + [(200 + i, prose) for i in range(100)] + [(None, "Released under the MIT License."), (300, "Released under the MIT License."), (300, "Released under the MIT License."), (301, "word " * 300_000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("low", "found", "h")})
    got = {}
    for r in scan_licences(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    sure = {d: [f.family for f in rs[0].found if f.confirmed] for d, rs in got.items()}
    assert {i: sure[i] for i in range(len(NOTICES))} == {i: [n] for i, n in enumerate(NOTICES)}
    assert not any(v for d, v in sure.items() if d is not None and 100 <= d < 300)
    assert sure[None] == sure[300] == sure[301] == ["mit"] and len(got[300]) == 2 and got[105][0].n_lines == 0
    assert got[0][0].found[0].line == 2 and scan_licences(df.limit(0)).count() == 0


def test_pipeline_decides_odd_rows(spark):
    import corpus_pipeline

    bad = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"), "doc_id").orderBy("doc_id").first().text
    rows = [(None, bad), (3_000_001, bad), (3_000_001, "a clean text of its own"), (None, "another clean text"), (3_000_002, None), (3_000_003, "")]
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd).withColumn("score", F.lit(1))
    left = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert left.where(F.col("text") == bad).count() == 0
    assert left.where("doc_id is null or doc_id > 3000000").count() == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() <= before
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
