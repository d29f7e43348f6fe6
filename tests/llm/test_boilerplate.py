"""Near copies among many texts with one frame: the number of rounds does not follow theirs."""

import random
import time

import numpy as np
import pytest

from millrace.llm import near_copies


def _sets(rows):
    return [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for d, t in rows for w in [t.split()]]


def test_texts_with_one_frame(spark):
    """2,000 texts share 300 of 400 words; some are near copies, some chains of near copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    frame, rows = [word() for _ in range(300)], []
    for i in range(2000):
        if i % 20 == 19:  # a near copy of the text before it: a run of its own words changed
            own = rows[-1][1].split()[300:]
            at = rng.randrange(80)
            own[at : at + 12] = [word() for _ in range(12)]
        else:
            own = [word() for _ in range(100)]
        rows.append((i, " ".join(frame + own)))
    rows += [(5000 + i, rows[0][1].replace(rows[0][1].split()[340 + i], word())) for i in range(60)]
    rng.shuffle(rows)
    began = time.time()
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 90
    sets = dict(_sets(rows))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by_rare: dict = {}
    for d, s in sets.items():
        for x in s:
            by_rare.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_rare.values() if len(ds) < 100 for a in ds for b in ds if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {d for d in sets if find(d) == d}
    assert kept >= want and len(kept - want) <= 0.01 * len(want), (len(kept), len(want))
    assert len(want) < 1950


def test_rarest_shingles_cover_every_alike_pair(spark):
    rng = random.Random(12)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(120)]
    for i in range(0, 100, 2):  # alike in four fifths or a little less
        base = sets[i]
        sets[i + 1] = sorted(set(base[: max(1, round(len(base) * rng.uniform(0.75, 1)))]) | {100 + i})
    table = spark.createDataFrame(list(enumerate(sets)), "cid long, h array<long>")
    keys: dict = {}
    for r in near_copies._rarest(table.select("cid"), table, near_copies.Alike()).collect():
        keys.setdefault(r.cid, set()).add(r.key)
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(set(a) & set(sets[j]))
            if common >= 0.8 * (len(a) + len(sets[j]) - common):
                assert keys[i] & keys[j], (a, sets[j])
    assert near_copies._rarest(table.select("cid").limit(0), table, near_copies.Alike()).count() == 0


@pytest.mark.parametrize("bridge", [near_copies.BRIDGE, -(10**9)])
def test_a_family_of_which_few_are_alike(spark, monkeypatch, bridge):
    """Texts made from one text by few or many changes each, compared by blocks or listed anew: the number of steps does not follow theirs, and no link of a bucket is lost."""
    taken = []

    def counted(df, made=near_copies.checkpoint):
        taken.append(1)
        assert len(taken) < 60, "rounds follow the number of texts"
        return made(df)

    monkeypatch.setattr(near_copies, "checkpoint", counted)
    monkeypatch.setattr(near_copies, "BRIDGE", bridge)
    monkeypatch.setattr(near_copies, "TILE", 16)
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(600)]
    base, rows = words[:120], []
    for i in range(600):
        own = list(base)
        for _ in range(min(9, int(rng.expovariate(0.3)))):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = _sets(rows), list(range(600))
    for i, a in sets:
        for j, b in sets[:i]:
            common = len(a & b)
            if root[i] != root[j] and common >= 0.8 * (len(a) + len(b) - common) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {i for i in range(600) if root[i] == i}
    assert 100 < len(want) < 500 and kept >= want and len(kept - want) <= 0.01 * len(want), (len(kept), len(want))


def test_span_of_blocks_and_bitmaps():
    """Links of two blocks are those between them that nothing known joins; a bitmap never tells alike sets apart."""
    rng = np.random.default_rng(14)
    whole = rng.integers(-(1 << 63), 1 << 63, 400)
    sets = [whole[:100]] + [rng.permutation(np.concatenate([whole[: 100 - c], whole[200 : 200 + c]])) for c in (1, 5, 12, 40, 60, 61)]
    sim = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    bits = near_copies.bitmaps(sets)
    assert all(np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j])) for i in range(7) for j in range(7))
    assert {tuple(sorted(x)) for x in near_copies.span(list(range(7)), sets, 0.8)} <= {(i, j) for i in range(7) for j in range(7) if sim(i, j) >= 0.8}
    second = np.array([False, True, False, True, False, True, True])
    crossed = near_copies.span(list(range(7)), sets, 0.8, second=second)
    assert crossed and all(second[u] != second[v] and sim(u, v) >= 0.8 for u, v in crossed)
    assert near_copies.span(list(range(7)), sets, 0.8, roots=[9] * 7) == []
