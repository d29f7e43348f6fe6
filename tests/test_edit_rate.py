"""Edit rate against plain tables and a shift search that tries every move one by one."""

import itertools
import math
import random

import numpy as np
import pytest

from millrace.operators import edit_rate
from millrace.operators.edit_rate import edits, ter


def _plain(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[-1][-1]


def _fewest(a, b, deep):
    """Fewest shifts and edits with up to ``deep`` moves of any block to any place."""
    best = _plain(a, b)
    if deep and best > 1:
        for i, size, to in itertools.product(range(len(a)), range(1, len(a)), range(len(a))):
            if i + size <= len(a):
                rest = a[:i] + a[i + size :]
                best = min(best, 1 + _fewest(rest[:to] + a[i : i + size] + rest[to:], b, deep - 1))
    return best


def test_distances_equal_a_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in "ab")
        for beam in (None, 25):
            if b:
                assert edits(np.array(a, np.int64), np.array(b, np.int64), beam=beam, shifts=False) == _plain(a, b)


def test_shifts_against_every_move():
    """Greedy: never more edits than without shifts, never fewer than the best of all moves, and that best in most cases."""
    rng = random.Random(2)
    equal = total = 0
    for _ in range(60):
        b = [rng.randrange(6) for _ in range(rng.randint(3, 6))]
        a = b[:]
        i = rng.randrange(len(a))
        a = a[i:] + a[:i]
        if rng.random() < 0.5:
            a[rng.randrange(len(a))] = 9
        got, least = edits(np.array(a), np.array(b)), _fewest(a, b, 2)
        assert least <= got <= _plain(a, b)
        equal, total = equal + (got == least), total + 1
    assert equal >= 0.9 * total


@pytest.mark.parametrize(
    ("pred", "ref", "want"),
    [
        ("the cat sat on the mat", "the cat sat on the mat", 0),
        ("c d e f a b", "a b c d e f", 1),  # one block moved
        ("a b x d", "a b c d", 1),
        ("saudi arabia denied this week information published in the american new york times", "this week the saudis denied information published in the new york times", 4),
        ("a b", "", 2),
        ("", "a b c", 3),
        ("A  B\nC", "a b c", 0),
    ],
)
def test_edits(pred, ref, want):
    known = {}
    number = lambda s: np.array([known.setdefault(w, len(known)) for w in s.lower().split()], np.int64)
    assert edits(number(pred), number(ref)) == want


def test_corpus_score(spark):
    rows = [(1, "c d e f a b", ["a b c d e f"]), (1, None, ["a b", "a"]), (2, "x y", []), (3, "x", None), (4, "q", [None])]
    df = spark.createDataFrame(rows, "id int, p string, refs array<string>")
    got = sorted(edit_rate.edit_rows(df, id_col="id", pred="p", refs="refs").collect(), key=repr)
    assert [tuple(r) for r in got] == [("1", 1, 1.5), ("1", 1, 6.0), ("2", None, None), ("3", None, None), ("4", 1, 0.0)]
    assert math.isclose(ter(df, id_col="id", pred="p", refs="refs").first().score, 3 / 7.5)
    assert ter(df.where("id = 4"), id_col="id", pred="p", refs="refs").first().score == 1.0
    assert ter(df.limit(0), id_col="id", pred="p", refs="refs").first().score == 0.0


def test_long_texts_stay_in_the_band():
    rng = np.random.default_rng(3)
    ref = rng.integers(0, 500, 2000)
    assert 0 < edits(rng.integers(0, 500, 2000), ref) <= 2000
    assert edits(np.concatenate([ref[5:], ref[:5]]), ref) <= 10
