"""Translation edit rate: word edits and block shifts that turn a prediction into its reference, over the reference's length.

The shift search is greedy: of all blocks of a hypothesis that also stand in
the reference, where both are wrong, the one whose move saves most edits is
moved, until none saves any. All moves of a round are one matrix of word
numbers, whose distances are computed together, row by row, inside a band
around the diagonal. Pairs are independent and go to tasks in Arrow batches;
the corpus score is a sum of edits over a sum of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The bounds of the published measure.
BEAM, LONGEST_BLOCK, FARTHEST, MOST_TRIED = 25, 10, 50, 1000
_FAR = 1 << 30


def _band(n: int, m: int, beam: int | None) -> list[tuple[int, int]]:
    """First and last-but-one reference positions that each of the rows 1 to n computes."""
    if beam is None:
        return [(0, m + 1)] * n
    ratio = m / n
    width = math.ceil(ratio / 2 + beam) if ratio / 2 > beam else beam
    rows = [(max(0, math.floor(i * ratio) - width), min(m + 1, math.floor(i * ratio) + width)) for i in range(1, n + 1)]
    rows[-1] = (rows[-1][0], m + 1)
    return rows


def distances(hyps: np.ndarray, ref: np.ndarray, beam: int | None = BEAM, rows: list | None = None) -> np.ndarray:
    """Word edits from each row of ``hyps`` to ``ref``; ``rows`` collects the table's rows."""
    count, n = hyps.shape
    m = len(ref)
    last = np.broadcast_to(np.arange(m + 1), (count, m + 1)).astype(np.int64)
    if rows is not None:
        rows.append(last)
    for i, (lo, hi) in enumerate(_band(n, m, beam) if n else []):
        now = np.full((count, m + 1), _FAR, np.int64)
        best = last[:, lo:hi] + 1  # a word too many
        from_left = max(lo, 1)
        same = ref[from_left - 1 : hi - 1] == hyps[:, i : i + 1]
        np.minimum(best[:, from_left - lo :], last[:, from_left - 1 : hi - 1] + ~same, out=best[:, from_left - lo :])
        step = np.arange(hi - lo)
        now[:, lo:hi] = np.minimum.accumulate(best - step, axis=1) + step  # words missing
        last = now
        if rows is not None:
            rows.append(last)
    return last[:, m]


def _aligned(table: list[np.ndarray], hyp: np.ndarray, ref: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The hypothesis position at each reference word, and which words of either side the best path has wrong.

    Of equally short paths a match or an exchange goes before a word too many, and that before one missing.
    """
    i, j = len(hyp), len(ref)
    at, wrong_h, wrong_r = [0] * j, np.zeros(i, bool), np.zeros(j, bool)
    while i or j:
        here = table[i][0, j]
        if i and j and here == table[i - 1][0, j - 1] + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            at[j] = i
            wrong_h[i] = wrong_r[j] = hyp[i] != ref[j]
        elif i and here == table[i - 1][0, j] + 1:
            i -= 1
            wrong_h[i] = True
        else:
            j -= 1
            at[j], wrong_r[j] = i - 1, True
    return at, wrong_h, wrong_r


def _blocks(hyp: np.ndarray, ref: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(hypothesis place, reference place, length) of runs of words that both sides have, every length up to the bound."""
    where: dict[int, list[int]] = {}
    for j, w in enumerate(ref.tolist()):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(hyp.tolist()):
        for j in where.get(w, ()):
            if abs(i - j) > FARTHEST:
                continue
            for size in range(1, min(LONGEST_BLOCK, len(hyp) - i, len(ref) - j) + 1):
                if hyp[i + size - 1] != ref[j + size - 1]:
                    break
                yield i, j, size


def _moved(hyp: np.ndarray, start: int, size: int, to: int) -> np.ndarray:
    """The block taken out and put before the word that stood at ``to``; inside itself, so many words further on."""
    block, rest = hyp[start : start + size], np.concatenate([hyp[:start], hyp[start + size :]])
    place = to if to < start else to - size if to > start + size else to
    return np.concatenate([rest[:place], block, rest[place:]])


def edits(hyp: np.ndarray, ref: np.ndarray, *, beam: int | None = BEAM, shifts: bool = True) -> int:
    """Word edits and shifts from one row of word numbers to the other."""
    if not len(ref):
        return len(hyp)
    moves = tried = 0
    while True:
        table: list[np.ndarray] = []
        here = int(distances(hyp[None], ref, beam, table)[0])
        if not shifts or not here or tried >= MOST_TRIED:
            return moves + here
        at, wrong_h, wrong_r = _aligned(table, hyp, ref)
        asked: list[tuple[int, int, int]] = []
        for i, j, size in _blocks(hyp, ref):
            if tried >= MOST_TRIED:
                break
            if not wrong_h[i : i + size].any() or not wrong_r[j : j + size].any() or i <= at[j] < i + size:
                continue
            targets = [at[k] + 1 if k >= 0 else 0 for k in range(j - 1, j + size)]
            different = [t for n, t in enumerate(targets) if not n or t != targets[n - 1]]
            asked += [(i, size, t) for t in different]
            tried += len(different)
        if not asked or tried >= MOST_TRIED:
            return moves + here
        moved = np.stack([_moved(hyp, *a) for a in asked])
        gain = here - distances(moved, ref, beam)
        best = max(range(len(asked)), key=lambda n: (gain[n], asked[n][1], -asked[n][0], -asked[n][2]))
        if gain[best] <= 0:
            return moves + here
        hyp, moves = moved[best], moves + 1


def edit_rows(df: DataFrame, *, id_col: str, pred: str, refs: str, beam: int | None = BEAM, shifts: bool = True) -> DataFrame:
    """id, edits, ref_words: the fewest edits to any reference, and the references' mean number of words.

    Words are what white space parts, in lower case. Null texts are empty;
    against an empty reference every word is an edit. A row without references
    has null in both. Rows are scored each for itself, so ids may repeat.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, p, rs in zip(frame["id"], frame["p"], frame["rs"], strict=True):
                known: dict[str, int] = {}
                numbered = lambda s: np.array([known.setdefault(w, len(known)) for w in (s or "").lower().split()], np.int64)  # noqa: B023, E731
                hyp, golds = numbered(p), [numbered(r) for r in (rs if rs is not None else ())]
                least = min((edits(hyp, g, beam=beam, shifts=shifts) for g in golds), default=None)
                out.append((doc, least, sum(map(len, golds)) / len(golds) if golds else None))
            yield pd.DataFrame(out, columns=["id", "edits", "ref_words"]).astype({"edits": "Int64", "ref_words": "float64"})

    kept = df.select(F.col(id_col).cast("string").alias("id"), F.col(pred).cast("string").alias("p"), F.col(refs).alias("rs"))
    return kept.mapInPandas(run, "id string, edits long, ref_words double")


def ter(df: DataFrame, *, id_col: str, pred: str, refs: str, beam: int | None = BEAM, shifts: bool = True) -> DataFrame:
    """score: edits over reference words, of all rows together; 1 if all references are empty and some prediction is not, 0 without any edit."""
    rows = edit_rows(df, id_col=id_col, pred=pred, refs=refs, beam=beam, shifts=shifts)
    edited, words = F.coalesce(F.sum("edits"), F.lit(0)), F.coalesce(F.sum("ref_words"), F.lit(0.0))
    return rows.agg(F.when(words > 0, edited / words).when(edited > 0, 1.0).otherwise(0.0).alias("score"))
