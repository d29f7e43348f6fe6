"""Fill-in-the-middle: texts cut at two lines and written as prefix, suffix and middle.

Where the n-th line ends is asked of a learned rank index: line segments are
fitted to all boundary offsets of a text so that each is off by a bounded
number of characters, the cut's offset is predicted from its rank, and the
stored residual corrects the prediction exactly. A segment of lines of like
length is three numbers however many lines it has, and a residual one small
number, where a list of offsets takes eight bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.util import batches, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Predictions are off by at most so many characters, so a residual is one byte.
ERROR = 100
#: Code points looked at in one go.
WINDOW = 1 << 20


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets 0, end of the first line, ..., end of the text; a line ends with its line feed."""
    ends = [np.zeros(1, np.int64)]
    for at in range(0, len(text), WINDOW):
        codes = np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
        ends.append(np.flatnonzero(codes == 10) + (at + 1))
    if text and text[-1] != "\n":
        ends.append(np.array([len(text)], np.int64))
    return np.concatenate(ends)


@dataclass
class RankIndex:
    """rank -> offset: the segments' first ranks, offsets and slopes, and what each prediction lacks."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Greedy segments: each goes as far as one line from its first point stays within ``error`` of all its points."""
        n, at = len(offsets), 0
        first, slopes = [], []
        while at < n:
            low, high, end, step = -np.inf, np.inf, at + 1, 16
            while end < n:  # the cone of slopes that fit narrows with every point; look ahead in steps that double
                part = offsets[end : end + step] - offsets[at]
                run = np.arange(end - at, end - at + len(part))
                lows = np.maximum.accumulate(np.maximum((part - error) / run, low))
                highs = np.minimum.accumulate(np.minimum((part + error) / run, high))
                fit = int(np.argmax(lows > highs)) if (lows > highs).any() else len(part)
                if fit:
                    low, high = lows[fit - 1], highs[fit - 1]
                end += fit
                if fit < len(part):
                    break
                step *= 2
            first.append(at)
            slopes.append(0.0 if end == at + 1 else (low + high) / 2)
            at = end
        index = cls(np.array(first, np.int64), offsets[first], np.array(slopes), np.zeros(0, np.int16))
        lacking = offsets - index.predict(np.arange(n))
        index.residual = lacking.astype(np.int8 if np.abs(lacking).max() < 128 else np.int64)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offsets(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of the boundaries of these ranks."""
        return self.predict(rank) + self.residual[rank]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id: the first groups of a digest's hexadecimal digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, error: int = ERROR) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, n_segments, output: each whole text in one of three forms.

    Cuts, and whether a text is plain (``100 - rate`` percent) or its suffix
    comes first (``spm_rate`` percent of the others), follow from the id and
    ``seed`` alone, so repeated rows come out alike and a null id counts as an
    empty one. Null and empty texts, and those that hold a sentinel, are plain
    (the text itself, the counts of characters null). n counts lines whatever
    the form. Other columns, whatever their names, are not read; an empty
    table gives an empty one.
    """
    draws = _draws(F.col("doc_id"), seed)
    drawn = texts(df, id_col, text_col).select("doc_id", "text", *(d.alias(f"h{i}") for i, d in enumerate(draws, 1)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 256):
            out = []
            for doc, text, h1, h2, h3, h4 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = RankIndex.fit(boundaries(text), error)
                n = len(index.residual) - 1
                if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((doc, n, "plain", None, None, len(index.first), text))
                    continue
                p, q = index.offsets(np.sort([h1 % (n + 1), h2 % (n + 1)])).tolist()
                spm = h4 % 100 < spm_rate
                head = f"{SUFFIX}{text[q:]}{PREFIX}{text[:p]}" if spm else f"{PREFIX}{text[:p]}{SUFFIX}{text[q:]}"
                out.append((doc, n, "spm" if spm else "psm", p, q - p, len(index.first), f"{head}{MIDDLE}{text[p:q]}"))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_segments long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` of ``form`` was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
