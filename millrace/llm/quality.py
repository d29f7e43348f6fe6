"""Quality rules: compression bands.

Zstandard ratios over the whole document and over fixed chunks reject
repetitive and incompressible text, by limits for each band of lengths. The
limits of a band are fitted to the ratios of all documents of that length
that pass the base rule; wide fixed limits hold besides. A few exact word and
line counts are returned beside them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.util import batches, checkpoint, let, texts

#: Wide limits of compressed bytes / bytes, by length: (bytes below, least, most).
#: Frame overhead lifts the ratio of short texts, so their bands lie higher.
WHOLE_BANDS = (
    (32, 0.30, 3.00),
    (64, 0.30, 1.60),
    (128, 0.30, 1.35),
    (256, 0.33, 1.10),
    (512, 0.40, 0.90),
    (1024, 0.42, 0.80),
    (2048, 0.40, 0.74),
    (4096, 0.38, 0.70),
    (8192, 0.36, 0.67),
    (16384, 0.34, 0.65),
    (32768, 0.32, 0.64),
    (float("inf"), 0.25, 0.64),
)
MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, chunks array<struct<n: int, ratio: double>>"
_SPACES, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """whole: the wide limits. chunk_bytes: size of the fixed chunks. least_chunk: a last piece
    with fewer bytes belongs to the chunk before it. bad_share: most of a text's bytes that may lie
    in chunks outside their limits. width: how many interquartile ranges from the median the fitted
    limits lie. least_rows: a band of fewer documents has only its wide limits."""

    level: int = 3
    whole: tuple = field(default=WHOLE_BANDS)
    chunk_bytes: int = 2048
    least_chunk: int = 256
    bad_share: float = 0.25
    width: float = 4.0
    least_rows: int = 100


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def cuts(n: int, bands: Bands) -> list[tuple[int, int]]:
    """The fixed chunks of ``n`` bytes."""
    starts = list(range(0, n, bands.chunk_bytes)) or [0]
    if len(starts) > 1 and n - starts[-1] < bands.least_chunk:
        starts.pop()
    return list(zip(starts, [*starts[1:], n], strict=True))


def measure(text: str, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """All of MEASURED but the id. An empty text has no ratio and fails the base rule."""
    raw = text.encode()
    words = raw.split()  # bytes.split() cuts at exactly these six characters
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeats = len(words), repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    ratio = len(packer.compress(raw)) / len(raw) if raw else None
    parts = cuts(len(raw), bands) if raw else []
    chunks = [{"n": b - a, "ratio": len(packer.compress(raw[a:b])) / (b - a) if len(parts) > 1 else ratio} for a, b in parts]
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    return n, len(text) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, len(raw), ratio, chunks


def band(n: Column) -> Column:
    """Two bands to each doubling of the length."""
    return F.floor(2 * F.log2(F.greatest(n, F.lit(1)))).cast("int")


def fit(measured: DataFrame, bands: Bands) -> dict[int, tuple[float, float]]:
    """band -> (least, most), from every document that passes the base rule.

    Only counts for each band and thousandth of the ratio come to the driver.
    """
    step = F.round(1000 * F.col("ratio")).cast("int")
    counts = measured.where("NOT base_failed").groupBy(band(F.col("n_bytes")).alias("band"), step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    made = {}
    for b in {r.band for r in counts}:
        own = sorted((r.step, r.n) for r in counts if r.band == b)
        upto = np.cumsum([n for _, n in own])
        if upto[-1] >= bands.least_rows:
            q1, q2, q3 = (own[int(np.searchsorted(upto, share * upto[-1]))][0] / 1000 for share in (0.25, 0.5, 0.75))
            made[b] = (q2 - bands.width * (q3 - q1), q2 + bands.width * (q3 - q1))
    return made


def _within(n: Column, ratio: Column, limits: dict[int, tuple[float, float]], bands: Bands) -> Column:
    wide = F.lit(False)
    for below, low, high in reversed(bands.whole):
        wide = F.when(n < below, ratio.between(low, high)).otherwise(wide)
    if not limits:
        return wide
    fitted = F.create_map(*[F.lit(x) for b, (low, high) in sorted(limits.items()) for x in (b, [low, high])])
    return wide & let(fitted[band(n)], lambda x: x.isNull() | ratio.between(x[0], x[1]))


def compression_bands(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row for each input row with counts, ratios and the verdict ``kept``.

    A text is kept if it passes the base rule, its ratio lies within the
    limits of its length, and the chunks outside the limits of theirs hold at
    most ``bad_share`` of it. Null and empty texts: no words, null ratio, not
    kept. Repeated rows and rows with a null id are measured like any other
    and count in the fit; whole texts are measured, however long. Other
    columns of the input, whatever their names, are not read. An empty table
    gives an empty one. There is no shuffle but for the counts of the fit.
    """
    bands = bands or Bands()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bytes", "ratio", "chunks"]
        types = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.float64(), pa.list_(pa.struct([("n", pa.int32()), ("ratio", pa.float64())]))]
        for batch in batches(stream):
            cols = list(zip(*(measure(t, bands, packer) for t in batch.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    measured = checkpoint(texts(df, id_col, text_col).mapInArrow(run, MEASURED))
    limits = fit(measured, bands)
    bad = F.filter("chunks", lambda x: ~_within(x["n"], x["ratio"], limits, bands))
    bad_bytes = F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sound = F.coalesce(_within(F.col("n_bytes"), F.col("ratio"), limits, bands), F.lit(False))
    kept = ~F.col("base_failed") & sound & (bad_bytes <= bands.bad_share * F.col("n_bytes"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", F.size("chunks").cast("long").alias("n_chunks"), F.size(bad).cast("long").alias("n_bad_chunks"), kept.alias("kept"))
