"""Listings in parts against a plain fold."""

import random

from pyspark.sql import functions as F

from millrace.functions.listings import lines_of, listing_parts


def _plain(text, chars, most):
    lines = (text or "").splitlines()
    if not lines:
        return []
    header, body = ("File list", lines) if not lines[0].strip().lower().startswith("file list") else (lines[0], lines[1:])
    parts, size = [], 0
    for x in body:
        if not parts or size + len(x) + 1 > chars or len(parts[-1]) >= most:
            parts, size = [*parts, []], 0
        parts[-1].append(x)
        size += len(x) + 1
    return [text] if len(parts) <= 1 else [f"{header} (chunk {i}/{len(parts)})\n" + "\n".join(p) for i, p in enumerate(parts, 1)]


def test_parts_equal_a_plain_fold(spark):
    rng = random.Random(9)
    line = lambda: "é" * rng.randint(0, 30)
    texts = [None, "", "\n", "file LIST of x", " File list:\na\nb", "x" * 500, "a\r\nb\rc\x0bd e f\u2028g\x85\n\n", "a\n" * 40]
    texts += [rng.choice(["", "File list (3)\n"]) + rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for chars, most in ((100, 7), (31, 200), (8000, 200)):
        got = {r.i: r.p for r in df.select("i", listing_parts(F.col("t"), max_chars=chars, max_lines=most).alias("p")).collect()}
        assert [got[i] for i in range(len(texts))] == [_plain(t, chars, most) for t in texts]
    assert [r[0] for r in df.orderBy("i").select(lines_of(F.col("t"))).collect()] == [(t or "").splitlines() for t in texts]
