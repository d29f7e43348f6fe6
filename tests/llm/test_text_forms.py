"""Byte-pair encoding and fill-in-the-middle against the library and brute force, with every odd case."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    (None, "a null id"), (1, None), (2, ""), (3, "\n"), (4, "no line feed"), (5, "a\nb\nc\n"), (6, "a\nb\nc\n"), (6, "a\nb\nc\n"), (7, "é😀\nΣΑΣ ßİ\n\n"),
    (8, "holds <P> a sentinel\nx"), (9, "<\nP>\nS>\n<M\n"), (10, "x" * 40_000), (11, "ab \x1c\x85 c\n" * 3000), (12, "a<|endoftext|>b<|startoftext|><|EndOfText|>"),
    (-13, "it's we'll THEY'RE 1234 ½ … !!'s \x00\t ñé́ é 한국어 Ꟛ\U000105c0"),
]
CLASHING = ("n", "h1", "form", "ids", "output", "n_tokens", "decoded")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame(ODD, "doc_id long, text string")).withColumns({c: F.lit("1") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def _sorted(found):
    return sorted(found, key=repr)


def test_bpe_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    from millrace.llm import bpe

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = [(d, library.encode(t, add_special_tokens=False).ids) for d, t in rows]
    assert _sorted((r.doc_id, r.n_tokens, r.ids) for r in got) == _sorted((d, len(i), i) for d, i in want)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)
    assert bpe.encode(docs.limit(0), path).count() == 0 == bpe.decode(bpe.encode(docs.limit(0), path), path).count()


def test_bpe_of_every_code_point_of_the_first_planes():
    from tokenizers import Tokenizer

    from millrace.llm.bpe import Codec

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), Codec(path, size=5000)
    points = [i for i in range(0x32000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 200):
        text = " ".join(f"a{c}b{c}{c}" for c in map(chr, points[at : at + 200]))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_queue_of_merges_equals_repeated_scans():
    """Any word: always the leftmost pair of least rank first."""
    from millrace.llm.bpe import Merges

    merges = [["a", "b"], ["ab", "a"], ["b", "a"], ["a", "a"], ["aa", "aa"], ["ba", "b</w>"], ["ab", "ab"], ["b", "b"], ["bb", "a</w>"]]
    names = ["a", "b", "a</w>", "b</w>", *("".join(m) for m in merges)]
    own = Merges({"vocab": {n: i for i, n in enumerate(names)}, "end_of_word_suffix": "</w>", "merges": merges})
    rank = {tuple(m): r for r, m in enumerate(merges)}
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]  # noqa: B905
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [names[i] for i in own.encode(word)] == parts


def test_bpe_refuses_other_files():
    from millrace.llm.bpe import Codec

    with pytest.raises(ValueError, match="another kind"):
        Codec(P.path("byte_bpe_50k.json"))


def _infilled(doc, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text):
        return (doc, n, "plain", None, None, text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (lines[:p], lines[p:q], lines[q:]))
    return (doc, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 50 else (doc, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_infill_against_brute_force(docs, rows):
    from millrace.llm import infill

    made = infill.fill_in_middle(docs)
    got = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert _sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == _sorted(_infilled(*r) for r in rows)
    assert _sorted((r.doc_id, r.back) for r in got) == _sorted(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    assert {r.form for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_rank_index_is_bounded_and_exact():
    from millrace.llm.infill import RankIndex, boundaries

    rng = np.random.default_rng(2)
    for lengths in ([], [1], np.ones(5000, int), rng.integers(1, 200, 5000), rng.integers(1, 5, 100).cumsum() ** 2, np.where(rng.random(3000) < 0.01, 10_000_000, 30)):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        index = RankIndex.fit(offsets)
        ranks = np.arange(len(offsets))
        assert np.abs(index.predict(ranks) - offsets).max() <= 101 and index.residual.dtype == np.int8
        assert (index.offsets(ranks) == offsets).all()
    assert len(RankIndex.fit(np.arange(0, 3_000_000, 30)).first) == 1  # lines of one length: one segment
    assert boundaries("é\n\n😀x").tolist() == [0, 2, 3, 5] and boundaries("").tolist() == [0] and boundaries("\n").tolist() == [0, 1]
