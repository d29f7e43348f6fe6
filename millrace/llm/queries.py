"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.util import table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document encoded and decoded again: counts, checksums, parity with the library, exact round trip."""
    from millrace.llm import spiece

    path = path or _vocabulary("piece_bpe_32k.model")
    done = spiece.decode(spiece.encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "parity", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op2_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's pieces and their places; null texts are the end id alone, repeated rows and null ids pieces of their own."""
    from millrace.llm import packing

    parts = packing.pieces(table(spark, sf_dir, "documents"), path or _vocabulary("word_bpe_49k.json"), keep_ids=False).drop("ids")
    return packing.pack(parts)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records against a replica with changed and lost records: every node that differs."""
    from millrace.llm import fixity

    pages = table(spark, sf_dir, "pages")
    sound = fixity.records(pages, id_col="page_id", url_col="url", body_col="html")
    hurt = pages.withColumn("html", F.when(F.col("page_id") * 7919 % 101 == 7, F.translate("html", "e", "3")).otherwise(F.col("html")))
    other = fixity.records(hurt, id_col="page_id", url_col="url", body_col="html")
    return fixity.audit(sound, other.where("(file * 1024 + seq) * 7907 % 103 <> 5"), levels=3)


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth; null vectors and those that hold null or no finite number take no part, ties go to the smaller id."""
    from millrace.llm.covertree import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components; null, empty and blank texts have fingerprint zero and are linked like others, repeated rows are rows of their own."""
    from millrace.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and spans, and all spans; null and empty texts have none, repeated rows are found alike, whole texts are read."""
    from millrace.llm import pii

    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {r})) as bigint)").alias(f"n_{k}") for r, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document less the lines whose template recurs across documents."""
    from millrace.llm.templates import drop_templates

    return drop_templates(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores learnt from four fifths of the labels; empty texts get the rate of labelled texts without words, equal cosines go to the smaller id."""
    from millrace.llm.toxicity import toxicity

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(fold != 0))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "evidence")


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict; null texts have no word and fail the base rule, repeated rows are judged alike, an empty table gives an empty one."""
    from millrace.llm.quality import compression_bands

    return compression_bands(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices by family; null and empty texts have no line with one, repeated rows are scanned alike, an empty table gives an empty one."""
    from millrace.llm.licences import scan_licences

    scanned = scan_licences(table(spark, sf_dir, "documents"))
    sure = F.filter("found", lambda x: x["confirmed"])
    return scanned.select("doc_id", "n_lines", F.size("found").alias("n_predicted"), F.size(sure).alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), "found")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents; null texts match nothing, empty tables give an empty one."""
    from millrace.llm.lexical import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document encoded and decoded: counts and digests; null texts are empty, repeated rows and null ids rows of their own."""
    from millrace.llm import bpe

    path = path or _vocabulary("word_bpe_49k.json")
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", "n_tokens", F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document cut and reordered for infilling: its form, its cuts, digests of the output and of the text rebuilt from it."""
    from millrace.llm import infill

    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = infill.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_packing": op2_packing,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_cover_tree": op4_cover_tree,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_line_templates": op7_line_templates,
    "op8_toxicity": op8_toxicity,
    "op9_compression_bands": op9_compression_bands,
    "op10_licences": op10_licences,
    "op11_lexical": op11_lexical,
    "op12_bpe": op12_bpe,
    "op13_infill": op13_infill,
}

_RECORD = """SELECT CAST(coalesce(floor(page_id / 1024), -1) AS BIGINT) AS file, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(body, '')) || chr(13) || chr(10) || chr(13) || chr(10)
 || coalesce(body, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t"""
_LEAF = """SELECT file, row_number() OVER w - 1 AS idx, CAST(sum(strlen(t)) OVER w AS BIGINT) - strlen(t) AS s, CAST(sum(strlen(t)) OVER w AS BIGINT) AS e, sha256(t) AS h
 FROM {0} WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(t) ROWS UNBOUNDED PRECEDING)"""
_NODE = "SELECT file, idx // 16 AS idx, min(s) AS s, max(e) AS e, sha256(string_agg(idx || ':' || s || ':' || e || ':' || h, ',' ORDER BY idx)) AS h FROM {0} GROUP BY file, idx // 16"
_DIFFER = """SELECT {0} AS level, coalesce(a.file, b.file) AS file, coalesce(a.idx, b.idx) AS idx, coalesce(a.s, b.s) AS start, coalesce(a.e, b.e) AS "end",
 CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' ELSE 'changed' END AS state, a.h AS hash_a, b.h AS hash_b
 FROM a{0} a FULL JOIN b{0} b ON a.file = b.file AND a.idx = b.idx
 WHERE a.s IS DISTINCT FROM b.s OR a.e IS DISTINCT FROM b.e OR a.h IS DISTINCT FROM b.h"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op3_warc_fixity": "WITH ra AS (" + _RECORD + " FROM (SELECT page_id, url, html AS body FROM pages)), rb AS (" + _RECORD
    + " FROM (SELECT page_id, url, CASE WHEN page_id * 7919 % 101 = 7 THEN translate(html, 'e', '3') ELSE html END AS body FROM pages)), a0 AS (" + _LEAF.format("ra")
    + "), b0 AS (SELECT * FROM (" + _LEAF.format("rb") + ") WHERE (file * 1024 + idx) * 7907 % 103 <> 5), "
    + ", ".join(f"{r}{n} AS ({_NODE.format(f'{r}{n - 1}')})" for r in "ab" for n in (1, 2, 3)) + " " + " UNION ALL ".join(_DIFFER.format(n) for n in range(4)),
    "op4_cover_tree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_lexical": f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM c GROUP BY t), s),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM i JOIN c USING (t) JOIN w USING (t) JOIN l ON l.doc_id = c.doc_id, s GROUP BY item_id, c.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, l, len(l) AS n, list_transform(range(4), lambda i: CAST('0x' || substring(h, 1 + 8 * i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, coalesce(array_to_string(l[1:p], ''), '') AS pre, coalesce(array_to_string(l[p + 1:q], ''), '') AS mid, coalesce(array_to_string(l[q + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM x""",
}
