"""Line dedup by a log-template tree.

A line is parsed down a tree of fixed depth: by its number of tokens, then by
its leading tokens, where a token with a digit counts as a variable field.
In a leaf, the tokens that many documents have at a position are the template's
constants and the rest are generalised to variable fields. Many is a share of
the leaf's documents, and every share of a half, a quarter and so on is tried,
since a leaf may hold one template or several: a field's value has a smaller
share than its template's constants at one of them, however many documents
have that value. Long
lines, which recur from two documents on, are also one template if they differ
within one of four runs of tokens only. A template that recurs across
documents is dropped from all but the first of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.util import batches, checkpoint, fewer, hash_filter, join_hot, let, texts

FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]").search


@dataclass(frozen=True)
class Tree:
    """depth: leading tokens that lead to a leaf. long_tokens: from so many tokens on a line is long.
    docs_short, docs_long: documents in which a short or long template recurs. A short line is
    repeated by chance soon; a long one is not. constant: least share of constants in a
    template, for a line that is generalised beyond its digits, of all tokens or, by shares, of
    those behind the leading ones. shares: so many halvings of a leaf's documents. runs: into so many runs a
    long line's tokens behind the leading ones are cut, of which one may vary."""

    depth: int = 3
    long_tokens: int = 20
    docs_short: int = 10
    docs_long: int = 2
    constant: float = 0.6
    shares: int = 8
    runs: int = 4


LINES = "key long, doc_id long, pos int, n int, leaf long, template long"
#: Templates that a task remembers to have sent.
SENT = 200_000
#: Rows of numbers, and lines with their tokens, that a partition of a checkpoint is worth: joins that deal hot keys apart double partitions each time, and every task costs the driver memory.
EACH, LINES_EACH = 20_000, 5_000


def parse(line: bytes) -> list[bytes]:
    """Its tokens; those with a digit are variable fields."""
    tokens = line.split()
    return [FIELD if _DIGIT(t) else t for t in tokens] if _DIGIT(line) else tokens


def _hashes(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """LINES: every line with a token, as numbers only. ``docs`` has key, doc_id and text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 256):
            key, doc, pos, size, leaf, template = [], [], [], [], [], []
            for k, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for i, line in enumerate(text.encode().split(b"\n")):
                    if tokens := parse(line):
                        key.append(k)
                        doc.append(d)
                        pos.append(i)
                        size.append(len(tokens))
                        leaf.append(xxh64_intdigest(b" ".join([b"%d" % len(tokens), *tokens[: tree.depth]])))
                        template.append(xxh64_intdigest(b" ".join(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), _hashes(leaf), _hashes(template)], ["key", "doc_id", "pos", "n", "leaf", "template"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, LINES)


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """template, tokens of lines whose template is in ``wanted`` or shares its bit of the filter; a few times each."""
    passes = hash_filter(wanted, "template")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches(stream, 256):
            lines = [t for text in batch.column(0).to_pylist() for line in text.encode().split(b"\n") if (t := parse(line))]
            hashes = np.array([xxh64_intdigest(b" ".join(t)) for t in lines], np.uint64).view(np.int64)
            found: dict[int, list[bytes]] = {}
            for i in np.flatnonzero(passes(hashes)).tolist():
                if (h := int(hashes[i])) not in sent:
                    found[h] = lines[i]
            sent.update(found)
            if len(sent) > SENT:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([[t.decode() for t in x] for x in found.values()], pa.list_(pa.string()))], ["template", "tokens"])

    return docs.select("text").mapInArrow(run, "template long, tokens array<string>")


def _docs(lines: DataFrame, by: str, *more: str) -> DataFrame:
    """Of each value of ``by``: documents that hold it, the least id of them, rows, tokens; a document counts once."""
    once = lines.groupBy(by, "key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(c) for c in more])
    return once.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.sum("rows").alias("rows"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in more])


def recurring(docs: DataFrame, lines: DataFrame, n_lines: int, tree: Tree) -> DataFrame:
    """Templates that recur: template (of a line), rows (lines that have it), first (id of a document that keeps it)."""
    least = F.when(F.col("n") >= tree.long_tokens, tree.docs_long).otherwise(tree.docs_short)
    kinds = checkpoint(_docs(lines, "template", "leaf"))
    n_kinds = kinds.count()
    kinds = fewer(kinds, n_kinds, EACH)
    exact = kinds.where(F.col("docs") >= least).select("template", "rows", "first")
    # Variable fields: only a leaf with two kinds of lines and documents enough can hold such a template.
    leaves = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("docs").alias("_docs"), F.min("n").alias("n")).where((F.col("_kinds") > 1) & (F.col("_docs") >= least))
    some = checkpoint(join_hot(kinds, leaves.select("leaf", "_kinds", F.col("_docs").alias("all_docs")), "leaf", rows="_kinds", total=n_kinds))
    if not (n_some := some.count()):
        return exact
    some = fewer(some, n_some, EACH)
    read = _tokens(docs, some).groupBy("template").agg(F.first("tokens").alias("tokens"))
    known = checkpoint(some.join(read, "template").select("template", "leaf", "docs", "all_docs", "rows", "n", "tokens"))
    known = fewer(known, n_some, LINES_EACH)
    forms = checkpoint(_voted(known, tree).unionByName(_cut(known, tree)))
    # Documents of the members of a form, added up, are no fewer than the form's.
    likely = forms.groupBy("form").agg(F.sum("docs").alias("_docs"), F.count(F.lit(1)).alias("_kinds"), F.min("least").alias("least")).where("_docs >= least")
    n_forms = forms.count()
    forms = fewer(forms, n_forms, EACH)
    forms = checkpoint(join_hot(forms.drop("least"), likely.select("form", "_kinds", "least"), "form", rows="_kinds", total=n_forms))
    forms = fewer(forms, n_forms, EACH)
    members = join_hot(lines.select("template", "key", "doc_id", "n"), forms.select("template", "rows", "form"), "template", rows="rows", total=n_lines)
    groups = _docs(members, "form").select("form", F.col("docs").alias("_docs"), "first")
    sizes = forms.groupBy("form").agg(F.count(F.lit(1)).alias("_kinds"), F.min("least").alias("least"))
    groups = groups.join(sizes, "form").where("_docs >= least").select("form", "first", "_kinds")
    return exact.unionByName(join_hot(forms.select("form", "template", "rows"), groups, "form", rows="_kinds", total=n_forms).select("template", "rows", "first"))


def _voted(known: DataFrame, tree: Tree) -> DataFrame:
    """template, docs, rows, form, least: lines with the same constants, each in ``docs_short`` documents of the leaf or more; at each share, and without one."""
    parted = known.select("leaf", "template", "docs", "all_docs", F.posexplode("tokens").alias("at", "token")).where(F.col("token") != FIELD.decode())
    wide = checkpoint(parted.select("template", "docs", "all_docs", F.xxhash64("leaf", "at", "token").alias("place"), (F.col("at") >= tree.depth).alias("behind")))
    n_wide = wide.count()
    wide = fewer(wide, n_wide, 10 * EACH)
    # The first share, of 1/2, 1/4, ..., that the place's documents have of the leaf's; beyond them all, none.
    share = F.least(F.lit(tree.shares), F.greatest(F.lit(0), F.ceil(F.log2(F.max("all_docs") / F.sum("docs")) - 1e-9) - 1)).cast("int")
    places = wide.groupBy("place").agg(F.sum("docs").alias("_d"), F.count(F.lit(1)).alias("_rows"), share.alias("share")).where(f"_d >= {tree.docs_short}").select("place", "_rows", "share")
    kept = join_hot(wide.select("template", "place", "behind"), places, "place", rows="_rows", total=n_wide)
    own = lambda c, s: F.when(F.col("share") <= s, c)
    sums = [x for s in range(tree.shares + 1) for x in (F.count(own(F.lit(1), s)).alias(f"c{s}"), F.count(own(F.when(F.col("behind"), 1), s)).alias(f"b{s}"), F.bit_xor(own(F.col("place"), s)).alias(f"x{s}"), F.bit_xor(own(F.xxhash64("place"), s)).alias(f"y{s}"))]
    forms = kept.groupBy("template").agg(*sums)
    enough = lambda s: F.col(f"c{s}") >= tree.constant * F.col("n") if s == tree.shares else (F.col("n") > tree.depth) & (F.col(f"b{s}") >= tree.constant * (F.col("n") - tree.depth))
    named = F.array_compact(F.array(*[F.when(enough(s), F.xxhash64("leaf", f"x{s}", f"y{s}")) for s in range(tree.shares + 1)]))
    made = known.select("template", "leaf", "docs", "rows", "n").join(forms, "template")
    return made.select("template", "docs", "rows", F.explode(F.array_distinct(named)).alias("form"), F.lit(tree.docs_short).alias("least"))


def _cut(known: DataFrame, tree: Tree) -> DataFrame:
    """The same for long lines: those that are equal but for one run of tokens."""
    behind = F.col("n") - tree.depth

    def without(j: int) -> Column:
        a, b = ((tree.depth + F.floor(behind * x / tree.runs)).cast("int") for x in (j, j + 1))
        return F.xxhash64("leaf", F.lit(j), F.slice("tokens", 1, a), F.slice("tokens", b + 1, F.col("n") - b))

    long = known.where(F.col("n") >= tree.long_tokens)
    return long.select("template", "docs", "rows", F.explode(F.array(*map(without, range(tree.runs)))).alias("form"), F.lit(tree.docs_long).alias("least"))


def _without(lines: Column, drop: Column) -> Column:
    """The elements of ``lines`` whose positions are not in the sorted array ``drop``: the runs between them."""

    def run(j: Column) -> Column:
        start = F.when(j == 0, 0).otherwise(F.try_element_at(drop, j) + 1)
        end = F.when(j == F.size(drop), F.size(lines)).otherwise(F.try_element_at(drop, j + 1))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), run))


def drop_templates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """The input with ``text_col`` less its recurring lines, and n_lines, n_dropped.

    A recurring template stays in the document of least id that has it, so
    nothing is lost to the corpus; a line that recurs only within a document
    stays. Rows that share the least id all keep it. Blank lines are never dropped. Null texts stay null, with no lines;
    an empty text has one. Rows that repeat both id and text are one document.
    A null id sorts first. Whole texts are parsed, however long. Input columns
    named n_lines or n_dropped are replaced; others stay, whatever their names.
    A template that is generalised in several ways stays where the least of
    their ids says. Variable fields among the ``depth`` leading tokens are
    found by their digits only. An empty table gives an empty one.
    """
    tree = tree or Tree()
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = texts(df, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    lines = checkpoint(_lines(docs, tree))
    n_lines = lines.count()
    found = checkpoint(recurring(docs, lines, n_lines, tree).groupBy("template").agg(F.min("first").alias("first"), F.min("rows").alias("rows")))
    hit = join_hot(lines.select("template", "key", "doc_id", "pos"), found, "template", rows="rows", total=n_lines).where(F.col("doc_id") != F.col("first"))
    drops = hit.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    # The input's columns travel as one, so that none can clash with those of the join.
    joined = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_own")).join(drops, F.col("_own") == F.col("_key"), "left")
    own = F.col("_row").getField(text_col)
    left = let(F.split(own, "\n"), lambda x: F.array_join(_without(x, F.col("_drop")), "\n"))
    text = F.when(F.col("_drop").isNull(), own).otherwise(left)
    n_lines = F.when(own.isNull(), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1)
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names], n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
