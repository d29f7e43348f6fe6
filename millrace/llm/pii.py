"""Personal data by candidate gradient boosting, in DataFrame functions only.

Exact rules give the base spans. Generators of high recall propose further
spans, which may overlap; boosted trees score their format and context, and a
threshold calibrated for each kind selects. What the trees learn from is not
what the rules find: every known span is rewritten as people hide or reformat
such data, with its context or without, and stands against look-alikes made
from it and against what the generators propose in the corpus. Four fifths of
the known spans fit the trees, the others calibrate the thresholds. Only counts
for each combination of bins come to the driver, and the trees go back as one
SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.boosting import boost, threshold
from millrace.llm.util import checkpoint, let, written

#: In the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
#: A match may start where no earlier character could have been its first, or right after another
#: match; possessive runs then give the leftmost matches of the plain patterns in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT = r"(?: ?[\[(]?\.[\])]? ?| ?[\[(]dot[\])] ?| dot )"
#: Proposals: kind and pattern.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:@| ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]{1,63}+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9A-Za-z.-])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:" + _DOT + r"[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "secret": r"(?<![0-9A-Za-z_])(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?[^ \t-\r\"']{6,200}+|(?=[A-Za-z_/+-]*[0-9])[0-9A-Za-z_/+-]{20,200}+)",
}
#: Secrets that are known by being assigned: what a name of one is set to.
ASSIGNED = r"(?<![0-9A-Za-z_])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?[0-9A-Za-z_/+-]{16,200}+"
#: What a text must hold to have a match: the patterns above are searched in no other.
NEEDS = {
    "email": ("@", " at ", "[at]", "(at)"),
    "phone": ("0-9",),
    "card": ("0-9",),
    "ip": ("0-9",),
    "secret": ("0-9", "=", ":"),
}
#: Words before a candidate that speak for its kind, and such that speak against any.
CUES = {
    "email": r"(?i)mail|contact|write",
    "phone": r"(?i)tel|phone|call|fax|mobile|\+[0-9]{1,3} ?$",
    "card": r"(?i)card|visa|account|credit",
    "ip": r"(?i)\bip|host|addr|server",
    "secret": r"(?i)passw|secret|token|key|auth|bearer",
}
AGAINST = r"(?i)order|invoice|version|build|commit|sha|md5|isbn|page|\bno\b|number|date|\bid\b|serial|model"
FEATURES = ("f_digits", "f_letters", "f_length", "f_mark", "f_hidden", "f_groups", "f_first", "f_check", "f_cue", "f_against", "f_before", "f_after", "f_upper", "f_assign", "f_hex")


@dataclass(frozen=True)
class Choice:
    """precision: share of positives from a kind's threshold on, among known spans held out, look-alikes
    and proposals of the corpus. rounds, depth: of the trees. context: characters before a candidate that
    are searched for cues. made: known spans of each kind that are made up besides those of the corpus,
    so that a small corpus trains too."""

    precision: float = 0.95
    rounds: int = 40
    depth: int = 4
    context: int = 24
    made: int = 256


_SPAN = "array<struct<start: int, end: int, s: string, before: string, after: string>>"


def _sums(lengths: Column) -> Column:
    """Sums of all lengths up to each, in parts of 64, so that long arrays are not copied for each element."""
    none = F.expr("cast(array() as array<int>)")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int")), lambda b: F.slice(lengths, b * 64 + 1, 64))
    inner = F.transform(parts, lambda p: F.aggregate(p, none, lambda a, x: F.concat(a, F.array(last(a) + x))))

    def shifted(done: Column) -> Column:
        offsets = F.aggregate(done, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(last(a) + last(p))))
        return let(offsets, lambda o: F.flatten(F.transform(done, lambda p, i: F.transform(p, lambda x: x + o[i]))))

    return let(inner, shifted)


def _spans(text: Column, pattern: str, context: int) -> Column:
    """All matches, in code points, end exclusive, with ``context`` characters before them, none of another match, and one behind."""
    none = F.expr(f"cast(array() as {_SPAN})")

    def placed(m: Column, gaps: Column) -> Column:
        def one(s: Column, i: Column, ends: Column) -> Column:
            before, behind = gaps[i], gaps[i + 1]
            return F.struct((ends[i] - F.length(s)).alias("start"), ends[i].alias("end"), s.alias("s"), F.right(before, F.lit(context)).alias("before"), F.left(behind, F.lit(1)).alias("after"))

        lengths = F.transform(m, lambda s, i: F.length(gaps[i]) + F.length(s))
        return let(_sums(lengths), lambda ends: F.transform(m, lambda s, i: one(s, i, ends)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps))))


def _gated(text: Column, needs: tuple[str, ...], found: Column, kind: str) -> Column:
    """``found`` where the text has one of the needs, else an empty array of its kind."""
    gate = F.lit(False)
    for n in needs:
        gate = gate | (text.rlike("[0-9]") if n == "0-9" else text.contains(n))
    return F.when(gate, found).otherwise(F.expr(f"cast(array() as {kind})"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3
        small = lambda x: F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(s, r"\."), lambda x: part(x) & small(x))
    if kind == "card":
        return let(_digits(s), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _kinds(text: Column, context: int) -> Column:
    """All base spans: array<struct<start, rank, end, s, before, after>>, sorted."""

    def of(kind: str) -> Column:
        needs = {"email": ("@",), "phone": ("+",)}.get(kind, ("0-9",))
        found = _gated(text, needs, _spans(text, BASE[kind], context), _SPAN)
        fits = F.filter(found, lambda x: _valid(kind, x["s"]))
        return F.transform(fits, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))

    return F.array_sort(F.concat(*map(of, BASE)))


def _bin(c: Column, edges: tuple[int, ...]) -> Column:
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges[1:]), F.when(c >= edges[0], 1).otherwise(0))


def _edge(c: Column) -> Column:
    """0: no character, 1: white space, 2: letter, 3: digit, 4: other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _check(kind: str, s: Column) -> Column:
    """0: the kind has no check, 1: failed, 2: passed."""
    if kind == "card":
        return F.when(let(_digits(s), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))), 2).otherwise(1)
    if kind == "ip":
        return F.when(s.contains(":"), 0).when(F.forall(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255), 2).otherwise(1)
    if kind == "email":
        return F.when(s.rlike(r"(?:[a-z]{2,6}|[A-Z]{2,6})$"), 2).otherwise(1)
    return F.lit(0)


_FOUND = "array<struct<start: int, rank: int, end: int, " + ", ".join(f"{f}: int" for f in FEATURES) + ">>"


def _candidates(text: Column, context: int) -> Column:
    """array<struct<start, rank, end, f_...>> of what the generators propose."""

    def described(kind: str, x: Column) -> Column:
        s, before = x["s"], x["before"]
        n = lambda p: F.length(s) - F.length(F.regexp_replace(s, p, ""))
        groups = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
        flag = lambda c: c.cast("int")
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"),
            _bin(n("[0-9]"), (1, 7, 9, 10, 11, 12, 14, 17)).alias("f_digits"), _bin(n("[A-Za-z]"), (1, 4, 10, 20)).alias("f_letters"), _bin(F.length(s), (8, 12, 16, 20, 28, 40)).alias("f_length"),
            F.when(s.contains("-"), 1).when(s.contains(":"), 2).when(s.contains("/"), 3).when(s.contains(" "), 4).when(s.contains("."), 5).otherwise(0).alias("f_mark"),
            F.when(s.rlike(r"[\[(](?:at|dot|\.)[\])]"), 2).when(s.rlike(" dot "), 1).otherwise(0).alias("f_hidden"),
            F.least(F.size(groups), F.lit(9)).alias("f_groups"), F.coalesce(F.least(F.length(F.try_element_at(groups, F.lit(1))), F.lit(6)), F.lit(0)).alias("f_first"), _check(kind, s).alias("f_check"),
            flag(before.rlike(CUES[kind])).alias("f_cue"), flag(before.rlike(AGAINST)).alias("f_against"), _edge(F.right(before, F.lit(1))).alias("f_before"), _edge(x["after"]).alias("f_after"),
            F.when(s.rlike("[A-Z]") & s.rlike("[a-z]"), 3).when(s.rlike("[A-Z]"), 2).when(s.rlike("[a-z]"), 1).otherwise(0).alias("f_upper"), flag(s.rlike("[=:]")).alias("f_assign"),
            flag(s.rlike("^[0-9a-f]+$")).alias("f_hex"),
        )

    def proposed(kind: str) -> Column:
        return _gated(text, NEEDS[kind], F.transform(_spans(text, GENERATORS[kind], context), lambda x: described(kind, x)), _FOUND)

    return F.concat(*map(proposed, GENERATORS))


def _known(docs: DataFrame, choice: Choice) -> DataFrame:
    """The input with base (spans by the rules), assigned (secrets) and cands."""
    text, n = F.col("text"), choice.context
    secrets = _gated(text, NEEDS["secret"], _spans(text, ASSIGNED, n), _SPAN)
    return docs.select("*", _kinds(text, n).alias("base"), secrets.alias("assigned"), _candidates(text, n).alias("cands"))


def _made(spark, n: int) -> DataFrame:  # noqa: ANN001
    """rank, s, before, after: made-up spans of every kind, other ones for each number."""
    h = F.sha1(F.concat(F.lit("span "), F.col("id").cast("string")))
    number = F.conv(F.substring(h, 1, 15), 16, 10).try_cast("decimal(20,0)").cast("string")
    part = lambda at: (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % 256).cast("string")
    body = F.concat(F.lit("4"), F.lpad(F.right(number, F.lit(14)), 14, "7"))
    card = let(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), _luhn), lambda x: x[0])
    phone = F.concat(F.lit("+1"), F.lpad(F.right(number, F.lit(10)), 10, "5"))
    letters, length = F.translate(h, "0123456789", "klmnrstvwz"), lambda at: F.conv(F.substring(h, at, 1), 16, 10).cast("int")
    name = F.concat(F.substr(letters, F.lit(1), 2 + length(31) % 9), F.array(F.lit("."), F.lit("_"), F.lit(""), F.lit("."))[length(32) % 4], F.substr(letters, F.lit(12), 1 + length(33) % 8), F.when(length(34) < 5, F.concat(length(35), length(36))).otherwise(""))
    host = F.concat(F.substr(letters, F.lit(20), 3 + length(37)), F.when(length(38) < 6, ".example").otherwise(""), F.array(*[F.lit(x) for x in (".com", ".org", ".net", ".de", ".io", ".co.uk")])[length(39) % 6])
    email = F.concat(name, F.lit("@"), host)
    of = {"email": email, "ip": F.concat_ws(".", *[part(a) for a in (3, 9, 15, 21)]), "card": card, "phone": phone, "secret": h}
    before, after = F.array(*[F.lit(x) for x in ("the ", "and then ", "\n", "write: ")])[F.col("id") % 4], F.array(F.lit(" "), F.lit("."), F.lit("\n"))[F.col("id") % 3]
    each = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("rank"), c.alias("s")) for k, c in of.items()])
    return spark.range(n).select(F.explode(each).alias("x"), before.alias("before"), after.alias("after")).select("x.rank", "x.s", "before", "after")


def _rewritten(kind: str, s: Column, before: Column) -> list[tuple[Column, Column, int]]:
    """(text before, form, label): how a span of the kind is hidden or written otherwise, and look-alikes made from it."""
    d, h, plain = _digits(s), F.sha1(s), F.lit("and ")
    forms: list[tuple[Column, Column, int]] = []

    def both(*made: Column) -> None:
        forms.extend((b, m, 1) for m in made for b in (before, plain))

    def alike(*made: tuple[str, Column]) -> None:
        forms.extend((F.lit(b), m, 0) for b, m in made)

    if kind == "email":
        name, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        both(*[F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))) for at, dot in ((" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", "."))])
        word = F.regexp_replace(F.substring(h, 1, 7), "[0-9]", "e")
        alike(("it ", F.concat(F.lit("was at "), word, F.lit(".Then"))), ("", F.concat(word, F.lit(" at home."), F.initcap(word))), ("look ", F.concat(F.lit("up at page."), F.lit("The"))))
    elif kind == "ip":
        both(*[F.replace(s, F.lit("."), F.lit(dot)) for dot in ("[.]", "(.)", "[dot]", " dot ")], F.regexp_replace(F.substring(h, 1, 32), "([0-9a-f]{4})(?=[0-9a-f])", "$1:"))
        large = F.array_join(F.transform(F.split(s, r"\."), lambda x: (x.try_cast("int") % 600 + 300).cast("string")), "[.]")
        alike(("", large), ("", F.replace(large, F.lit("[.]"), F.lit(" . "))), ("at ", F.lit("12:30:45:10")), ("mac ", F.regexp_replace(F.substring(h, 1, 12), "(..)(?=.)", "$1:")), ("version ", F.replace(large, F.lit("[.]"), F.lit("."))))
    elif kind == "card":
        cut = lambda x, by: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", "$1" + by)
        wrong = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 3) % 10).cast("string"))
        both(*[cut(d, by) for by in (".", "/", "_", "  ", " - ")])
        alike(*[(b, cut(wrong, by)) for b, by in (("", "."), ("", "/"), ("order no ", "_"), ("and ", "  "), ("the ", " "), ("serial ", ""))])
    elif kind == "phone":
        n = F.right(d, F.lit(10))
        a, b, c = F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 4)
        both(F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), *[F.concat_ws(by, a, b, c) for by in ("-", ".", " ")])
        alike(*[(x, F.concat_ws("-", a, b, c)) for x in ("order ", "invoice no ", "serial number ", "isbn ")], ("", F.concat_ws(".", F.left(a, F.lit(2)), b, F.left(c, F.lit(3)))), ("", F.concat_ws(" ", F.left(a, F.lit(2)), b, F.left(c, F.lit(3)))), ("", F.concat_ws("-", F.left(a, F.lit(2)), c, c)))
    else:
        value = F.regexp_extract(s, "([0-9A-Za-z_/+-]+)$", 1)
        both(value, F.concat(F.lit("AKIA"), F.upper(F.left(h, F.lit(16)))))
        forms.extend((F.lit(x), value, 1) for x in ("Bearer ", "key is ", "auth "))
        forms.extend((plain, F.concat(F.lit(x), value), 1) for x in ("api_key: ", "pwd=", "secret = \""))
        words = F.regexp_replace(F.left(h, F.lit(9)), "[0-9]", "o")
        alike(("commit ", h), ("sha1 ", h), ("md5 ", F.left(h, F.lit(32))), ("id ", F.regexp_replace(F.left(h, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")), ("", F.concat(words, F.lit("_chapter_1_of_the_"), words)), ("in ", F.concat(F.lit("usr/lib/python3/site/"), words)), ("", F.concat(words, F.lit("-"), words, F.lit("-"), words, F.lit("-2"))))
    return forms


def _lessons(known: DataFrame, choice: Choice) -> DataFrame:
    """rank, held, features, label, n: counts of what is learnt from, rewritten spans and the proposals of the corpus (label -1)."""
    rank = len(KINDS) - 1
    assigned = F.transform("assigned", lambda x: F.struct(F.lit(rank).alias("rank"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
    own = F.transform("base", lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after")))
    spans = known.select(F.explode(F.concat(own, assigned)).alias("x")).select("x.*").unionByName(_made(known.sparkSession, choice.made))
    spans = spans.withColumn("held", F.pmod(F.xxhash64("s", "before"), F.lit(5)) == 0)
    cases = F.array().cast("array<struct<before: string, form: string, label: int>>")
    for r, kind in enumerate(KINDS):
        made = F.array(*[F.struct(b.alias("before"), f.alias("form"), F.lit(y).alias("label")) for b, f, y in _rewritten(kind, F.col("s"), F.col("before"))])
        cases = F.when(F.col("rank") == r, made).otherwise(cases)
    cases = spans.select("rank", "held", "after", F.explode(cases).alias("c")).select(F.col("rank").alias("own"), "held", "c.label", F.concat("c.before", "c.form", "after").alias("text"), F.length("c.before").alias("a"), F.length("c.form").alias("n"))
    found = cases.select("own", "held", "label", "a", (F.col("a") + F.col("n")).alias("b"), F.explode(_candidates(F.col("text"), choice.context)).alias("x")).where("x.start < b AND x.end > a")
    lessons = found.select("x.rank", "held", *[f"x.{f}" for f in FEATURES], F.when(F.col("own") == F.col("x.rank"), F.col("label")).otherwise(0).alias("label"))
    # What the rules or the names of secrets tell of is no unknown proposal.
    new = F.expr(f"filter(cands, x -> NOT exists(base, b -> b.start < x.end AND b.end > x.start) AND NOT exists(assigned, b -> x.rank = {rank} AND b.start < x.end AND b.end > x.start))")
    corpus = known.select(F.explode(new).alias("x")).select("x.rank", (F.pmod(F.xxhash64("x"), F.lit(5)) == 0).alias("held"), *[f"x.{f}" for f in FEATURES], F.lit(-1).alias("label"))
    return lessons.unionByName(corpus).groupBy("rank", "held", *FEATURES, "label").agg(F.count(F.lit(1)).alias("n"))


def train(known: DataFrame, choice: Choice) -> dict[int, tuple[str, float]]:
    """rank of a kind -> (SQL of the margin over FEATURES, threshold).

    Proposals of the corpus count as negative, but together for no more than
    the positive ones, as some may be what no rule knows.
    """
    lines, made = _lessons(known, choice).collect(), {}
    for rank in sorted({r["rank"] for r in lines}):
        own = sorted(tuple(r) for r in lines if r["rank"] == rank)
        held, x = np.array([r[1] for r in own]), np.array([r[2 : 2 + len(FEATURES)] for r in own], np.int64)
        label, n = np.array([r[-2] for r in own]), np.array([r[-1] for r in own], float)
        n[label < 0] *= min(1.0, n[label > 0].sum() / max(1.0, n[label < 0].sum()))
        p = np.where(label > 0, n, 0.0)
        fit = ~held
        if p[fit].sum() and (n - p)[fit].sum() and held.any():
            model = boost(x[fit], n[fit], p[fit], choice.rounds, choice.depth)
            made[rank] = (model.sql([f"x.{f}" for f in FEATURES]), threshold(model.margin(x[held]), n[held], p[held], choice.precision))
    return made


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", choice: Choice | None = None) -> DataFrame:
    """doc_id, base, spans of each row; base and spans: array<struct<start, rank, end>>, sorted, spans with the base spans.

    Added spans overlap no base span. Null and empty texts have none. Whole
    texts are searched, however long. Repeated rows and rows with a null id
    each give a row; other columns, whatever their names, are not read. An
    empty table gives an empty one. There is no shuffle but for the counts of
    the training set, and every text is read once.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _found(checkpoint(_known(docs, choice or Choice()).drop("text")), choice or Choice())


def _found(known: DataFrame, choice: Choice) -> DataFrame:
    """The input with base and spans instead of what was known."""
    chosen = []
    for rank, (sql, least) in train(known, choice).items():
        if np.isfinite(least):
            chosen.append(f"(x.rank = {rank} AND ({sql}) >= {least:.9f}D)")
    own = F.expr(f"filter(cands, x -> NOT exists(base, b -> b.start < x.end AND b.end > x.start) AND ({' OR '.join(chosen) or 'false'}))")
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
    rest = [c for c in known.columns if c not in ("base", "assigned", "cands")]
    return known.select(*rest, bare(F.col("base")).alias("base"), F.array_sort(F.array_distinct(F.concat(bare(F.col("base")), bare(own)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), choice: Choice | None = None) -> DataFrame:
    """doc_id, and text with every span, overlapping ones as one, replaced by its kind in brackets.

    ``keep``: columns of the input to return instead, the text among them redacted and null texts empty.
    Of spans that overlap or lie in one another the first names the kind; spans that touch stay two.
    Rows that repeat, or have a null id, are redacted like any other.
    """
    rest = [c for c in keep if c not in (id_col, text_col)]
    plain = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    found = _found(written(_known(plain, choice or Choice())), choice or Choice())

    def join(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        grown = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(x)))

    none = F.expr("cast(array() as array<struct<start: int, rank: int, end: int>>)")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(m: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.try_element_at(m, i)["end"])
            return F.concat(F.substring(F.col("text"), start + 1, x["start"] - start), names[x["rank"]])

        return F.concat(F.array_join(F.transform(m, part), ""), F.substring(F.col("text"), F.element_at(m, -1)["end"] + 1, F.length("text")))

    merged = F.aggregate("spans", none, join)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(let(merged, cut))
    if not keep:
        return found.select("doc_id", text.alias("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col("doc_id").alias(c) if c == id_col else F.col(f"rest.{c}") for c in keep])
