"""Functions of SQL, code and log text, as Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.ddl import schema_names

STATS = ("select", "join", "(select", "group by", "order by", "limit")


def strip_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?m)^```[a-zA-Z]*[ \t]*$", ""), F.lit(" \t\r\n"))


def statements(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda s: F.trim(s, F.lit(" \t\r\n"))), lambda s: s != "")


def op_type(c: Column) -> Column:
    word = F.upper(F.regexp_extract(F.trim(c), r"^([A-Za-z]+)", 1))
    return F.when(word == "WITH", "SELECT").when(word == "", "UNKNOWN").otherwise(word)


def occurrences(c: Column, what: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(what)))) / len(what)).cast("long")


# What is looked for in a question, and in an error text, in this order.
INTENTS = (("DELETE", ("delete", "remove", "drop")), ("UPDATE", ("update", "set ")), ("INSERT", ("insert", "add ", "create record")), ("DDL", ("create table", "build table", "new table")))
CODE_FAILURES = (("timeout", ("TIMEOUT", "timed out", "TimeoutExpired")), ("syntax", ("SyntaxError", "IndentationError")), ("import", ("ModuleNotFoundError", "ImportError")), ("name", ("NameError",)), ("type", ("TypeError",)), ("assert", ("AssertionError",)), ("value", ("ValueError", "ZeroDivisionError")), ("index", ("IndexError",)), ("key", ("KeyError",)), ("recursion", ("RecursionError",)))
SQL_FAILURES = (("sql_syntax", ("syntax error", "parse error", "near")), ("sql_schema", ("no such table", "relation does not exist", "table not found", "column does not exist", "unknown column")), ("sql_type", ("type mismatch", "cannot cast", "invalid input syntax for")), ("sql_timeout", ("timeout", "canceling statement due to statement timeout")), ("sql_perf", ("out of memory", "too many rows", "full table scan")))


def first_of(c: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], other: str) -> Column:
    """The name of the first rule of which the text holds a mark; one pattern a rule, the text computed once."""

    def first(text: Column) -> Column:
        found = F.lit(other)
        for name, marks in reversed(rules):
            found = F.when(text.rlike("|".join(f"\\Q{m}\\E" for m in marks)), name).otherwise(found)
        return found

    return _once(c, first)


def intent(c: Column) -> Column:
    """What a question asks for, by the first rule that has a keyword; null asks to select."""
    return first_of(F.lower(F.coalesce(c, F.lit(""))), INTENTS, "SELECT")


def aligned(asked: Column, op: Column) -> Column:
    """Whether a statement's operation is what was asked for; WITH selects."""
    return F.when(asked == "DDL", op.isin("CREATE", "ALTER", "DROP")).when(asked == "SELECT", op.isin("SELECT", "WITH")).otherwise(asked == op)


def failure_stage(c: Column) -> Column:
    """The first matching rule for the error text of a program; case counts."""
    return first_of(F.coalesce(c, F.lit("")), CODE_FAILURES, "other")


# The exception that a stage is told by, where it has one; ``value`` may also be a ZeroDivisionError.
EXCEPTIONS = {"timeout": "Timeout", "syntax": "SyntaxError", "import": "ImportError", "name": "NameError", "type": "TypeError", "assert": "AssertionError", "value": "ValueError", "index": "IndexError", "key": "KeyError", "recursion": "RecursionError"}


def failure_report(head: Column, error: Column, tail: Column) -> Column:
    """struct<stage, exception, place, detail> of a program's failure, by the first lines of its errors, its error text and the last of its output.

    The place (file:line) is that of a syntax error, the detail an assertion's
    message or the module that is missing; empty where nothing is told.
    """

    def told(text: Column) -> Column:
        def by(stage: Column) -> Column:
            name = F.coalesce(*[F.when(stage == k, v) for k, v in EXCEPTIONS.items()], F.lit(""))
            name = F.when((stage == "value") & ~text.contains("ValueError"), "ZeroDivisionError").otherwise(name)
            file, line = (F.regexp_extract(text, r'File "([^"]+)", line (\d+)', i) for i in (1, 2))
            place = F.when((stage == "syntax") & (file != ""), F.concat(file, F.lit(":"), line)).otherwise("")
            module = F.regexp_extract(text, r"ModuleNotFoundError: No module named '([^']+)'", 1)
            message = F.trim(F.regexp_extract(text, r"AssertionError[: ](.*)", 1))
            detail = F.when(stage == "import", module).when(stage == "assert", message).otherwise("")
            return F.struct(stage.alias("stage"), name.alias("exception"), place.alias("place"), detail.alias("detail"))

        return _once(failure_stage(text), by)

    return _once(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (head, error, tail)]), told)


def log_metric(c: Column, name: str) -> Column:
    """The value of ``name`` in a training log line: ``'name': x``, ``name=x`` or ``name: x``."""
    return F.regexp_extract(c, rf"(?:^|[^A-Za-z_]){name}'?\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: Functions that make one value of a group.
AGGREGATES = ("count", "sum", "avg", "min", "max", "group_concat", "total")


def _flat(c: Column) -> Column:
    """As long as the text, with dots for what stands in parentheses; cut at parentheses, so that a step takes a whole piece."""
    def step(a: Column, x: Column) -> Column:
        depth = F.when(x == ")", F.greatest(a["d"] - 1, F.lit(0))).otherwise(a["d"])
        shown = F.when(depth > 0, F.repeat(F.lit("."), F.length(x))).otherwise(x)
        return F.struct(F.when(x == "(", depth + 1).otherwise(depth).alias("d"), F.concat(a["s"], F.array(shown)).alias("s"))

    none = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("s"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(r"([()]|[^()]+)"), F.lit(1)), none, step, lambda a: F.array_join(a["s"], ""))


def _listed(c: Column, flat: Column, before: str, after: str) -> Column:
    """What commas outside of parentheses part between two patterns, as written in ``c``."""
    head = F.length(F.regexp_extract(flat, rf"(?is)^(.*?{before})", 1))
    body = F.regexp_extract(flat, rf"(?is)^.*?{before}(.*?)(?:{after})", 1)

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.trim(F.substr(c, a["at"], F.length(x))))).alias("out"))

    none = F.struct((head + 1).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(body, ","), none, step, lambda a: a["out"])


def ungrouped(c: Column) -> Column:
    """Selected items that are neither aggregates nor grouped, in lower case without aliases; empty without GROUP BY.

    Commas and keywords inside parentheses, however deep, do not part items or
    clauses. A column is grouped with or without the name of its table.
    """
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?s)^\s*distinct\s+|\s+as\s+\S+\s*$", ""), F.lit(" \t\r\n"))
    last = lambda x: F.when(x.rlike(r"^[\w.\"`]+$"), F.substring_index(x, ".", -1)).otherwise(x)

    def missing(flat: Column) -> Column:
        grouped = F.transform(_listed(c, flat, r"\bgroup\s+by\b", r"\bhaving\b|\border\b|\blimit\b|;|$"), bare)
        items = F.filter(_listed(c, flat, r"\bselect\b", r"\bfrom\b"), lambda x: ~x.rlike(r"(?i)\b(?:" + "|".join(AGGREGATES) + r")\s*\("))
        named = F.filter(F.transform(items, bare), lambda x: ~x.isin("", "*"))
        return _once(F.transform(grouped, last), lambda g: F.filter(named, lambda x: ~F.array_contains(g, last(x))))

    return F.when(c.rlike(r"(?i)\bgroup\s+by\b"), _once(_flat(c), missing)).otherwise(F.array().cast("array<string>"))


def tables(ddl: Column) -> Column:
    """Names of the tables that statements create, in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(ddl, F.lit(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"\[]?(\w+)"), F.lit(1)), F.lower)))


def evidence(question: Column, ddl: Column, error: Column) -> Column:
    """What a prompt says of the year meant, of the schema and of the last error; empty if nothing. The sentences are fixed values."""
    years = F.regexp_extract(F.coalesce(question, F.lit("")), r"(?i)last\s+(\d+)\s+years?", 1)
    names = schema_names(ddl, 20, 40)
    listed = lambda what, a: F.when(F.size(a) > 0, F.concat(F.lit(what), F.array_join(a, ", "), F.lit(".")))
    parts = (
        F.when(years != "", F.concat(F.lit("Current year is 2023, so last "), years, F.lit(" years means [2023-"), years, F.lit("+1, 2023]."))),
        listed("Allowed tables: ", names["tables"]),
        listed("Allowed columns (partial): ", F.slice(names["columns"], 1, 20)),
        F.when(error != "", F.concat(F.lit("Execution feedback: "), error)),
    )
    said = F.concat_ws(" ", *parts)
    return F.when(said != "", F.concat(F.lit("Evidence: "), said)).otherwise("")


def leak_free(ddl: Column, answer: Column, longer_than: int = 10) -> Column:
    """Schema statements but those that equal, hold or lie in the whole answer; fences are cut, and both are compared in lower case with white space collapsed."""
    plain = lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))

    def kept(a: Column) -> Column:
        leak = lambda s: (a != "") & (F.length(plain(s)) > longer_than) & (plain(s).contains(a) | a.contains(plain(s)))
        return F.filter(statements(strip_fences(F.coalesce(ddl, F.lit("")))), lambda s: ~leak(s))

    return _once(plain(strip_fences(F.coalesce(answer, F.lit("")))), kept)


def sanitized(ddl: Column, answer: Column) -> Column:
    """struct<schema, leaked>: the statements that do not tell the answer, each ended by a semicolon, and whether any did."""
    def made(kept: Column) -> Column:
        schema = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ";\n"), F.lit(";"))).otherwise("")
        return F.struct(schema.alias("schema"), (F.size(kept) < F.size(statements(strip_fences(F.coalesce(ddl, F.lit("")))))).alias("leaked"))

    return _once(leak_free(ddl, answer), made)


# What is counted in a statement in lower case.
COUNTED = {"selects": ("select",), "joins": (" join ",), "subqueries": ("(select",), "aggregations": (" count(", " sum(", " avg(", " min(", " max("), "group_by": (" group by ",), "order_by": (" order by ",), "limits": (" limit ",)}


def statement_counts(c: Column) -> Column:
    """struct of the length and the counts of ``COUNTED``, matches that do not overlap; null counts as empty."""
    def counted(q: Column) -> Column:
        sums = [sum((occurrences(q, w) for w in words[1:]), occurrences(q, words[0])).alias(k) for k, words in COUNTED.items()]
        return F.struct(F.length(q).cast("long").alias("length"), *sums)

    return _once(F.lower(F.coalesce(c, F.lit(""))), counted)


def suspicious_numbers(sql: Column, question: Column) -> Column:
    """Distinct numbers of one to four digits in a statement that the question does not hold; 0 and 1 are never suspicious."""
    found = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(\d{1,4})\b"), F.lit(1))
    return F.array_except(F.array_distinct(found(sql)), F.concat(found(question), F.array(F.lit("0"), F.lit("1"))))


def sql_failure_stage(c: Column) -> Column:
    """The first matching rule for a database's error text, in any case."""
    return first_of(F.lower(F.coalesce(c, F.lit(""))), SQL_FAILURES, "other")


# What code statistics count as tokens and definitions, and the words that they count by name.
CODE_WORD = r"[\p{L}\p{N}_]+"
CODE_TOKEN = CODE_WORD + r"|[^\s\x1c-\x1f\x85\p{Z}]"
CODE_DEF = r"(?m)^\s*def\s+\w+\("
CODE_COUNTS = {"loops": ("for", "while"), "branches": ("if", "elif", "case"), "tries": ("try", "except", "finally")}


def code_statistics(c: Column) -> Column:
    """struct of lines, tokens, defs, the counts of ``CODE_COUNTS`` and a cyclomatic number of one more than those together; null counts as empty, without a line."""

    def counted(text: Column) -> Column:
        def by_name(tokens: Column) -> Column:
            n = {k: F.size(F.filter(tokens, lambda w: w.isin(*words))).cast("long") for k, words in CODE_COUNTS.items()}  # noqa: B023
            defs = F.size(F.regexp_extract_all(text, F.lit(f"({CODE_DEF})"), F.lit(1))).cast("long")
            lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
            return F.struct(lines.alias("lines"), F.size(tokens).cast("long").alias("tokens"), defs.alias("defs"), *[v.alias(k) for k, v in n.items()], (n["loops"] + n["branches"] + n["tries"] + 1).alias("cyclomatic"))

        return _once(F.regexp_extract_all(text, F.lit(f"({CODE_TOKEN})"), F.lit(1)), by_name)

    return _once(F.coalesce(c, F.lit("")), counted)


def progress(c: Column) -> Column:
    """struct<done, total, percent> of a progress bar's ``| 101/339 [``; null without one."""
    at = lambda n: F.regexp_extract(c, r"\|\s*(\d+)/(\d+)\s*\[", n).try_cast("long")
    return F.when(at(2) > 0, F.struct(at(1).alias("done"), at(2).alias("total"), F.round(100 * at(1) / at(2), 2).alias("percent")))


def total_steps(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)total optimization steps\s*[=:]\s*([0-9,]+)", 1).try_cast("long")
