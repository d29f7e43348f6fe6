"""Programming problems, their tests and their failures, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.sqltext import first_of

# What a problem is called by the first of these rules of which its text holds a word.
PROBLEM_TYPES = (
    ("string", ("string", "palindrome", "anagram")), ("list/array", ("list", "array")),
    ("math", ("prime", "gcd", "lcm", "factorial", "divisors", "math")), ("dp", ("dynamic program", "dp", "subproblem")),
    ("greedy", ("greedy",)), ("tree", ("tree", "bst", "traversal")), ("graph", ("graph", "bfs", "dfs", "dijkstra", "topo")),
    ("matrix", ("matrix",)), ("hash/map", ("hash", "dictionary", "map")), ("two-pointers", ("two pointers",)),
    ("sorting", ("sort", "sorted", "sorting")),
)


def problem_type(c: Column) -> Column:
    return first_of(F.lower(F.coalesce(c, F.lit(""))), PROBLEM_TYPES, "general")


def io_difference(log: Column) -> Column:
    """struct<failing, expected, got> of the first failed equality in a test log, whole; nulls without one.

    Where the log shows no value and the failing expression speaks of None, None is what it got.
    """
    s = F.coalesce(log, F.lit(""))
    forms = (r"E\s+assert\s+(.*)\s*==\s*(.*)", r"AssertionError[: ]\s*assert\s+(.*)\s*==\s*(.*)")
    side = lambda i: F.coalesce(*[F.when(s.rlike(f), F.trim(F.regexp_extract(s, f, i))) for f in forms])
    got = F.nullif(F.trim(F.regexp_extract(s, r"E\s+\+\s+where\s+.*=\s*(.*)", 1)), F.lit(""))
    return F.struct(side(1).alias("failing"), side(2).alias("expected"), F.coalesce(got, F.when(side(1).contains("None"), "None")).alias("got"))


def entry_point(code: Column) -> Column:
    """The name of the first function that a program defines; empty without one."""
    return F.coalesce(F.regexp_extract(code, r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1), F.lit(""))


def checks(test: Column, entry: Column) -> Column:
    """The assertions of a test program, one an element, that call ``entry`` instead of ``candidate``."""
    parts = F.split(F.coalesce(test, F.lit("")), "assert ")
    stated = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("assert "), F.regexp_replace(x, r"[ \n\r]+$", "")))
    return F.transform(F.filter(stated, lambda x: x.startswith("assert ")), lambda x: F.replace(x, F.lit("candidate"), entry))


def signature_prompt(code: Column, text: Column) -> Column:
    """What stands before a program's first body, then the task as its docstring."""
    head = F.rtrim(F.regexp_extract(F.coalesce(code, F.lit("")), r"(?s)^(.*?def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(.*?\)\s*:)", 1))
    return F.concat(head, F.lit('\n    """'), text, F.lit('\n    """'))


def merged_tests(tests: Column, harder: Column) -> Column:
    """Both lists in order, each test once; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(tests, none), F.coalesce(harder, none)))


def url_lines(c: Column) -> Column:
    """The URLs of lines that start with ``URL:``, each once, in order."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.startswith("URL:"))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 5, 1 << 30), F.lit(" \t\r"))), lambda x: x != ""))
