"""Tables and columns that schema statements define."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Pieces of a statement: comments and white space, quoted names, strings, words, single signs.
_PIECE = re.compile(r"""(?xs) (?P<skip> \s+ | --[^\n]* | /\*.*?(?:\*/|\Z) ) | (?P<name> "(?:[^"]|"")*" | `(?:[^`]|``)*` | \[[^\]]*\] ) | (?P<string> '(?:[^']|'')*' ) | (?P<word> \w+ ) | (?P<sign> . )""")
#: What begins a definition that is no column.
_NO_COLUMN = {"primary", "foreign", "constraint", "unique", "check", "key", "index", "exclude", "like"}


def _pieces(ddl: str) -> list[tuple[str, str]]:
    """(kind, text) without white space and comments; quoted names lose their quotes."""
    found = ((m.lastgroup, m[0]) for m in _PIECE.finditer(ddl))
    return [(k, x[1:-1].replace(x[-1] * 2, x[-1]) if k == "name" else x) for k, x in found if k != "skip"]


def table_columns(ddl: str | None) -> dict[str, list[str]]:
    """Table -> columns, as written and in order, of all CREATE TABLE statements; a table defined twice has both lists."""
    pieces = _pieces(ddl or "")
    plain = [x.lower() if k == "word" else "" for k, x in pieces]
    found: dict[str, list[str]] = {}
    for at in range(len(pieces) - 2):
        if plain[at] != "create":
            continue
        i = at + 1 + (plain[at + 1] in ("temp", "temporary", "external"))
        if plain[i] != "table":
            continue
        i += 1
        if plain[i : i + 3] == ["if", "not", "exists"]:
            i += 3
        while i + 2 < len(pieces) and pieces[i + 1] == ("sign", "."):  # a schema's name before the table's
            i += 2
        if i >= len(pieces) or pieces[i][0] not in ("name", "word"):
            continue
        columns = found.setdefault(pieces[i][1], [])
        if i + 1 >= len(pieces) or pieces[i + 1] != ("sign", "("):
            continue
        depth, fresh = 1, True
        for j in range(i + 2, len(pieces)):
            kind, x = pieces[j]
            if fresh and depth == 1 and (kind == "name" or (kind == "word" and plain[j] not in _NO_COLUMN)):
                columns.append(x)
            fresh = kind == "sign" and x == "," and depth == 1
            depth += (kind == "sign") * ((x == "(") - (x == ")"))
            if not depth:
                break
    return found


@F.pandas_udf(ArrayType(StructType().add("table", "string").add("columns", ArrayType(StringType()))))
def _tables(ddl: pd.Series) -> pd.Series:
    known: dict[str, list] = {}

    def one(s: str | None) -> list:
        if s is None:
            return []
        if s not in known:
            known[s] = [{"table": t, "columns": c} for t, c in table_columns(s).items()]
        return known[s]

    return ddl.map(one)


def tables(ddl: Column) -> Column:
    """array<struct<table, columns>> in the order of the text, distinct texts of a batch read once; null has none.

    Parentheses, quotes and comments are understood, so a comma inside a type or a default parts nothing.
    """
    return _tables(ddl)


def redundant_ids(old: Column, new: Column) -> Column:
    """array<struct<table, column>>: columns ``<name>_id`` that ``new`` adds to a table that had ``id`` and is named like <name>.

    Both are columns that hold results of ``tables``. Names are compared in lower case; alike are names of which one holds the other.
    """
    low = lambda a: F.transform(a, F.lower)

    def had(table: Column) -> Column:
        same = F.filter(old, lambda o: F.lower(o["table"]) == table)
        return F.flatten(F.transform(same, lambda o: low(o["columns"])))

    def added(n: Column) -> Column:
        table = F.lower(n["table"])
        extra = F.array_sort(F.array_except(low(n["columns"]), had(table)))
        base = lambda c: F.regexp_replace(c, "_id$", "")
        like = F.filter(extra, lambda c: c.endswith("_id") & (table.contains(base(c)) | base(c).contains(table)))
        return F.when(F.array_contains(had(table), "id"), F.transform(like, lambda c: F.struct(table.alias("table"), c.alias("column")))).otherwise(F.array())

    return F.flatten(F.transform(new, added))


def schema_names(ddl: Column, most_tables: int = 20, most_columns: int = 40) -> Column:
    """struct<tables, columns>: distinct names, sorted, blanks as underscores; as many as a prompt takes."""
    found = tables(ddl)
    ordered = lambda a, n: F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: F.replace(x, F.lit(" "), F.lit("_"))), lambda x: x != ""))), 1, n)
    both = F.transform(F.array(found), lambda f: F.struct(ordered(F.transform(f, lambda t: t["table"]), most_tables).alias("tables"), ordered(F.flatten(F.transform(f, lambda t: t["columns"])), most_columns).alias("columns")))
    return both[0]
