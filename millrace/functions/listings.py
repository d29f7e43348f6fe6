"""Long listings in parts that a prompt takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "File list"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(c: Column) -> Column:
    """The lines of a text; a break at its end begins no line. Null and empty texts have none."""
    parts = F.split(F.coalesce(c, F.lit("")), _BREAK, -1)
    return F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))[0]


def _starts(lines: Column, max_chars: int, max_lines: int) -> Column:
    """Where each part begins, from 1: lines are added in order while both limits hold; a longer line is a part of its own."""

    def step(a: Column, line: Column) -> Column:
        size = F.length(line) + 1
        full = (a["held"] > 0) & ((a["chars"] + size > max_chars) | (a["held"] >= max_lines))
        fresh = full | (a["at"] == 1)
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(fresh, 1).otherwise(a["held"] + 1).alias("held"),
            F.when(fresh, size).otherwise(a["chars"] + size).alias("chars"),
            F.when(fresh, F.concat(a["starts"], F.array(a["at"]))).otherwise(a["starts"]).alias("starts"),
        )

    none = F.struct(F.lit(1).alias("at"), F.lit(0).alias("held"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(lines, none, step, lambda a: a["starts"])


def listing_parts(c: Column, *, max_chars: int = 8000, max_lines: int = 200) -> Column:
    """array<string>: a listing in parts of at most so many characters, breaks included, and lines, each under a header that counts them.

    A first line that begins with ``File list`` is the header, in any case. A
    listing of one part, or of a header alone, stays as it is; null and empty
    have none. Only the parts' first places are kept while lines are read, so
    a step does not grow with the listing.
    """

    def made(lines: Column) -> Column:
        first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        headed = F.lower(F.trim(first)).startswith(HEADER.lower())
        body = F.when(headed, F.slice(lines, 2, F.size(lines))).otherwise(lines)
        header = F.when(headed, first).otherwise(HEADER)
        both = F.struct(body.alias("body"), header.alias("header"), _starts(body, max_chars, max_lines).alias("starts"))
        return F.transform(F.array(both), parts)[0]

    def parts(x: Column) -> Column:
        many = F.size(x["starts"])

        def part(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(x["starts"], i + 1), F.size(x["body"]) + 1)
            head = F.concat(x["header"], F.lit(" (chunk "), (i + 1).cast("string"), F.lit("/"), many.cast("string"), F.lit(")\n"))
            return F.concat(head, F.array_join(F.slice(x["body"], start, end - start), "\n"))

        return F.when(many <= 1, F.array(c)).otherwise(F.transform(x["starts"], part))

    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(lines_of(c)), made)[0])
