"""Whether two mathematical texts mean the same: exact arithmetic on a canonical form; what cannot be decided is null.

A text becomes a quotient of two sums. A sum maps a product of powers to an
exact fraction: variables, pi and primes under a root are the bases, and whole
powers of primes go into the fraction. Such sums are unique, so quotients are
equal exactly if their cross products are the same sum.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.functions.answers import contains_match, final_answer

Sum = dict[tuple, Fraction]
#: Beyond these an expression stays undecided.
MOST_TERMS, MOST_POWER, MOST_DIGITS, MOST_CHARACTERS = 200, 64, 40, 500

_PIECE = re.compile(r"\s*(?:(?P<number>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.?\d*|\.\d+)|\\(?P<name>[A-Za-z]+)|(?P<letter>[A-Za-z\u03c0])|(?P<sign>\S))")
_SPACE = re.compile(r"\\[,;:! ]|\\q?quad\b|\\displaystyle\b|~")


class Undecided(Exception):
    """The text is no expression of the kind that has a canonical form."""


def _number(value: Fraction | int) -> Sum:
    return {(): Fraction(value)} if value else {}


def _times(a: Sum, b: Sum) -> Sum:
    out: Sum = {}
    for x, c in a.items():
        for y, d in b.items():
            bases, factor = dict(x), c * d
            for base, power in y:
                power += bases.get(base, 0)
                if isinstance(base, int) and (whole := power.numerator // power.denominator):
                    factor, power = factor * Fraction(base) ** whole, power - whole
                bases[base] = power
            key = tuple(sorted(((k, v) for k, v in bases.items() if v), key=lambda kv: (str(type(kv[0])), kv[0])))
            out[key] = out.get(key, 0) + factor
    out = {k: v for k, v in out.items() if v}
    if len(out) > MOST_TERMS or any(len(str(v.numerator)) + len(str(v.denominator)) > 8 * MOST_DIGITS for v in out.values()):
        raise Undecided
    return out


def _plus(a: Sum, b: Sum) -> Sum:
    return {k: v for k in {**a, **b} if (v := a.get(k, Fraction(0)) + b.get(k, Fraction(0)))}


@cache
def _primes(n: int) -> tuple[tuple[int, int], ...]:
    found, p = [], 2
    while p * p <= n:
        if p > 100_000:
            raise Undecided
        many = 0
        while n % p == 0:
            n, many = n // p, many + 1
        if many:
            found.append((p, many))
        p += 1 + (p > 2)
    return (*found, (n, 1)) if n > 1 else tuple(found)


class Quotient:
    """A sum over a sum that is not zero."""

    def __init__(self, top: Sum, under: Sum | None = None):
        self.top, self.under = top, _number(1) if under is None else under
        if not self.under:
            raise Undecided

    def __add__(self, o: Quotient) -> Quotient:
        return Quotient(_plus(_times(self.top, o.under), _times(o.top, self.under)), _times(self.under, o.under))

    def __mul__(self, o: Quotient) -> Quotient:
        return Quotient(_times(self.top, o.top), _times(self.under, o.under))

    def inverse(self) -> Quotient:
        return Quotient(self.under, self.top)

    def same(self, o: Quotient) -> bool:
        return _times(self.top, o.under) == _times(o.top, self.under)

    def constant(self) -> Fraction | None:
        if set(self.top) | set(self.under) <= {()}:
            return self.top.get((), Fraction(0)) / self.under[()]
        return None

    def __pow__(self, power: Fraction) -> Quotient:
        if abs(power) > MOST_POWER:
            raise Undecided
        if power.denominator == 1:
            out, base = Quotient(_number(1)), self if power >= 0 else self.inverse()
            for _ in range(abs(power.numerator)):
                out = out * base
            return out
        return Quotient(_root(self.top, power), _root(self.under, power))


def _root(s: Sum, power: Fraction) -> Sum:
    """A single product of a positive fraction to a broken power; variables only where no even power hides a sign."""
    if not s:
        if power > 0:
            return {}
        raise Undecided
    if len(s) != 1:
        raise Undecided
    (key, c), = s.items()
    if c < 0:
        if power.denominator % 2 == 0:
            raise Undecided
        sign = -1 if power.numerator % 2 else 1
    else:
        sign = 1
    out = _number(sign)
    for n, way in ((abs(c.numerator), 1), (c.denominator, -1)):
        for p, many in _primes(n):
            out = _times(out, {((p, many * way * power),): Fraction(1)} if 0 < many * way * power < 1 else _times(_number(1), _whole(p, many * way * power)))
    for base, e in key:
        if not isinstance(base, int) and base != "pi" and (e.numerator % 2 == 0 or e.denominator > 1):
            raise Undecided
        out = _times(out, _whole(base, e * power) if isinstance(base, int) else {((base, e * power),): Fraction(1)})
    return out


def _whole(p: int, power: Fraction) -> Sum:
    whole = power.numerator // power.denominator
    rest = power - whole
    return {(((p, rest),) if rest else ()): Fraction(p) ** whole}


class _Reader:
    """Sums of products of powers, left to right; factors that stand together are multiplied."""

    def __init__(self, text: str):
        if len(text) > MOST_CHARACTERS:
            raise Undecided
        text = _SPACE.sub(" ", text).replace("\u2212", "-").replace("\u221a", "\\sqrt ")
        self.pieces: list[tuple[str, str]] = [(m.lastgroup or "", m[m.lastgroup or 0]) for m in _PIECE.finditer(text)]
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.pieces[self.at] if self.at < len(self.pieces) else ("", "")

    def take(self, *signs: str) -> str:
        kind, x = self.peek()
        if kind in ("sign", "name") and x in signs:
            self.at += 1
            return x
        return ""

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise Undecided

    def all(self) -> list[Quotient]:
        """The expressions that commas part."""
        found = [self.sum()]
        while self.take(",", ";"):
            found.append(self.sum())
        if self.at < len(self.pieces):
            raise Undecided
        return found

    def sum(self) -> Quotient:
        total = self.product()
        while sign := self.take("+", "-"):
            term = self.product()
            total = total + (term if sign == "+" else term * Quotient(_number(-1)))
        return total

    def product(self) -> Quotient:
        out = self.signed()
        while True:
            kind, x = self.peek()
            if self.take("*", "cdot", "times"):
                out = out * self.signed()
            elif self.take("/", "div"):
                out = out * self.signed().inverse()
            elif kind in ("number", "letter") or (kind == "sign" and x in "([{") or (kind == "name" and x in ("frac", "sqrt", "pi", "left")):
                if kind == "number" and self.at and self.pieces[self.at - 1][0] == "number":
                    raise Undecided  # two numbers in a row, or a mixed number
                out = out * self.power()
            else:
                return out

    def signed(self) -> Quotient:
        if self.take("-"):
            return self.signed() * Quotient(_number(-1))
        return self.signed() if self.take("+") else self.power()

    def power(self) -> Quotient:
        base = self.atom()
        if not self.take("^"):
            return base
        exponent = (self.atom() if self.peek()[1] != "-" else self.signed()).constant()
        if exponent is None:
            raise Undecided
        return base**exponent

    def braced(self) -> Quotient:
        """What braces hold, or one sign."""
        if not self.take("{"):
            kind, x = self.peek()
            if kind == "number" and len(x) > 1:  # \frac12
                self.pieces[self.at : self.at + 1] = [("number", c) for c in x]
            return self.atom()
        inner = self.sum()
        self.need("}")
        return inner

    def atom(self) -> Quotient:
        kind, x = self.peek()
        self.at += 1
        if kind == "number":
            if len(x) > MOST_DIGITS:
                raise Undecided
            value = Quotient(_number(Fraction(x.replace(",", "").rstrip(".") if not x.startswith(".") else "0" + x)))
            return value * Quotient(_number(Fraction(1, 100))) if self.take("%") else value
        if kind == "letter":
            return Quotient({(("pi" if x == "\u03c0" else x, Fraction(1)),): Fraction(1)})
        if x in ("left", "right"):
            return self.atom()
        if kind == "sign" and x in "([{":
            inner = self.sum()
            self.take("right")
            self.need({"(": ")", "[": "]", "{": "}"}[x])
            return inner
        if kind == "name" and x in ("frac", "dfrac", "tfrac"):
            top = self.braced()
            return top * self.braced().inverse()
        if kind == "name" and x == "sqrt":
            order = Fraction(2)
            if self.take("["):
                order = self.sum().constant() or Fraction(0)
                self.need("]")
            if order.denominator != 1 or order <= 0:
                raise Undecided
            return self.braced() ** (1 / order)
        if kind == "name" and x == "pi":
            return Quotient({(("pi", Fraction(1)),): Fraction(1)})
        raise Undecided


def _outer(text: str) -> tuple[str, str]:
    """Kind of the brackets round a list, and what they hold; an equation's last side."""
    text = re.sub(r"\\(?:left|right)\b", "", text.strip().strip("$").strip())
    text = text.rsplit("=", 1)[-1].strip().rstrip(".")
    held = re.fullmatch(r"(\(|\[|\\\{|\{)(.*,.*?)(\)|\]|\\\}|\})", text, re.S)
    return (held[1] + held[3], held[2]) if held and not re.fullmatch(r"\s*\d{1,3}(?:,\d{3})+\s*", held[2]) else ("", text)


@cache
def _read(text: str) -> tuple[str, list[Quotient]] | None:
    try:
        kind, inner = _outer(text)
        return kind, _Reader(inner).all()
    except (Undecided, ZeroDivisionError, OverflowError, RecursionError, ValueError):
        return None


def equal(a: str | None, b: str | None) -> bool | None:
    """Of two texts; sets compare in any order, other lists in theirs."""
    x, y = (_read(s) if s is not None and len(s) <= MOST_CHARACTERS else None for s in (a, b))
    if _read.cache_info().currsize > 100_000:
        _read.cache_clear()
    if x is None or y is None:
        return None
    try:
        if x[0] != y[0] or len(x[1]) != len(y[1]):
            return False
        if "{" in x[0]:
            return all(any(p.same(q) for q in y[1]) for p in x[1]) and all(any(p.same(q) for p in x[1]) for q in y[1])
        return all(p.same(q) for p, q in zip(x[1], y[1], strict=True))
    except Undecided:
        return None


@F.pandas_udf(BooleanType())
def math_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts are the same expression, number or list; null where that is not decided."""
    return pd.Series([equal(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")


def verified(df: DataFrame, *, pred: str, ref: str, name: str = "match") -> DataFrame:
    """``df`` and how its prediction meets its reference: ``text_match`` if one holds the other, loosely, itself or by its
    final answer; ``math_verify`` if that answer is equal; else ``none``. A null reference meets nothing."""
    said = df.withColumn("_said", final_answer(F.col(pred)))
    told = said.withColumn("_equal", math_equal("_said", ref)).withColumn("_text", contains_match(F.col(pred), F.col(ref)) | contains_match(F.col("_said"), F.col(ref)))
    match = F.when(F.col(ref).isNull(), "none").when(F.col("_text"), "text_match").when(F.col("_equal"), "math_verify").otherwise("none")
    return told.withColumn(name, match).drop("_said", "_equal", "_text")
