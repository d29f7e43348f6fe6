"""Equal and unequal mathematics, against pairs and against exact fractions."""

import random
from fractions import Fraction

import pytest

from millrace.functions import mathequal
from millrace.functions.mathequal import equal

SAME = [
    ("1/2", "0.5"), ("\\frac{1}{2}", "\\frac12"), ("50%", "1/2"), ("\\frac{3\\sqrt{2}}{2}", "\\frac{3}{\\sqrt{2}}"), ("\\sqrt{12}", "2\\sqrt{3}"), ("\\sqrt[3]{16}", "2\\sqrt[3]{2}"),
    ("2^{10}", "1,024"), ("(x+1)^2", "x^2+2x+1"), ("\\frac{x^2-1}{x-1}", "x+1"), ("2\\pi r", "r \\cdot 2\\pi"), ("x=5", "5"), ("(1, 2)", "\\left(1,\\frac{4}{2}\\right)"),
    ("\\{1,2\\}", "\\{2, 1\\}"), ("-3", "\\frac{-6}{2}"), ("4^{1/2}", "2"), ("(-8)^{1/3}", "-2"), ("\\sqrt{2}\\cdot\\sqrt{6}", "2\\sqrt3"), ("1.50", "1.5"), ("3-\\sqrt{8}", "3 - 2\\sqrt{2}"),
    ("\\frac{1}{1+\\sqrt{2}}", "\\sqrt{2}-1"), ("\u03c0", "\\pi"), ("10^{-3}", ".001"), ("2(3+4)", "14"), ("\\frac{\\sqrt{6}+\\sqrt{2}}{4}", "\\frac{1}{\\sqrt6-\\sqrt2}"), ("\\sqrt{\\frac{4}{9}}", "2/3"),
]
OTHER = [("1/2", "0.51"), ("\\sqrt{2}", "1.41421356"), ("x+1", "x-1"), ("(1,2)", "(2,1)"), ("(1,2)", "[1,2]"), ("\\{1,2\\}", "\\{1,3\\}"), ("\\pi", "3.14"), ("2x", "x^2"), ("1,000", "1"), ("3", "(3,3)"), ("\\sqrt{2}+\\sqrt{3}", "\\sqrt{5}")]
OPEN = [("\\sin x", "\\sin x"), ("", "1"), ("1 2/3", "5/3"), ("\\sqrt{x^2}", "x"), ("\\sqrt{x+1}", "1"), ("1/0", "2"), ("2^{999}", "1"), ("2^x", "3"), (None, "1"), ("words", "1+"), ("(", "1"), ("9" * 60, "1"), ("\\sqrt{-1}", "1")]


@pytest.mark.parametrize(("pairs", "want"), [(SAME, True), (OTHER, False), (OPEN, None)])
def test_pairs(pairs, want):
    assert [(a, b) for a, b in pairs if equal(a, b) is not want or equal(b, a) is not want] == []


def test_against_exact_fractions():
    rng = random.Random(3)

    def made(depth):
        if not depth or rng.random() < 0.2:
            n = rng.randint(0, 12)
            return (str(n), Fraction(n)) if rng.random() < 0.7 else (f"{n}.25", Fraction(4 * n + 1, 4))
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        how = rng.randrange(5)
        if how == 0:
            return f"({a}) + {b}", x + y
        if how == 1:
            return f"{a} - ({b})", x - y
        if how == 2:
            return f"({a})\\cdot({b})", x * y
        if how == 3 and y:
            return f"\\frac{{{a}}}{{{b}}}", x / y
        return f"({a})^2", x * x

    for _ in range(300):
        text, value = made(4)
        assert equal(text, f"{value.numerator}/{value.denominator}") is True, text
        assert equal(text, f"{value.numerator + 1}/{value.denominator}") is False, text


def test_verified(spark):
    rows = [("The answer is $\\frac{1}{2}$.", "0.5"), ("it is 7", "7"), ("so \\boxed{\\sqrt{8}}", "2\\sqrt{2}"), ("x", None), (None, "1"), ("the answer is 3", "4"), ("", "")]
    got = [r.match for r in mathequal.verified(spark.createDataFrame(rows, "p string, r string"), pred="p", ref="r").collect()]
    assert got == ["math_verify", "text_match", "math_verify", "none", "none", "none", "none"]
