"""Number words, divisions, stems and containment against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers
from millrace.operators import dedup, stems


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_number_words(spark):
    cases = {
        "twenty-one": "21", "one hundred and five apples": "105", "two million three hundred thousand and seven": "2300007", "two point five": "2.5", "three point one four zero": "3.14",
        "nine hundred ninety nine": "999", "hundred": "100", "007": "7", "no numbers": "no numbers", "One": "1", "one, two": "2", "thousand thousand": "thousand thousand", "": "", "zero": "0",
        "two billion one": "2000000001", "five point zero": "5.0",
    }
    assert one(spark, answers.number_words, *cases) == list(cases.values())
    assert one(spark, answers.number_words, None) == [None]


def test_all_small_numbers_spelled(spark):
    def spell(n):
        if n < 20:
            return answers.SMALL[n]
        if n < 100:
            return answers.TENS[n // 10 - 2] + ("-" + answers.SMALL[n % 10] if n % 10 else "")
        for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
            if n >= size:
                return f"{spell(n // size)} {name}" + (f" and {spell(n % size)}" if n % size else "")
        return ""

    rng = random.Random(1)
    numbers = [*range(120), *(rng.randrange(10 ** rng.randint(2, 11)) for _ in range(400))]
    assert one(spark, answers.number_words, *map(spell, numbers)) == [str(n) for n in numbers]


def test_math_text_step_by_step(spark):
    cases = {"yx==5": "5", "$\\frac{1}{2}$": "\\frac{1}{2}", "\\text{seven}": "seven", "5\\%": "5\\", "x\\in(-\\infty,\\infty)": "\\mathbb{R}", " 12 dollars.": "12 dollars"}
    assert one(spark, lambda c: answers.strip_math(c, units=False), *cases) == list(cases.values())
    assert one(spark, answers.strip_math, "twenty five miles", "3 kg") == ["25", "3 "]


def test_divisions(spark):
    cases = {"1/2": "\\frac{1}{2}", " -3/04": "\\frac{-3}{4}", "\\sqrt{2}/2": "\\frac{\\sqrt{2}}{2}", "a/b": "a/b", "1/2/3": "1/2/3", "7": "7", "1.5/2": "1.5/2"}
    assert one(spark, answers.fix_division, *cases) == list(cases.values())


@pytest.mark.parametrize(
    ("word", "want"),
    list(zip(
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll dying news generalization oscillators dies enjoy".split(),
        "caress poni tie caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc hesit digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll die news gener oscil die enjoy".split(),
        strict=True,
    )),
)
def test_stems(word, want):
    assert stems.stem(word) == want


def test_rouge_takes_the_best_reference(spark):
    rows = [("The cats were running", ["a cat runs", "the cat was run home"]), ("", ["x"]), (None, ["x"]), ("x", []), ("x", None), ("x y", [None, "y x"])]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, r array<string>").select(stems.rouge_l_stemmed("p", "r")).collect()]
    assert got == pytest.approx([2 * 3 / 9, 0, 0, 0, 0, 0.5])  # the cat run
    rng = random.Random(4)
    for _ in range(100):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in "xy")
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert stems.common_length(x, y) == table[-1][-1]


def _plain(s):
    return " ".join((s or "").lower().split())


def test_chat_contamination_against_every_pair(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcde  ") for _ in range(n))
    bench = [(text(rng.randint(1, 400)), text(20)) for _ in range(30)] + [("Q " * 400, "x"), ("short", ""), ("p" * 3000, "y")]
    chats = []
    for i in range(400):
        u, a = rng.choice(bench)
        how = i % 8
        cut, size = rng.randint(0, 8), max(1, int(len(u) * rng.uniform(0.7, 1)))
        u = (u, u.upper(), u[cut : cut + size], text(rng.randint(1, 60)) + u, text(300), u[:501] + text(9), "  " + u.replace(" ", "\n "), text(40))[how]
        chats.append((i, u if i % 97 else None, a if i % 3 else text(10)))
    want = set()
    for i, u, a in chats:
        n, k = _plain(u), _plain(a)[:500]
        for bu, ba in bench:
            b = _plain(bu)
            inside = len(n) > 50 and len(b) > 50 and (n in b or b in n) and 0.8 <= len(n) / len(b) <= 1.25
            if (n[:500], k) == (b[:500], _plain(ba)[:500]) or n == b or inside:
                want.add(i)
    df, items = spark.createDataFrame(chats, "id int, user string, assistant string"), spark.createDataFrame(bench, "user string, assistant string")
    got = [r[0] for r in dedup.contaminated_chats(df, items, id_col="id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 50 < len(want) < 390
    assert dedup.contaminated_chats(df.limit(0), items, id_col="id").count() == 0 == dedup.contaminated_chats(df, items.limit(0), id_col="id").count()


def test_winnowing_never_misses(spark):
    """Any two texts with 60 characters in common share a hash."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab é😀") for _ in range(n))
    rows = []
    for _ in range(200):
        part = text(60)
        rows.append((text(rng.randint(0, 90)) + part + text(rng.randint(0, 90)), text(rng.randint(0, 90)) + part + text(rng.randint(0, 90))))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~F.arrays_overlap(dedup.winnowed(F.col("a"), 60), dedup.winnowed(F.col("b"), 60))).count() == 0
    assert df.select(dedup.winnowed(F.lit("x" * 59), 60)).first()[0] is None


def test_sides_of_a_chat(spark):
    rows = [([("system", "s"), ("User", ""), ("user", "q"), ("assistant", "a"), ("user", "z")], "top"), ([], "top"), (None, "top"), ([("assistant", "a")], None)]
    df = spark.createDataFrame(rows, "m array<struct<role string, content string>>, instruction string")
    got = df.select(*dedup.chat_sides(F.coalesce("m", F.array().cast("array<struct<role string, content string>>")), user=(F.col("instruction"),))).collect()
    assert [tuple(r) for r in got] == [("q", "a"), ("top", ""), ("top", ""), ("", "a")]


@pytest.mark.parametrize("name", ["verified_shares", "spelled_numbers"])
def test_costly_rows_are_spread(spark, name):
    """A small file of costly rows is no single task."""
    from millrace.plans import catalog, rules  # noqa: F401  (it adds to the catalog)

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
