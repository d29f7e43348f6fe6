"""Column roles of problem files, previews of files, short forms of values."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import previews
from millrace.operators import roles
from millrace.sources import files, preview


def _roles(spark, rows, kind):
    lines = spark.createDataFrame(rows, "file string, n int, line string")
    return {r.file: (r.roles, r.pred, r.ref) for r in roles.column_roles(lines, kind, file="file", order="n", line="line").collect()}


def test_roles_come_from_the_first_two_records(spark):
    rows = [
        ("a", 1, '{"question": 1, "answer": 2'), ("a", 2, ""), ("a", 3, None), ("a", 4, "[1]"),
        ("a", 5, '{"prompt": "x", "gold": "y"}'), ("a", 6, '{"query": "x", "output": 1, "pred": 2}'), ("a", 7, '{"input": "x"}'),
        ("b", 1, "{}"), ("c", 1, "broken"),
    ]
    assert _roles(spark, rows, "key2_qa") == {"a": ({"question": "query", "target": "gold", "prediction": "pred"}, "pred", "gold"), "b": ({}, "generated_ans", None)}


def test_a_name_has_one_role_by_kind(spark):
    line = '{"问题": 1, "answer": 2, "options": 3, "answers": 4, "text": 5, "chosen": 6, "better": 7, "label": 8}'
    got = {kind: _roles(spark, [("f", 1, line)], kind)["f"] for kind in roles.KINDS}
    assert got["key2_qa"] == ({"question": "问题", "target": "answer"}, "generated_ans", "answer")  # neither chosen nor label
    assert got["key2_q_ma"] == ({"question": "问题", "targets": "answers"}, "generated_ans", "answers")
    assert got["key3_q_choices_a"] == ({"question": "问题", "choices": "options", "label": "label"}, "eval_pred", "label")
    assert got["key3_q_choices_as"] == ({"question": "问题", "choices": "options", "labels": "answers"}, "eval_pred", "answers")
    assert got["key3_q_a_rejected"] == ({"question": "问题", "answer": "chosen", "better": "better"}, "generated_ans", "better")
    assert got["key1_text_score"] == ({"text": "text"}, "text", None)


def test_roles_without_lines(spark):
    assert _roles(spark, [], "key2_qa") == {}


def shrunk(v, limits, depth=0):
    """The same in plain Python, on parsed values."""
    if depth > limits.depth:
        return "<nested_too_deep>"
    if isinstance(v, bytes):
        return f"<bytes len={len(v)}>"
    if isinstance(v, str):
        return v if len(v) <= limits.chars else v[: limits.chars] + (f"...(truncated,len={len(v)})" if limits is previews.PREVIEW else "...")
    if isinstance(v, dict):
        out = {k: shrunk(x, limits, depth + 1) for k, x in list(v.items())[: limits.items]}
        if len(v) > limits.items:
            out |= {"__truncated_keys__": len(v) - limits.items} if limits is previews.PREVIEW else {"...": "..."}
        return out
    if isinstance(v, list):
        out = [shrunk(x, limits, depth + 1) for x in v[: limits.items]]
        return out + ([f"...({len(v) - limits.items} more items)" if limits is previews.PREVIEW else "..."] if len(v) > limits.items else [])
    return v if v is None or isinstance(v, bool | int | float) else str(v)


@pytest.mark.parametrize("limits", [previews.PREVIEW, previews.SAMPLE], ids=["preview", "sample"])
def test_shortened_equals_plain_python(spark, limits):
    shape = "s string, n array<array<string>>, m map<string,int>, b binary, f double, i int, t boolean, d date, p struct<`a.b`:string, c:array<int>>"
    deep = {"s": "é\"\n\\" + "x" * 3000, "n": [["y" * 201], None, [], [None, ""], ["z"]], "m": {"only": 1}, "b": b"abc", "f": 1.5, "i": None, "t": True, "d": datetime.date(2024, 1, 2), "p": {"a.b": "q", "c": list(range(60))}}
    empty = dict.fromkeys(deep)
    df = spark.createDataFrame([tuple(r.values()) for r in (deep, empty)], shape)
    got = [json.loads(r.j) for r in df.select(previews.shortened(F.struct(*df.columns), df.schema, limits).alias("j")).collect()]
    assert got == [shrunk(deep, limits), shrunk(empty, limits)]


def test_shortened_stops_at_depth(spark):
    shape, value = "int", 1
    for _ in range(16):
        shape, value = f"struct<x:{shape}>", {"x": value}
    df = spark.createDataFrame([(value,)], f"v {shape}")
    assert json.loads(df.select(previews.shortened(F.col("v"), df.schema["v"].dataType).alias("j")).first().j) == shrunk(value, previews.PREVIEW)


def test_bounded(spark):
    texts = ["a" * n for n in (0, 200, 201, 3000)]
    for most in (200, 100, 5):
        got = [r.b for r in spark.createDataFrame([(x,) for x in texts], "x string").select(previews.bounded(F.col("x"), most).alias("b")).collect()]
        for x, b in zip(texts, got, strict=True):
            long = f"\n...[record JSON truncated: original_chars={len(x)}, max={most}]"
            note = long if most - len(long) >= 64 else "\n...[truncated]"
            assert b == (x if len(x) <= most else x[: max(0, most - len(note))] + note)


def test_preview_of_kinds_and_encodings(spark, tmp_path):
    def shown(name, data, **options):
        (tmp_path / name).write_bytes(data)
        r = preview.preview(spark, str(tmp_path / name), **options).first()
        return r.encoding, r.columns, [json.loads(x) for x in r.records], r.error

    assert shown("a.jsonl", '{"x": 1}\n\nbroken\n{"y": "é"}\n'.encode()) == ("utf-8-sig", ["x", "y"], [{"x": 1, "y": None}, {"x": None, "y": "é"}], None)
    assert shown("b.jsonl", '{"问": "中文"}\n'.encode("gb18030"))[::2] == ("gb18030", [{"问": "中文"}])
    assert shown("c.csv", 'a,"b,c"\r\n1,"x, y"\r\n2,\r\n3,z\r\n'.encode("utf-8-sig"), max_rows=2) == ("utf-8-sig", ["a", "b,c"], [{"a": "1", "b,c": "x, y"}, {"a": "2", "b,c": None}], None)
    assert shown("d.txt", "eins\nzwei\n".encode()) == ("utf-8-sig", ["text"], [{"text": "eins"}, {"text": "zwei"}], None)
    assert shown("e.json", b'{"items": [{"k": 1}, {"k": 2}]}')[2] == [{"k": 1}, {"k": 2}]
    assert shown("f.txt", b"a\x00b") == (None, [], [], "likely_binary_file")
    assert shown("g.jsonl", b"") == (None, [], [], "no_records")
    assert shown("h.json", b"{")[3] == "no_records"
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    assert preview.preview(spark, str(tmp_path / "p.parquet"), max_rows=2).first().records == ['{"id":0}', '{"id":1}']


def test_looks_binary(spark):
    cases = [(b"", False), (b"\xff\xfe" + b"\x81" * 600, False), (b"\x81" * 600, True), (b"\x81" * 500, False), (b"a" * 17_000 + b"\x00", False), (b"a" * 16_000 + b"\x00", True)]
    got = spark.createDataFrame([(b,) for b, _ in cases], "b binary").select(files.looks_binary(F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [x for _, x in cases]
