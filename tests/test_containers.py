"""Arrow, SQLite and archive sources by round trip; distributed ranks against plain ones."""

import io
import json
import random
import sqlite3
import tarfile
import zipfile

import pyarrow as pa
import pytest


def test_arrow(spark, tmp_path):
    from millrace.sources import files

    table = pa.table({"x": [1, 2, 3], "y": ["a", None, "c"]})
    (tmp_path / "in").mkdir()
    with pa.OSFile(str(tmp_path / "in" / "a.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, 2)
    with pa.OSFile(str(tmp_path / "in" / "b.arrow"), "wb") as f, pa.ipc.new_stream(f, table.select(["x"]).schema) as w:
        w.write_table(table.select(["x"]))
    got = files.read_records(spark, str(tmp_path / "in"), "arrow").collect()
    assert sorted((r.x, r.y or "") for r in got) == [(1, ""), (1, "a"), (2, ""), (2, ""), (3, ""), (3, "c")]


def test_sqlite(spark, tmp_path):
    from millrace.sources import containers

    for n in range(2):
        with sqlite3.connect(tmp_path / f"{n}.db") as link:
            link.execute('CREATE TABLE "we b"(id INTEGER, url TEXT)')
            link.executemany('INSERT INTO "we b" VALUES (?, ?)', [(10 * n + i, None if i == 0 else f"u{i}") for i in range(3)])
        link.close()
    got = containers.read_sqlite(spark, str(tmp_path), "we b", "id long, url string", rows=2).collect()
    assert sorted((r.id, r.url) for r in got if r.url) == [(1, "u1"), (2, "u2"), (11, "u1"), (12, "u2")] and len(got) == 6


def test_archives(spark, tmp_path):
    from millrace.sources import containers

    body = "﻿" + "\n".join(json.dumps({"x": i}) for i in range(3)) + "\n\n{broken\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.jsonl", body)
        z.writestr("d/.hidden.jsonl", body)
        z.writestr("d/picture.png", b"\x00")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.jsonl")
        info.size = len(body.encode())
        t.addfile(info, io.BytesIO(body.encode()))
    got = containers.parse_lines(containers.read_archive(spark, str(tmp_path), rows=2), "x long").collect()
    assert sorted((r.member, r.line, r.x) for r in got) == [(m, i, i) for m in ("d/one.jsonl", "two.jsonl") for i in range(3)]


def test_first_list_of_each_document(spark, tmp_path):
    from millrace.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"data": [], "items": [{"v": 1}]}))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"data": [{"v": 2}], "items": [{"v": 3}]}))
    assert sorted(r.v for r in files.read_json(spark, str(tmp_path / "in")).collect()) == [1, 2]


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_below(spark, ranges):
    from millrace.operators.metrics import below

    rng = random.Random(3)
    rows = [(float(v), rng.randrange(5)) for v in rng.sample(range(-50, 50), 60)]
    df = spark.createDataFrame(rows, "v double, c long")
    got = {r.v: r.b for r in below(df, value_col="v", count_col="c", name="b", ranges=ranges).collect()}
    assert got == {v: sum(c for w, c in rows if w < v) for v, _ in rows}
    assert below(df.limit(0), value_col="v", count_col="c", name="b").count() == 0
