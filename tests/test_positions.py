"""Places in an order, joins by place, schema columns."""

import random

from millrace.functions import ddl
from millrace.operators import positions


def test_places_with_ties_nulls_and_one_heavy_value(spark):
    rng = random.Random(5)
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randrange(200), f"k{rng.randrange(5000):04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = positions.positions(df, "a", "b", buckets=16, sampled=300).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert positions.positions(df.limit(0), "a").count() == 0
    assert [r.position for r in positions.positions(spark.createDataFrame([(1,), (1,)], "a int"), "a").orderBy("position").collect()] == [0, 1]


def test_joins_by_place(spark):
    details = spark.createDataFrame([(3, 0.0), (1, 1.0), (2, 0.0), (4, None), (5, 0.0)], "i int, score double")
    records = spark.createDataFrame([(10,), (30,), (20,)], "r int")
    joined = positions.by_position(details, records, details_order=("i",), records_order=("r",)).orderBy("position").collect()
    assert [(x.i, x.r) for x in joined] == [(1, 10), (2, 20), (3, 30), (4, None), (5, None)]
    wrong = positions.zero_samples(details, records, score="score", details_order=("i",), records_order=("r",), k=2)
    assert sorted((x.position, x.i, x.r) for x in wrong.collect()) == [(1, 2, 20), (2, 3, 30)]


def test_columns_of_tables():
    text = """-- CREATE TABLE no (x INT);
    create temp table if not exists main."Big, Zoo" (id INT primary key, "first name" varchar(10, 2) default 'a, b (', `n``1` int, [k] int, PRIMARY KEY (id, k),
      CONSTRAINT c FOREIGN KEY (k) REFERENCES t (id, u)) ; /* CREATE TABLE no2 (y INT) */
    CREATE TABLE t AS SELECT 1; CREATE TABLE u (a decimal(4,2), b enum('x)','y')"""
    assert ddl.table_columns(text) == {"Big, Zoo": ["id", "first name", "n`1", "k"], "t": [], "u": ["a", "b"]}
    assert ddl.table_columns(None) == {} == ddl.table_columns("create table") == ddl.table_columns("select 1")
