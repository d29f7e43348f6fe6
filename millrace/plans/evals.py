"""Queries of programming problems, schema texts and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import problems, sqltext
from millrace.operators import reports
from millrace.plans.catalog import query, t


@query("""SELECT doc_id, CASE WHEN regexp_matches(p, 'string|palindrome|anagram') THEN 'string' WHEN regexp_matches(p, 'list|array') THEN 'list/array' WHEN regexp_matches(p, 'prime|gcd|lcm|factorial|divisors|math') THEN 'math'
 WHEN regexp_matches(p, 'dynamic program|dp|subproblem') THEN 'dp' WHEN contains(p, 'greedy') THEN 'greedy' WHEN regexp_matches(p, 'tree|bst|traversal') THEN 'tree' WHEN regexp_matches(p, 'graph|bfs|dfs|dijkstra|topo') THEN 'graph'
 WHEN contains(p, 'matrix') THEN 'matrix' WHEN regexp_matches(p, 'hash|dictionary|map') THEN 'hash/map' WHEN contains(p, 'two pointers') THEN 'two-pointers' WHEN contains(p, 'sort') THEN 'sorting' ELSE 'general' END AS kind
 FROM (SELECT doc_id, lower(coalesce(text, '')) AS p FROM documents)""")
def problem_types(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", problems.problem_type(F.col("text")).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_type <> 'view' THEN 'f(' || user_id || ')' END AS failing, CASE WHEN event_type <> 'view' THEN event_type END AS expected,
 CASE WHEN event_type = 'error' THEN 'g' || user_id END AS got FROM events""")
def io_differences(spark: SparkSession, d: str) -> DataFrame:
    """Test logs of events: views pass, errors show what they got."""
    user = F.col("user_id").cast("string")
    failed = F.concat(F.lit("> run\nE       assert f("), user, F.lit(") == "), F.col("event_type"), F.when(F.col("event_type") == "error", F.concat(F.lit("\nE        +  where x = g"), user)).otherwise(""), F.lit("\nend"))
    log = F.when(F.col("event_type") == "view", "1 passed").otherwise(failed)
    return t(spark, d, "events").select("event_id", problems.io_difference(log).alias("x")).select("event_id", "x.*")


@query("""SELECT event_id, 'assert f_' || event_type || '(' || user_id || ') == ' || user_id || '|assert f_' || event_type || '(0) == 1' AS tests, 'f_' || event_type AS entry,
 'import math' || chr(10) || 'def f_' || event_type || '(x, y) :' || chr(10) || '    \"\"\"Do ' || event_type || chr(10) || '    \"\"\"' AS prompt, 'a' || user_id || '|b|c' AS merged FROM events""")
def code_problems(spark: SparkSession, d: str) -> DataFrame:
    """Problems made of events, brought into one form: tests, entry point, prompt."""
    name, user, nl = F.concat(F.lit("f_"), F.col("event_type")), F.col("user_id").cast("string"), F.lit("\n")
    code = F.concat(F.lit("import math\ndef "), name, F.lit("(x, y) :\n    def inner(z):\n        return z\n    return inner(x)"))
    test = F.concat(F.lit("META = {}\n\ndef check(candidate):\n    assert candidate("), user, F.lit(") == "), user, F.lit("\n    assert candidate(0) == 1\n"), nl)
    merged = problems.merged_tests(F.array(F.concat(F.lit("a"), user), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    entry = problems.entry_point(code)
    return t(spark, d, "events").select("event_id", F.array_join(problems.checks(test, entry), "|").alias("tests"), entry.alias("entry"), problems.signature_prompt(code, F.concat(F.lit("Do "), F.col("event_type"))).alias("prompt"), F.array_join(merged, "|").alias("merged"))


@query("""SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE trim(url) END || CASE WHEN page_id % 2 = 0 THEN '' ELSE CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE ' ' END || 'http://other.example' END AS urls FROM pages""")
def url_lines(spark: SparkSession, d: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    found = F.concat(F.lit("Title: URL: x\nURL: "), url, F.lit("\n URL: no\nURL:\nURL:"), url, F.when(F.col("page_id") % 2 == 0, "").otherwise("\nURL: http://other.example"))
    return t(spark, d, "pages").select("page_id", F.array_join(problems.url_lines(found), " ").alias("urls"))


@query("""WITH p AS (SELECT p_partkey, 'kind_' || lower(p_type) AS ty, 't' || p_partkey AS tb FROM part)
SELECT p_partkey, 'Evidence: ' || CASE WHEN p_partkey % 2 = 0 THEN 'Current year is 2023, so last ' || p_partkey || ' years means [2023-' || p_partkey || '+1, 2023]. ' ELSE '' END || 'Allowed tables: ' || tb || '. Allowed columns (partial): '
 || array_to_string(list_sort(['id', ty, 'unit_price']), ', ') || '.' || CASE WHEN p_partkey % 3 = 0 THEN ' Execution feedback: no such column' ELSE '' END AS evidence FROM p""")
def schema_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What prompts say of the schemas of parts."""
    key = F.col("p_partkey").cast("string")
    ddl = F.concat(F.lit('CREATE TABLE "t'), key, F.lit('" (\n  "id" INTEGER,\n  kind_'), F.lower("p_type"), F.lit(' TEXT,\n  "unit price" REAL,\n  PRIMARY KEY (id)\n);'))
    asked = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Sales of the Last "), key, F.lit(" years")))
    return t(spark, d, "part").select("p_partkey", sqltext.evidence(asked, ddl, F.when(F.col("p_partkey") % 3 == 0, "no such column")).alias("evidence"))


@query("""WITH u AS (SELECT conv_id, turn AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')),
a AS (SELECT conv_id, turn AS told, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant'))
SELECT conv_id, ordinal, asked, told FROM u JOIN a USING (conv_id, ordinal)""")
def ordinal_pairs(spark: SparkSession, d: str) -> DataFrame:
    of = lambda role, name: t(spark, d, "conversations").where(F.col("role") == role).select("conv_id", F.col("turn").alias(name)).distinct()
    return reports.join_by_ordinal(of("user", "asked"), of("assistant", "told"), task="conv_id", left_order="asked", right_order="told").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) WHERE r = 1""")
def last_records(spark: SparkSession, d: str) -> DataFrame:
    return reports.last_wins(t(spark, d, "conversations").select("conv_id", "turn", "role"), key="conv_id", order="turn")


@query("""SELECT 'orders and lines' AS case_name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AND (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) = 0 AS same
 UNION ALL SELECT 'lines twice', true""")
def same_results(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey")
    case = lambda name, a, b: reports.same_rows(a, b).select(F.lit(name).alias("case_name"), "same")
    return case("orders and lines", orders, lines).unionByName(case("lines twice", lines, lines.distinct()))


_SCORED = "SELECT event_type, CASE WHEN value < 20 THEN 0.0 ELSE 1.0 END AS score FROM events"


@query(f"SELECT coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), 'unknown') AS name, count(*) AS count, 'value' AS metric FROM ({_SCORED}) WHERE score = 0 GROUP BY 1 UNION ALL SELECT 'primary_metric_failure', count(*), 'all' FROM ({_SCORED}) WHERE score = 0 HAVING count(*) > 0")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    scored = t(spark, d, "events").select(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("value") < 20, 0.0).otherwise(1.0).alias("score"))
    return reports.failure_patterns(scored, score="score", kind="kind", metric="value").unionByName(reports.failure_patterns(scored, score="score", kind=None, metric="all"))


@query("SELECT l_orderkey, arg_min('m' || l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1000 END + l_linenumber) AS metric FROM lineitem GROUP BY 1")
def primary_metrics(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("m"))
    return reports.primary_metric(lines, by="l_orderkey", name="m", primary=F.col("l_returnflag") == "R", place="l_linenumber")


@query("""WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT CAST(coalesce(sum(n) FILTER (WHERE lang = 'en'), 0) AS BIGINT) AS records, count(*) FILTER (WHERE lang = 'en' AND n > 0) AS sources, count(*) FILTER (WHERE lang IS NULL OR lang <> 'en') AS errors FROM s""")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source and language, of which only English ones succeeded."""
    each = t(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    ok = F.coalesce(F.col("lang") == "en", F.lit(False))
    return reports.merge_results(each, success=ok, records="n", error=F.when(ok, "").otherwise("not read"))


@query("""WITH n AS (SELECT o.o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders o GROUP BY 1)
SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 8 THEN '4-8' ELSE '>8' END AS bucket, count(*) AS customers FROM n GROUP BY 1""")
def count_buckets(spark: SparkSession, d: str) -> DataFrame:
    each = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return each.groupBy(reports.buckets(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("customers"))


_KEYS = ("widget", "Cold Widget", "small", "old-widget", "economy", "gear")


@query("""WITH n AS (SELECT p_partkey, '_' || trim(regexp_replace(lower(trim(p_name || '-' || p_type)), '[^a-z0-9]+', '_', 'g'), '_') || '_' AS n FROM part)
SELECT p_partkey, CASE WHEN contains(n, '_cold_widget_') THEN 'Cold Widget' WHEN contains(n, '_old_widget_') THEN 'old-widget' WHEN contains(n, '_economy_') THEN 'economy' WHEN contains(n, '_widget_') THEN 'widget'
 WHEN contains(n, '_small_') THEN 'small' WHEN contains(n, '_gear_') THEN 'gear' END AS key FROM n""")
def metric_plans(spark: SparkSession, d: str) -> DataFrame:
    names = t(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_name", "p_type").alias("n"))
    return reports.longest_key(names, _KEYS, name="n").select("p_partkey", "key")


@query("""WITH b AS (SELECT p_partkey, 'Bench ' || p_partkey AS name, p_name AS alias, lower(p_type) AS tag FROM part),
w AS (SELECT (SELECT name FROM b WHERE lower(name) = 'bench 7') AS a, (SELECT arg_min(name, p_partkey) FROM b WHERE contains(lower(alias), 'small w')) AS c)
SELECT name, CASE WHEN name = w.a OR name = w.c THEN 'specified' ELSE 'recommended' END AS found FROM b, w WHERE name = w.a OR name = w.c OR tag = 'economy'""")
def bench_search(spark: SparkSession, d: str) -> DataFrame:
    benches = t(spark, d, "part").select("p_partkey", F.concat(F.lit("Bench "), F.col("p_partkey").cast("string")).alias("name"), F.array("p_name").alias("aliases"), F.array("p_type").alias("tags"))
    return reports.find_benches(benches, ("BENCH 7", " small w", "no such"), ("Economy ",), name="name", aliases="aliases", tag_col="tags", place="p_partkey")
