"""Queries of failure reports, statements, chats in other forms, classes and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sqltext, web
from millrace.operators import metrics, records, summaries
from millrace.plans.catalog import _FOLD, query, t


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'syntax' WHEN 1 THEN 'import' WHEN 2 THEN 'assert' WHEN 3 THEN 'value' WHEN 4 THEN 'timeout' ELSE 'other' END AS stage,
 CASE doc_id % 6 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'ImportError' WHEN 2 THEN 'AssertionError' WHEN 3 THEN CASE WHEN lang = 'en' THEN 'ZeroDivisionError' ELSE 'ValueError' END WHEN 4 THEN 'Timeout' ELSE '' END AS exception,
 CASE WHEN doc_id % 6 = 0 THEN source || '.py:' || n_chars ELSE '' END AS place, CASE doc_id % 6 WHEN 1 THEN source WHEN 2 THEN trim(regexp_extract(substring(text, 1, 30), '^[^\\n]*')) ELSE '' END AS detail FROM documents""")
def failure_reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as what failing programs write, after their last line an error of one of six kinds."""
    k = F.col("doc_id") % 6
    error = (
        F.when(k == 0, F.concat(F.lit('  File "'), "source", F.lit('.py", line '), F.col("n_chars").cast("string"), F.lit("\nSyntaxError: invalid")))
        .when(k == 1, F.concat(F.lit("ModuleNotFoundError: No module named '"), "source", F.lit("'")))
        .when(k == 2, F.concat(F.lit("AssertionError: "), F.substring("text", 1, 30)))
        .when(k == 3, F.when(F.col("lang") == "en", "ZeroDivisionError: x").otherwise("ValueError: x"))
        .when(k == 4, "the run timed out")
    )
    report = sqltext.failure_report(F.col("source"), error, F.col("text"))
    return t(spark, d, "documents").select("doc_id", report.alias("r")).select("doc_id", "r.*")


_HAS = "(length(q) - length(replace(q, '{0}', ''))) // {1}"


@query(f"""WITH d AS (SELECT doc_id, lower(replace(replace(replace(coalesce(text, ''), ' the ', ' JOIN '), ' and ', ' Count('), ' der ', '(select ')) AS q FROM documents)
SELECT doc_id, length(q) AS length, {_HAS.format('select', 6)} AS selects, {_HAS.format(' join ', 6)} AS joins, {_HAS.format('(select', 7)} AS subqueries, {_HAS.format(' count(', 7)} AS aggregations, 0 AS limits FROM d""")
def statement_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents some of whose words are those of statements."""
    q = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" JOIN ")), F.lit(" and "), F.lit(" Count(")), F.lit(" der "), F.lit("(select "))
    return t(spark, d, "documents").select("doc_id", sqltext.statement_counts(q).alias("s")).select("doc_id", *[f"s.{c}" for c in ("length", "selects", "joins", "subqueries", "aggregations")], F.col("s.limits").cast("int").alias("limits"))


@query("""SELECT doc_id, 'CREATE TABLE ' || source || '(a INT);' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'SELECT ' || doc_id || ' FROM ' || lang || ';' END AS "schema", doc_id % 3 = 0 AS leaked FROM documents""")
def sanitized_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Schemas with a statement that is every third record's answer."""
    q = F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"), F.lit(" FROM "), "lang")
    ddl = F.concat(F.lit("```sql\nCREATE TABLE "), "source", F.lit("(a INT);\n"), q, F.lit(";\n```"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```sql\n"), F.lower(q), F.lit(" ;\n```"))).otherwise("SELECT 0")
    return t(spark, d, "documents").select("doc_id", sqltext.sanitized(ddl, answer).alias("x")).select("doc_id", "x.schema", "x.leaked")


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' def f(): pass' WHEN 1 THEN 'def g(): pass' ELSE '  class X: pass' END AS code, substring(text, 1, 40) || CASE WHEN doc_id % 2 = 0 THEN ' def h():' ELSE '' END AS prompt FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND contains(prompt, 'def') THEN substring(prompt, 1, instr(prompt, 'def') - 1) ELSE '' END || trim(code) AS code FROM d""")
def repaired_programs(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 == 0, " def f(): pass").when(F.col("doc_id") % 3 == 1, "def g(): pass").otherwise("  class X: pass")
    prompt = F.concat(F.substring("text", 1, 40), F.when(F.col("doc_id") % 2 == 0, " def h():").otherwise(""))
    return t(spark, d, "documents").select("doc_id", web.with_imports(code, prompt).alias("code"))


_TEXT = "coalesce(regexp_replace(list_filter(m, lambda x: lower(x.role) = '{0}' AND regexp_matches(coalesce(x.content, ''), '\\S'))[1].content, '^\\s+|\\s+$', '', 'g'), '')"


@query(f"""SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'Do ' || conv_id WHEN {_TEXT.format('system')} = '' THEN {_TEXT.format('user')} WHEN {_TEXT.format('user')} = '' THEN {_TEXT.format('system')} ELSE {_TEXT.format('system')} || chr(10) || {_TEXT.format('user')} END AS instruction,
 '' AS input, CASE WHEN conv_id % 4 = 0 THEN '' ELSE {_TEXT.format('assistant')} END AS output FROM ({_FOLD})""")
def record_triples(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, every fourth with an instruction of its own."""
    own = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(" Do "), F.col("conv_id").cast("string"), F.lit("\n")))
    rows = records.fold_messages(t(spark, d, "conversations")).withColumn("instruction", own)
    return rows.select("conv_id", records.triple(rows).alias("r")).select("conv_id", "r.*")


@query(f"""WITH f AS (SELECT conv_id, m, coalesce(lower(m[1].role) = 'system', false) AS s FROM ({_FOLD})) SELECT conv_id, CASE WHEN s AND regexp_matches(coalesce(m[1].content, ''), '\\S') THEN m[1].content ELSE 'Be brief.' END AS first, 'f' || repeat('-', CASE WHEN s THEN len(m) - 1 ELSE len(m) END) AS masks FROM f""")
def masked_systems(spark: SparkSession, d: str) -> DataFrame:
    made = records.fold_messages(t(spark, d, "conversations")).select("conv_id", records.masked_system(F.col("messages"), "Be brief.").alias("m"))
    masks = F.transform("m", lambda x: F.when(x["loss_mask"].isNull(), "-").when(x["loss_mask"], "t").otherwise("f"))
    return made.select("conv_id", F.col("m")[0]["content"].alias("first"), F.array_join(masks, "").alias("masks"))


@query("""WITH e AS (SELECT lang = c AS mine, c, CASE c WHEN 'de' THEN doc_id % 7 WHEN 'en' THEN n_chars % 11 WHEN 'fr' THEN (doc_id + n_chars) % 5 ELSE length(source) END AS s FROM documents, (SELECT unnest(['de', 'en', 'fr', 'es']) AS c) WHERE lang IN ('de', 'en', 'fr', 'es')),
g AS (SELECT c, s, count(*) FILTER (WHERE mine) AS p, count(*) FILTER (WHERE NOT mine) AS n FROM e GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT c, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS a FROM b GROUP BY c) SELECT round(avg(a), 8) AS auc FROM a""")
def language_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well numbers of documents, that have nothing to do with it, tell their language: near a half."""
    scores = F.array(*[c.cast("double") for c in (F.col("doc_id") % 7, F.col("n_chars") % 11, (F.col("doc_id") + F.col("n_chars")) % 5, F.length("source"))])
    rows = t(spark, d, "documents").where(F.col("lang").isin("de", "en", "fr", "es")).select("lang", scores.alias("s"))
    return metrics.class_auc(rows, scores_col="s", label_col="lang", classes=("de", "en", "fr", "es")).select(F.round("auc", 8).alias("auc"))


@query("""WITH b AS (SELECT user_id, arg_min(event_id, (value, event_id)) AS best, min(value) AS loss FROM events WHERE value IS NOT NULL GROUP BY user_id), s AS (SELECT user_id, event_id AS c FROM events WHERE event_type = 'signup')
SELECT b.user_id, best, loss, arg_min(c, (abs(c - best), c)) FILTER (WHERE c IS NOT NULL) AS checkpoint FROM b LEFT JOIN s ON b.user_id = s.user_id GROUP BY ALL""")
def nearest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event of least value, and the sign-up nearest to it."""
    e = t(spark, d, "events")
    best = summaries.best_checkpoint(e, by="user_id", loss="value", step="event_id")
    saved = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("checkpoint"))
    return summaries.nearest_checkpoint(best, saved, by="user_id", step="best", number="checkpoint")
