"""Queries over the given tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import sqltext, text
from millrace.operators import dedup, metrics, records, sampling, summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows (None where SQL cannot)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows over all cores, where each costs much: a file of millions of them is small enough for one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_FOLD = "SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id"
_FIRST = "trim(list_filter(m, lambda x: lower(x.role) = '{0}')[1].content)"
_FILLED = "length(trim(regexp_replace(coalesce(x.content, ''), '\\s+', ' ', 'g'))) > 0"
_EVENTS = "SELECT event_id, user_id, event_type, value, CAST(event_type = 'error' AS INTEGER) AS failed FROM events"


@query(f"""WITH d AS (SELECT doc_id, lang, source, {_NORM} AS n FROM documents), b AS (SELECT DISTINCT {_NORM} AS b FROM benchmark)
SELECT doc_id, lang, source FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b <> '' AND n <> '' AND (substring(n, 1, 500) = substring(b, 1, 500)
 OR (length(n) > 100 AND length(b) > 100 AND length(n) / length(b) BETWEEN 0.8 AND 1.25 AND (contains(n, b) OR contains(b, n)))))""")
def decontaminate_pt(spark: SparkSession, d: str) -> DataFrame:
    return dedup.decontaminate(t(spark, d, "documents"), t(spark, d, "benchmark"), id_col="doc_id", text_col="text", bench_col="text").select("doc_id", "lang", "source")


@query(f"""SELECT conv_id, turn FROM conversations WHERE {_NORM} NOT IN (SELECT {_NORM} FROM benchmark WHERE text IS NOT NULL)""")
def decontaminate_instructions(spark: SparkSession, d: str) -> DataFrame:
    bench = t(spark, d, "benchmark").select(text.collapse(F.col("text")).alias("_b"))
    turns = t(spark, d, "conversations").where("text is not null")  # what has no instruction goes
    return turns.join(bench, text.collapse(F.col("text")) == F.col("_b"), "left_anti").select("conv_id", "turn")


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0) AS valid,
 count(*) FILTER (WHERE NOT length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0) AS invalid FROM documents GROUP BY source""")
def pt_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = records.filled(F.col("text"))
    return t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, len(m) AS n_messages, len(list_filter(m, lambda x: NOT ({_FILLED} OR lower(x.role) = 'system'))) = 0
 AND len(list_filter(m, lambda x: lower(x.role) = 'user')) > 0 AND len(list_filter(m, lambda x: lower(x.role) = 'assistant')) > 0 AS valid FROM f""")
def sft_validity(spark: SparkSession, d: str) -> DataFrame:
    folded = records.fold_messages(t(spark, d, "conversations"))
    return folded.select("conv_id", F.size("messages").cast("long").alias("n_messages"), records.valid_messages(F.col("messages")).alias("valid"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, coalesce({_FIRST.format('user')}, '') AS instruction, coalesce({_FIRST.format('system')}, '') AS input,
 coalesce({_FIRST.format('assistant')}, '') AS output FROM f""")
def format_alpaca(spark: SparkSession, d: str) -> DataFrame:
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", records.alpaca(F.col("messages")).alias("r")).select("conv_id", "r.*")


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: {_FILLED}),
 lambda x: CASE WHEN lower(x.role) = 'tool' THEN 'assistant' ELSE lower(x.role) END || '|' || x.content), chr(10)) AS messages FROM f""")
def format_chatml(spark: SparkSession, d: str) -> DataFrame:
    made = records.chatml(F.col("messages"))
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", F.array_join(F.transform(made, lambda x: F.concat_ws("|", x["role"], x["content"])), "\n").alias("messages"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: {_FILLED}),
 lambda x: upper(substring(x.role, 1, 1)) || lower(substring(x.role, 2)) || ': ' || trim(x.content)), chr(10) || chr(10)) AS text FROM f""")
def format_plain(spark: SparkSession, d: str) -> DataFrame:
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", records.plain_text(F.col("messages")).alias("text"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: {_FILLED} AND lower(x.role) <> 'system'),
 lambda x: CASE WHEN lower(x.role) IN ('assistant', 'tool') THEN 'assistant' ELSE 'user' END || '|' || x.content), chr(10)) AS messages FROM f""")
def format_sft(spark: SparkSession, d: str) -> DataFrame:
    made = records.sft_turns(F.col("messages"))
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", F.array_join(F.transform(made, lambda x: F.concat_ws("|", x["role"], x["content"])), "\n").alias("messages"))


@query("""WITH o AS (SELECT *, max(CASE WHEN lower(role) = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ut FROM conversations),
s AS (SELECT conv_id, min_by(trim(text), turn) AS sys FROM conversations WHERE lower(role) = 'system' GROUP BY conv_id),
a AS (SELECT o.conv_id, o.turn, coalesce(trim(u.text), '') AS u, trim(o.text) AS a, row_number() OVER (PARTITION BY o.conv_id ORDER BY o.turn) AS n
 FROM o LEFT JOIN conversations u ON u.conv_id = o.conv_id AND u.turn = o.ut WHERE lower(o.role) = 'assistant'),
p AS (SELECT a.conv_id, string_agg('<s>[INST] ' || CASE WHEN n = 1 AND coalesce(sys, '') <> '' THEN '<<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END
 || u || ' [/INST] ' || a || ' </s>', '' ORDER BY turn) AS text FROM a LEFT JOIN s USING (conv_id) GROUP BY a.conv_id)
SELECT c.conv_id, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN p USING (conv_id)""")
def format_llama2(spark: SparkSession, d: str) -> DataFrame:
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", records.llama2(F.col("messages")).alias("text"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, CASE WHEN lower(m[1].role) = 'system' THEN len(m) ELSE len(m) + 1 END AS n_messages FROM f""")
def ensure_system(spark: SparkSession, d: str) -> DataFrame:
    made = records.ensure_system(F.col("messages"), "You are a helpful assistant.")
    return records.fold_messages(t(spark, d, "conversations")).select("conv_id", F.size(made).cast("long").alias("n_messages"))


@query(f"""WITH e AS ({_EVENTS}) SELECT user_id % 20 AS grp, sum(failed) AS fails, count(*) - sum(failed) AS passes, 2 * sum(failed) - count(*) AS bias FROM e GROUP BY 1
 ORDER BY bias DESC, fails DESC, grp LIMIT 15""")
def failure_bias(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select((F.col("user_id") % 20).alias("grp"), (F.col("event_type") == "error").cast("long").alias("f"))
    b = e.groupBy("grp").agg(F.sum("f").alias("fails"), F.sum(1 - F.col("f")).alias("passes"))
    return b.withColumn("bias", F.col("fails") - F.col("passes")).orderBy(F.desc("bias"), F.desc("fails"), "grp").limit(15)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_frequent(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top_values(t(spark, d, "events"), "user_id", n=20)


@query("""SELECT lang, CASE WHEN n <= 10 THEN '<=10' WHEN n <= 30 THEN '11-30' WHEN n <= 60 THEN '31-60' ELSE '>60' END AS bin, count(*) AS n_docs
 FROM (SELECT lang, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def line_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return t(spark, d, "documents").where("text is not null").groupBy("lang", summaries.bins(n, (10, 30, 60)).alias("bin")).agg(F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH e AS ({_EVENTS}), k AS (SELECT user_id, bool_or(failed = 0) AS ok FROM e GROUP BY user_id)
SELECT (SELECT round(avg(1 - failed), 4) FROM e) AS sample_rate, round(avg(CAST(ok AS INTEGER)), 4) AS task_rate FROM k""")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("ok"))
    return summaries.pass_rates(e, task="user_id", passed="ok")


@query("""WITH g AS (SELECT l_suppkey AS task, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1),
k AS (SELECT unnest([1, 10, 100]) AS k), s AS (SELECT k, n, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0
 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)) END AS p FROM g, k)
SELECT k, round(avg(p), 6) AS score FROM s GROUP BY k HAVING min(n) >= k""")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("task"), (F.col("l_returnflag") == "R").alias("ok"))
    return metrics.pass_at_k(rows, task_col="task", passed_col="ok").select("k", F.round("score", 6).alias("score"))


@query("""SELECT 'c_name' AS field, count(c_name) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(nullif(c_mktsegment, '')) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer""")
def field_presence(spark: SparkSession, d: str) -> DataFrame:
    return summaries.field_presence(t(spark, d, "customer"), ("c_name", "c_mktsegment", "c_acctbal"))


@query("SELECT user_id % 10 AS grp, arg_max(event_type, (n, event_type)) AS dominant FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id % 10, event_type) AS n FROM events) GROUP BY 1")
def dominant_failure(spark: SparkSession, d: str) -> DataFrame:
    return summaries.dominant(t(spark, d, "events").withColumn("grp", F.col("user_id") % 10), F.col("event_type"), "grp")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS group_size FROM events)
SELECT event_id, event_type, rn, group_size FROM r ORDER BY rn, group_size, event_type LIMIT 20""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(t(spark, d, "events").select("event_id", "event_type"), group_col="event_type", id_col="event_id").select("event_id", "event_type", F.col("rn").cast("long").alias("rn"), "group_size")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'click') ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id LIMIT 5")
def failure_examples(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").where(F.col("event_type").isin("error", "click"))
    return e.orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id").select("event_id", "event_type", "value").limit(5)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("""WITH n AS (SELECT DISTINCT n_name FROM nation), p AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS pos, count(*) OVER () AS n FROM n)
SELECT n_name, CAST(10000 // n + CASE WHEN pos < 10000 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM p""")
def quota_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quotas(t(spark, d, "nation"), name_col="n_name", budget=10_000)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents) SELECT doc_id, source, rank FROM r WHERE rank <= 5""")
def reservoir(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_per_group(t(spark, d, "documents").select("doc_id", "source"), group_col="source", id_col="doc_id", k=5).select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 500")
def benchmark_pool(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pool(t(spark, d, "documents").select("doc_id", "lang"), id_col="doc_id", size=500)


@query("SELECT source, min_by(doc_id, doc_id) AS doc_id FROM documents GROUP BY source")
def one_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, o_custkey FROM r WHERE rn <= 3""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    newest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("rn", F.row_number().over(newest)).where("rn <= 3").select("o_orderkey", "o_custkey")


@query("""WITH l AS (SELECT doc_id, sha1(trim(text)) AS h FROM documents WHERE text IS NOT NULL) SELECT min(doc_id) AS doc_id, h AS sha FROM l GROUP BY h""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.first_by_hash(t(spark, d, "documents").where("text is not null").select("doc_id", "text"), text_col="text", order_col="doc_id")
    return kept.select("doc_id", F.sha1(F.trim("text")).alias("sha"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("""SELECT o_orderkey, p.l_partkey, coalesce(p.q, -1.0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) p ON o_orderkey = l_orderkey""")
def align_predictions(spark: SparkSession, d: str) -> DataFrame:
    pred = t(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("q"))
    return t(spark, d, "orders").join(pred, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey", F.coalesce("q", F.lit(-1.0)).alias("q"))


@query("""SELECT event_id, CAST(regexp_extract(replace(props, ',', ''), '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS number, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", text.first_number(F.col("props")).alias("number"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"SELECT doc_id, md5({_NORM}) AS md5, substring(md5({_NORM}), 1, 16) AS short_id, length({_NORM}) AS n FROM documents WHERE text IS NOT NULL")
def normalised_key(spark: SparkSession, d: str) -> DataFrame:
    n = text.collapse(F.col("text"))
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(n).alias("md5"), F.substring(F.md5(n), 1, 16).alias("short_id"), F.length(n).cast("long").alias("n"))


@query("""SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1)) IS NOT NULL AS parsed, len(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) AS n_links FROM pages WHERE html IS NOT NULL""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1)))
    return t(spark, d, "pages").where("html is not null").select("page_id", links.isNotNull().alias("parsed"), F.size(links).cast("long").alias("n_links"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_SQLS = "(SELECT o_orderkey, 'SELECT o_custkey, sum(o_totalprice) FROM orders WHERE o_orderstatus = ''' || o_orderstatus || ''' GROUP BY o_custkey; SELECT ' || o_custkey || ' LIMIT 5' AS q FROM orders)"


@query(f"""SELECT o_orderkey, len(list_filter(list_transform(string_split(q, ';'), lambda s: trim(s)), lambda s: s <> '')) AS n_statements, upper(regexp_extract(trim(q), '^([A-Za-z]+)', 1)) AS op,
 (length(lower(q)) - length(replace(lower(q), 'select', ''))) // 6 AS n_select, (length(lower(q)) - length(replace(lower(q), 'group by', ''))) // 8 AS n_group FROM {_SQLS}""")
def sql_statistics(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("SELECT o_custkey, sum(o_totalprice) FROM orders WHERE o_orderstatus = '"), F.col("o_orderstatus"), F.lit("' GROUP BY o_custkey; SELECT "), F.col("o_custkey").cast("string"), F.lit(" LIMIT 5"))
    return t(spark, d, "orders").select("o_orderkey", F.size(sqltext.statements(q)).cast("long").alias("n_statements"), sqltext.op_type(q).alias("op"), sqltext.occurrences(F.lower(q), "select").alias("n_select"), sqltext.occurrences(F.lower(q), "group by").alias("n_group"))


@query("SELECT event_id, CAST(value AS DOUBLE) AS loss, CAST(user_id AS DOUBLE) AS step FROM events WHERE value IS NOT NULL")
def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("{'loss': "), F.col("value").cast("string"), F.lit(", 'step': "), F.col("user_id").cast("string"), F.lit("}"))
    lines = t(spark, d, "events").where("value is not null").select("event_id", line.alias("line"))
    return lines.select("event_id", sqltext.log_metric(F.col("line"), "loss").alias("loss"), sqltext.log_metric(F.col("line"), "step").alias("step"))


_SCORED = "SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS s, l.quality AS q, l.toxic AS y, d.lang FROM labels l JOIN documents d USING (doc_id)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("s")), "doc_id")


@query(f"""WITH x AS ({_SCORED}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r""")
def auc_roc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_scored(spark, d), score_col="s", label_col="toxic").select(F.round("auc", 6).alias("auc"))


@query(f"""WITH x AS ({_SCORED}), c AS (SELECT CAST(count(*) FILTER (WHERE q = 1 AND y = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE q = 0 AND y = 0) AS tn, count(*) FILTER (WHERE q = 1 AND y = 0) AS fp, count(*) FILTER (WHERE q = 0 AND y = 1) AS fn FROM x)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def mcc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mcc(_scored(spark, d), pred_col="quality", label_col="toxic").select(F.round("mcc", 6).alias("mcc"))


@query(f"WITH x AS ({_SCORED}) SELECT round(corr(s, q), 6) AS pearson FROM x")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).agg(F.round(F.corr("s", F.col("quality").cast("double")), 6).alias("pearson"))


@query(f"""WITH x AS ({_SCORED}), a AS (SELECT lang, avg(CAST(q AS DOUBLE)) AS a FROM x GROUP BY lang)
SELECT round(CASE WHEN (SELECT sum(a) FROM a) = 0 THEN 0 ELSE (SELECT avg(abs(x.a - z.a)) FROM a x, a z) / 2 / (SELECT avg(a) FROM a) END, 6) AS gini""")
def gini(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gini(_scored(spark, d), category_col="lang", correct_col="quality").select(F.round("gini", 6).alias("gini"))


@query("""WITH p AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS a FROM conversations)
SELECT x.conv_id, x.turn, round(len(list_intersect(x.a, y.a)) / greatest(len(list_distinct(list_concat(x.a, y.a))), 1), 6) AS jaccard, round(2.0 * len(list_intersect(x.a, y.a)) / greatest(len(x.a) + len(y.a), 1), 6) AS f1
FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1""")
def turn_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: w != "")).alias("a"))
    y = p.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return p.join(y, ["conv_id", "turn"]).select("conv_id", "turn", F.round(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(metrics.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("""WITH l AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS orders, sum(n) AS items, count(*) FILTER (WHERE first_ship > o_orderdate) AS later FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def checkpoint_writes(spark: SparkSession, d: str) -> DataFrame:
    w = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.count(F.lit(1)).alias("n"))
    j = t(spark, d, "orders").join(w, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("items"), F.count_if(F.col("first_ship") > F.col("o_orderdate")).alias("later"))


@query("""SELECT p_brand, p_type, count(*) AS n FROM part WHERE contains(lower(p_name), 'a') AND p_size BETWEEN 5 AND 25 GROUP BY ALL""")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where(F.lower("p_name").contains("a") & F.col("p_size").between(5, 25)).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
