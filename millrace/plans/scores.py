"""More queries: text scores, graph search, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import corpus_metrics, graph, sampling, summaries
from millrace.plans.catalog import query, t

_TOKENS = "' ' || coalesce(text, '') || ' '"
for _pattern, _by in corpus_metrics.STEPS_13A:
    _literal = _pattern.replace("\n", "\\n").replace("'", "''")
    _TOKENS = f"regexp_replace({_TOKENS}, '{_literal}', '{_by.replace('$', chr(92))}', 'g')"
_TOKENS = f"list_filter(string_split_regex(trim({_TOKENS}), '\\s+'), lambda w: w <> '')"
_TURNS = f"SELECT conv_id, turn, {_TOKENS} AS k FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)"


def _next_turns(spark: SparkSession, d: str) -> DataFrame:
    """id, pred, refs: each turn against the one after it."""
    turns = t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return turns.join(after, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("pred"), F.array("ref").alias("refs"))


@query(f"""WITH w AS ({_TURNS}), pr AS (SELECT x.conv_id || ':' || x.turn AS id, x.k AS p, y.k AS r FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1),
s AS (SELECT id, 0 AS side, p AS k FROM pr UNION ALL SELECT id, 1, r FROM pr), o AS (SELECT id, side, k, unnest([1, 2, 3, 4]) AS n FROM s),
i AS (SELECT id, side, k, n, unnest(range(1, len(k) - n + 2)) AS i FROM o), g AS (SELECT id, side, n, array_to_string(k[i:i + n - 1], chr(1)) AS gram FROM i),
c AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) AS r FROM g GROUP BY ALL),
b AS (SELECT n, CAST(sum(least(p, r)) AS DOUBLE) AS hit, CAST(sum(p) AS DOUBLE) AS tried FROM c GROUP BY n HAVING sum(p) > 0),
z AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS z FROM b),
m AS (SELECT sum(ln(CASE WHEN hit = 0 THEN 1 / (pow(2, z) * tried) ELSE hit / tried END)) / 4 AS l, count(*) AS k, sum(hit) AS hit FROM z), l AS (SELECT sum(len(p)) AS s, sum(len(r)) AS r FROM pr)
SELECT round(CASE WHEN k < 4 OR hit = 0 THEN 0.0 ELSE least(1.0, CASE WHEN s < r THEN exp(1 - r / s) ELSE 1.0 END * exp(m.l)) END, 6) AS score FROM m, l""")
def bleu_turns(spark: SparkSession, d: str) -> DataFrame:
    return corpus_metrics.bleu(_next_turns(spark, d), id_col="id", pred="pred", refs="refs").select(F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT CAST(d.n_chars AS DOUBLE) AS x, l.quality AS y FROM labels l JOIN documents d USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x) SELECT round(corr(rx, ry), 6) AS rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")), "doc_id")
    return corpus_metrics.spearman(x, x_col="x", y_col="quality").select(F.round("rho", 6).alias("rho"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b(node, depth) AS (SELECT CAST(1 AS BIGINT), 0
 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node""")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    edges = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    seeds = t(spark, d, "orders").limit(0).select(F.col("o_custkey").alias("node")).union(spark.range(1, 2).select("id"))
    return graph.bfs(edges, seeds, depth=3).select(F.col("node").cast("long").alias("node"), "depth")


@query("""SELECT user_id, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 AND event_type <> 'error' GROUP BY user_id""")
def json_predicate(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t(spark, d, "events").where(k.between(10, 50) & (F.col("event_type") != "error")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS best, min(value) AS loss FROM events WHERE value IS NOT NULL GROUP BY user_id")
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return summaries.best_checkpoint(t(spark, d, "events"), by="user_id", loss="value", step="event_id")


@query("""SELECT event_type, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(value, (ts, event_id)) AS latest, count(DISTINCT user_id) AS users FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latest_values(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.countDistinct("user_id").alias("users"))


@query("""WITH f AS (SELECT user_id, count(*) AS fails FROM events WHERE event_type = 'error' GROUP BY 1), p AS (SELECT user_id, count(*) AS passes FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(f.user_id, p.user_id) AS user_id, coalesce(fails, 0) AS fails, coalesce(passes, 0) AS passes FROM f FULL JOIN p ON f.user_id = p.user_id""")
def fails_and_passes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = t(spark, d, "events").where(kind.isin("error", "purchase"))  # one aggregation gives what a full join of two would
    return e.groupBy("user_id").agg(F.count_if(kind == "error").alias("fails"), F.count_if(kind == "purchase").alias("passes"))


@query("""WITH s AS (SELECT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), q AS (SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS gp, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS sp, count(*) OVER (PARTITION BY lang) AS ns FROM s),
g AS (SELECT *, max(gp) OVER () + 1 AS ng FROM q), b AS (SELECT *, 5000 // ng + CASE WHEN gp < 5000 % ng THEN 1 ELSE 0 END AS gb FROM g)
SELECT lang, source, CAST(gb // ns + CASE WHEN sp < gb % ns THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b""")
def quota_two_levels(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "documents").where("lang is not null and source is not null")
    return sampling.nested_quotas(s, group_col="lang", name_col="source", budget=5000)


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages WHERE length(trim(html)) >= 100 AND NOT contains(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.net')""")
def unblocked_pages(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return t(spark, d, "pages").where((F.length(F.trim("html")) >= 100) & ~host.contains(".net")).select("page_id", host.alias("host"))


@query("""SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_chars FROM documents WHERE text IS NOT NULL GROUP BY source""")
def crawl_statistics(spark: SparkSession, d: str) -> DataFrame:
    by = t(spark, d, "documents").where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return by.withColumn("mean_chars", F.expr("chars div n"))


@query("""SELECT split_part(o_comment_key, ':', 1) AS reason, count(*) AS n FROM (SELECT o_orderstatus || ':' || o_orderkey AS o_comment_key FROM orders) GROUP BY 1""")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return summaries.drop_reasons(t(spark, d, "orders"), F.concat_ws(":", "o_orderstatus", "o_orderkey"))
