"""More queries: answers and their matches, web, SQL and code text, field paths, the store and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers, overlap, sqltext, web
from millrace.operators import corpus_metrics, fieldpath, records, retrieval, store
from millrace.plans.catalog import _FOLD, query, t

_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_BOX = "\\\\boxed\\{([^}]+)\\}"


def _normal(x: str) -> str:
    said = f"trim(regexp_extract({x}, '(?i)(?:answer|result)\\s+is\\s+:?\\s*([^!.?\\n]+)', 1))"
    pick = f"CASE WHEN contains({x}, '####') THEN string_split({x}, '####')[-1] WHEN contains({x}, '\\boxed{{') THEN coalesce(regexp_extract_all({x}, '{_BOX}', 1)[-1], {x}) WHEN length({x}) > 50 AND {said} <> '' THEN {said} ELSE {x} END"
    return f"list_filter(string_split(trim(regexp_replace(translate(lower({pick}), '{_PUNCTUATION}', ''), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the', ''))"


_NEXT = f"""c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), pr AS (SELECT x.conv_id, x.turn, x.text AS p, y.text AS r,
 {_normal('x.text')} AS a, {_normal('y.text')} AS b FROM c x JOIN c y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""


def _next(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, p, r: each turn's text and that of the turn after it."""
    turns = t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("p"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("p").alias("r"))
    return turns.join(after, ["conv_id", "turn"])


@query(f"WITH {_NEXT} SELECT conv_id, turn, coalesce(array_to_string(a, ' ') = array_to_string(b, ' '), false) AS em FROM pr")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).select("conv_id", "turn", overlap.exact_match(F.col("p"), F.array("r")).alias("em"))


@query(f"""WITH {_NEXT} SELECT conv_id || ':' || turn AS id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(a),
 lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) / (len(a) + len(b)) END, 6) AS score FROM (SELECT conv_id, turn, coalesce(a, []) AS a, coalesce(b, []) AS b FROM pr)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    pairs = _next(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "p", F.array("r").alias("refs"))
    return corpus_metrics.token_f1(pairs, id_col="id", pred="p", refs="refs").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_NEXT} SELECT conv_id, turn, round(len(list_intersect(list_distinct(b), a)) / nullif(len(list_distinct(b)), 0), 6) AS recall FROM (SELECT conv_id, turn, coalesce(a, []) AS a, coalesce(b, []) AS b FROM pr)""")
def keyword_recall(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).select("conv_id", "turn", F.round(overlap.keyword_recall(F.col("p"), F.array("r")), 6).alias("recall"))


def _loose(x: str) -> str:
    return f"lower(trim(regexp_replace(trim(regexp_replace(translate(coalesce({x}, ''), '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '[\\s\\x85\\p{{Z}}]+', ' ', 'g')), '[.。!！?？]$', '')))"


@query(f"WITH {_NEXT}, l AS (SELECT conv_id, turn, {_loose('p')} AS p, {_loose('r')} AS r FROM pr) SELECT conv_id, turn, p <> '' AND r <> '' AND (contains(p, r) OR contains(r, p)) AS hit FROM l")
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).select("conv_id", "turn", answers.contains_match(F.col("p"), F.col("r")).alias("hit"))


@query("""WITH s AS (SELECT conv_id, turn, text, string_split(text, '####')[-1] AS s FROM conversations),
b AS (SELECT conv_id, turn, replace(coalesce(regexp_extract_all(s, '\\\\boxed\\{([^}]+)\\}', 1)[-1], s), ',', '') AS s FROM s),
x AS (SELECT conv_id, turn, TRY_CAST(regexp_extract(s, '([-+]?\\d+)\\s*/\\s*(\\d+)', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(s, '([-+]?\\d+)\\s*/\\s*(\\d+)', 2) AS DOUBLE), 0) AS f,
 TRY_CAST(regexp_extract(s, '([-+]?\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) / 100 AS p, TRY_CAST(regexp_extract(s, '[-+]?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) AS n FROM b)
SELECT conv_id, turn, round(coalesce(f, p, n), 6) AS number FROM x""")
def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", F.round(answers.number(F.col("text")), 6).alias("number"))


@query("""WITH w AS (SELECT conv_id, turn, lower(text) AS s FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn,
 CASE WHEN s LIKE '%delete%' OR s LIKE '%remove%' OR s LIKE '%drop%' THEN 'DELETE' WHEN s LIKE '%update%' OR s LIKE '%set %' THEN 'UPDATE'
 WHEN s LIKE '%insert%' OR s LIKE '%add %' OR s LIKE '%create record%' THEN 'INSERT' WHEN s LIKE '%create table%' OR s LIKE '%build table%' OR s LIKE '%new table%' THEN 'DDL' ELSE 'SELECT' END AS intent FROM w""")
def intents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", sqltext.intent(F.col("text")).alias("intent"))


@query("""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\s\\x1c-\\x1f\\x85\\p{Z}]') AS w FROM documents),
n AS (SELECT doc_id, text, w, CAST(len(list_filter(w, lambda x: x IN ('for', 'while'))) AS BIGINT) AS loops, CAST(len(list_filter(w, lambda x: x IN ('if', 'elif', 'case'))) AS BIGINT) AS branches,
 CAST(len(list_filter(w, lambda x: x IN ('try', 'except', 'finally'))) AS BIGINT) AS tries FROM w)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) END AS lines, CAST(len(w) AS BIGINT) AS tokens, loops, branches, tries, loops + branches + tries + 1 AS cyclomatic FROM n""")
def code_statistics(spark: SparkSession, d: str) -> DataFrame:
    made = t(spark, d, "documents").select("doc_id", sqltext.code_statistics(F.col("text")).alias("s"))
    return made.select("doc_id", "s.lines", "s.tokens", "s.loops", "s.branches", "s.tries", "s.cyclomatic")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'o_orderpriority' WHEN 'O' THEN 'lower(o_clerk)' ELSE '' END AS missing FROM orders""")
def strict_grouping(spark: SparkSession, d: str) -> DataFrame:
    """A statement made from each order; those of status F and O select what they do not group by, the others what they do."""
    extra = F.when(F.col("o_orderstatus") == "F", "o_orderpriority, ").when(F.col("o_orderstatus") == "O", "lower(o_clerk), ").otherwise("lower(o_orderpriority) AS p, ")
    sql = F.concat(F.lit("SELECT o.o_custkey AS k, "), extra, F.lit("max(coalesce(o_totalprice, "), F.col("o_orderkey").cast("string"), F.lit(")) AS m FROM orders o GROUP BY o_custkey, lower(o_orderpriority) HAVING count(*) > 1"))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(sqltext.ungrouped(sql), ",").alias("missing"))


@query("""SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
 CAST(len(list_distinct(list_concat(regexp_extract_all(coalesce(html, ''), '\\]\\(\\s*([^)#\\s][^)\\s]*)', 1), regexp_extract_all(coalesce(html, ''), '(https?://[^\\s)\\]>"'']+)', 1)))) AS BIGINT) AS n_urls FROM pages""")
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    found = web.links(F.coalesce("html", F.lit("")), 1_000_000)
    return t(spark, d, "pages").select("page_id", F.coalesce(web.host(F.col("url")), F.lit("")).alias("host"), F.size(found).cast("long").alias("n_urls"))


@query(f"""WITH f AS ({_FOLD}) SELECT conv_id, array_to_string(list_filter(list_transform(m, lambda x: x.content), lambda x: x <> ''), chr(10)) AS contents, coalesce(m[1].role, '') AS first_role,
 CASE WHEN len(m) = 0 THEN '' ELSE 'role. ' || m[1].role || CASE WHEN coalesce(m[1].content, '') = '' THEN '' ELSE chr(10) || 'content. ' || m[1].content END END AS first FROM f WHERE m[1].content <> ''""")
def field_paths(spark: SparkSession, d: str) -> DataFrame:
    folded = records.fold_messages(t(spark, d, "conversations")).where("messages[0].content <> ''")
    at = lambda spec: F.coalesce(fieldpath.joined(folded, spec), F.lit(""))
    return folded.select("conv_id", at("messages[*].content").alias("contents"), at("messages[0].role").alias("first_role"), at("messages[0]").alias("first"))


@query("""WITH r AS (SELECT event_type, user_id, props, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, props DESC) AS n FROM events WHERE ts IS NOT NULL AND props IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL)
SELECT event_type, CAST(user_id AS VARCHAR) AS key, props AS value FROM r WHERE n = 1 AND event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS DOUBLE) = 7""")
def store_search(spark: SparkSession, d: str) -> DataFrame:
    """Events written to the store by kind and user; the clicks whose last value has k = 7."""
    writes = t(spark, d, "events").where("ts is not null and props is not null and event_type is not null and user_id is not null")
    writes = writes.select(F.array("event_type").alias("ns"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    empty = writes.limit(0).select("ns", "key", "value", F.col("updated_at").alias("created_at"), "updated_at", F.col("updated_at").alias("expires_at"))
    return store.search(store.put(empty, writes), ("click",), filters={"k": 7}, limit=None).select(F.col("ns")[0].alias("event_type"), "key", "value")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_writes FROM o WHERE n <= 2""")
def checkpoint_list(spark: SparkSession, d: str) -> DataFrame:
    """Orders as checkpoints of a customer's thread: the newest two with their line items as pending writes."""
    points = t(spark, d, "orders").select(F.col("o_custkey").alias("thread_id"), F.lit("").alias("checkpoint_ns"), F.col("o_orderkey").alias("checkpoint_id"))
    w = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("checkpoint_id"), F.col("l_suppkey").alias("task_id"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    newest = store.latest_checkpoints(points, limit=2)
    own = w.join(newest.select("thread_id", "checkpoint_ns", "checkpoint_id"), "checkpoint_id")
    return store.with_writes(newest, own).select(F.col("thread_id").alias("o_custkey"), F.col("checkpoint_id").alias("o_orderkey"), F.size("writes").cast("long").alias("n_writes"))


@query(None)
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("html", "<[^>]*>", " ")
    return retrieval.page_chunks(t(spark, d, "pages").select("url", text.alias("text")), url_col="url", text_col="text")


@query(None)
def diverse_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen diverse vectors near the mean vector of each label."""
    e = t(spark, d, "embeddings").where("label is not null")
    means = e.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("query"))
    return retrieval.mmr(e, centres.withColumnRenamed("label", "query_id"), id_col="vec_id", vec_col="embedding").select("query_id", "rank", F.col("id").alias("vec_id"))


@query(None)
def rouge_turns(spark: SparkSession, d: str) -> DataFrame:
    return _next(spark, d).select("conv_id", "turn", F.round(corpus_metrics.rouge_l("p", "r"), 6).alias("rouge_l"))
