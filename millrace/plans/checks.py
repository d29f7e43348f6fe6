"""Queries of validators, changes to records and metrics by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import records, registry, shaping, validators
from millrace.plans.catalog import _FILLED, _FOLD, query, t
from millrace.plans.texts import _next

_SHARE = f"SELECT conv_id, list_transform(m, lambda x: struct_pack(who := CASE lower(x.role) WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END, content := x.content)) AS s FROM ({_FOLD})"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return records.fold_messages(t(spark, d, "conversations"))


def _share(spark: SparkSession, d: str) -> DataFrame:
    who = lambda x: F.when(F.lower(x["role"]) == "user", "human").when(F.lower(x["role"]) == "assistant", "gpt").otherwise(x["role"])
    return _folded(spark, d).select("conv_id", F.transform("messages", lambda x: F.struct(who(x).alias("from"), x["content"].alias("value"))).alias("s"))


@query(f"""SELECT conv_id, len(s) > 0 AND len(list_filter(s, lambda x: coalesce(trim(x.who), '') = '' OR NOT ({_FILLED}))) = 0 AND len(list_filter(s, lambda x: lower(trim(x.who)) = 'human')) > 0
 AND len(list_filter(s, lambda x: lower(trim(x.who)) = 'gpt')) > 0 AS valid FROM ({_SHARE})""")
def sharegpt_validity(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).select("conv_id", validators.valid_sharegpt(F.col("s")).alias("valid"))


@query(f"""SELECT conv_id, len(list_filter(m, lambda x: lower(trim(x.role)) NOT IN ('system', 'user', 'assistant') OR NOT ({_FILLED}))) = 0 AND list_contains(list_transform(m, lambda x: lower(trim(x.role))), 'system')
 AND list_contains(list_transform(m, lambda x: lower(trim(x.role))), 'user') AND list_contains(list_transform(m, lambda x: lower(trim(x.role))), 'assistant') AS valid FROM ({_FOLD})""")
def rewrite_validity(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("conv_id", validators.valid_rewrite(F.col("messages")).alias("valid"))


@query(f"""WITH v AS (SELECT conv_id, len(m) AS turns, len(list_filter(m, lambda x: NOT ({_FILLED} OR lower(x.role) = 'system'))) = 0 AND len(list_filter(m, lambda x: lower(x.role) = 'user')) > 0
 AND len(list_filter(m, lambda x: lower(x.role) = 'assistant')) > 0 AS ok FROM ({_FOLD}))
SELECT turns, count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM v GROUP BY turns""")
def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).withColumn("turns", F.size("messages").cast("long"))
    return validators.filter_counts(rows, records.valid_messages(F.col("messages")), "turns")


@query("""SELECT doc_id, 'quality' AS field FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL
 UNION ALL SELECT doc_id, 'text' FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NULL UNION ALL SELECT doc_id, 'licence' FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return validators.missing_fields(rows, ("text", "quality", "toxic", "licence"), id_col="doc_id")


@query(f"""WITH e AS (SELECT conv_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM ({_SHARE})), k AS (SELECT conv_id, i, x.who AS who, x.content AS content FROM e),
a AS (SELECT conv_id, i, 0 AS n, 'turn ' || i || ': from is ' || who AS msg FROM k WHERE who NOT IN ('human', 'gpt', 'system')
 UNION ALL SELECT conv_id, i, 0, 'turn ' || i || ': no from' FROM k WHERE who IS NULL
 UNION ALL SELECT conv_id, i, 1, 'turn ' || i || ': no value' FROM k WHERE content IS NULL)
SELECT c.conv_id, coalesce(string_agg(msg, '; ' ORDER BY i, n), '') AS errors FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id) GROUP BY c.conv_id""")
def trainer_errors(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).select("conv_id", F.array_join(validators.turn_errors(F.col("s")), "; ").alias("errors"))


_SHOWN = "array_to_string(list_transform({0}, lambda x: x.role || '|' || coalesce(x.content, '')), chr(10))"


def _shown(m) -> F.Column:  # noqa: ANN001
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("|"), F.coalesce(x["content"], F.lit("")))), "\n")


@query(f"""WITH p AS (SELECT conv_id, m, list_position(list_transform(m, lambda x: lower(x.role)), 'system') AS p FROM ({_FOLD})),
r AS (SELECT conv_id, CASE WHEN p > 0 THEN list_concat(m[1:p - 1], [struct_pack(role := m[p].role, content := 'Answer in one line.')], m[p + 1:]) ELSE list_concat(m, [struct_pack(role := 'system', content := 'Answer in one line.')]) END AS m FROM p)
SELECT conv_id, {_SHOWN.format('m')} AS messages FROM r""")
def upsert_system(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("conv_id", _shown(shaping.upsert_message(F.col("messages"), "system", F.lit("Answer in one line."))).alias("messages"))


@query(f"""WITH p AS (SELECT conv_id, m, list_position(list_transform(m, lambda x: lower(x.role)), 'assistant') AS p FROM ({_FOLD})),
r AS (SELECT conv_id, CASE WHEN p > 0 THEN list_concat(m[1:p - 1], [struct_pack(role := m[p].role, content := '<think>' || m[1].role || ' first</think>' || coalesce(m[p].content, ''))], m[p + 1:]) ELSE m END AS m FROM p)
SELECT conv_id, {_SHOWN.format('m')} AS messages FROM r""")
def think_first(spark: SparkSession, d: str) -> DataFrame:
    why = F.concat(F.try_element_at("messages", F.lit(1))["role"], F.lit(" first"))
    return _folded(spark, d).select("conv_id", _shown(shaping.think_first(F.col("messages"), why)).alias("messages"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'own-' || d.doc_id END, 'label-' || l.doc_id) AS id,
 CASE WHEN d.lang = 'en' THEN d.lang ELSE coalesce(CAST(l.q AS VARCHAR), '') END AS lang, coalesce(CAST(l.q AS VARCHAR), '') AS quality
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)""")
def merge_identity(spark: SparkSession, d: str) -> DataFrame:
    """Documents, of which every third has no id and only English ones a language, take over what their labels have."""
    none = F.expr("cast(map() as map<string, string>)")
    made = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("own-"), F.col("doc_id").cast("string"))).alias("id"), F.when(F.col("lang") == "en", F.create_map(F.lit("lang"), F.col("lang"))).otherwise(none).alias("meta"))
    q = F.max("quality").cast("string")
    source = t(spark, d, "labels").groupBy("doc_id").agg(q.alias("q")).select("doc_id", F.concat(F.lit("label-"), F.col("doc_id").cast("string")).alias("id"), F.create_map(F.lit("lang"), F.col("q"), F.lit("quality"), F.col("q")).alias("meta"))
    merged = shaping.merge_identity(made, source, key="doc_id", id_col="id", meta_col="meta")
    at = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return merged.select("doc_id", "id", at("lang").alias("lang"), at("quality").alias("quality"))


_PAIRS = "(SELECT x.text AS p, y.text AS r FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) x JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"


def _option(x: str) -> str:
    named = f"regexp_extract(upper({x}), '(?:ANSWER|OPTION)\\s*[:IS]\\s*\\(?([A-Z])', 1)"
    return f"nullif(CASE WHEN {named} <> '' THEN {named} ELSE regexp_extract(upper({x}), '(?:^|[^A-Z0-9_])([A-Z])(?:[^A-Z0-9_]|$)', 1) END, '')"


@query(f"""WITH s AS (SELECT p, r, {_option('p')} AS op, {_option('r')} AS orr, regexp_matches(replace(coalesce(regexp_extract_all(string_split(p, '####')[-1], '\\\\boxed\\{{([^}}]+)\\}}', 1)[-1], string_split(p, '####')[-1]), ',', ''), '\\d') AS num FROM {_PAIRS}),
v AS (SELECT coalesce(p = r, false) AS strict, coalesce(op = orr, false) AS choice, coalesce(trim(p) = trim(r), false) OR coalesce(op = orr, false) AS acc, coalesce(num, false) AS num, op IS NOT NULL AS has FROM s)
SELECT 'strict_match' AS metric, round(avg(CAST(strict AS INT)), 6) AS score, count(*) AS n FROM v UNION ALL SELECT 'choice_accuracy', round(avg(CAST(choice AS INT)), 6), count(*) FROM v
 UNION ALL SELECT 'accuracy', round(avg(CAST(acc AS INT)), 6), count(*) FROM v UNION ALL SELECT 'extraction_rate', round(avg(CAST(num AS INT)), 6), count(*) FROM v
 UNION ALL SELECT 'missing_answer_rate', round(avg(1 - CAST(num AS INT)), 6), count(*) FROM v UNION ALL SELECT 'choice_extraction_rate', round(avg(CAST(has AS INT)), 6), count(*) FROM v""")
def metrics_by_name(spark: SparkSession, d: str) -> DataFrame:
    pairs = _next(spark, d).select("p", F.array("r").alias("refs"))
    return registry.evaluate(pairs, ("strict", "mc_accuracy", "ACC", "accuracy", "extraction_rate", "missing_answer_rate", "choice_extraction_rate"), pred="p", refs="refs").withColumn("score", F.round("score", 6))


@query("""WITH x AS (SELECT d.lang AS y, CASE WHEN l.quality = 1 THEN d.lang ELSE 'en' END AS p FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL),
k AS (SELECT y AS k FROM x UNION SELECT p FROM x), e AS (SELECT k, (SELECT count(*) FROM x WHERE p = k) AS np, (SELECT count(*) FROM x WHERE y = k) AS ny, (SELECT count(*) FROM x WHERE p = k AND y = k) AS c FROM k),
s AS (SELECT CAST(sum(c) AS DOUBLE) AS c, CAST(sum(ny) AS DOUBLE) AS s, CAST(sum(np * ny) AS DOUBLE) AS py, CAST(sum(np * np) AS DOUBLE) AS pp, CAST(sum(ny * ny) AS DOUBLE) AS yy FROM e)
SELECT round((c * s - py) / sqrt((s * s - pp) * (s * s - yy)), 6) AS mcc FROM s""")
def mcc_multiclass(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("quality is not null and lang is not null")
    return registry.mcc(rows.withColumn("p", F.when(F.col("quality") == 1, F.col("lang")).otherwise("en")), pred_col="p", label_col="lang").select(F.round("mcc", 6).alias("mcc"))
