"""Queries of decontamination, edit rates, chains, places, schemas, mathematics and trainer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers, ddl, listings, mathequal
from millrace.operators import chain, dedup, edit_rate, positions, records, stems, validators
from millrace.plans.catalog import _FOLD, query, spread, t

_PLAIN = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_SIDE = "coalesce(list_filter(m, lambda x: lower(x.role) = '{0}' AND x.content <> '')[1].content, '')"


@query(f"""WITH c AS (SELECT 'chat ' || conv_id AS id, {_SIDE.format('user')} AS u, {_SIDE.format('assistant')} AS a FROM ({_FOLD})
 UNION ALL SELECT 'item ' || item_id, coalesce(text, ''), CASE WHEN item_id % 3 = 0 THEN 'x' ELSE '' END FROM benchmark),
n AS (SELECT id, {_PLAIN.format('u')} AS u, substring({_PLAIN.format('a')}, 1, 500) AS a FROM c),
b AS (SELECT DISTINCT {_PLAIN.format("replace(substring(coalesce(text, ''), 1, length(text) * (7 + item_id % 4) // 10), ' ', '  ')")} AS b FROM benchmark)
SELECT DISTINCT id FROM n, b WHERE (substring(u, 1, 500) = substring(b, 1, 500) AND a = '') OR u = b
 OR (length(u) > 50 AND length(b) > 50 AND length(u) / length(b) BETWEEN 0.8 AND 1.25 AND (contains(u, b) OR contains(b, u)))""")
def contaminated_chats(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, and benchmark items as chats, against questions that are items with wider spaces, whole or without their end."""
    talks = records.fold_messages(t(spark, d, "conversations")).select(F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("id"), *dedup.chat_sides(F.col("messages")))
    items = t(spark, d, "benchmark")
    asked = items.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("user"), F.when(F.col("item_id") % 3 == 0, "x").otherwise("").alias("assistant"))
    part = F.floor(F.length("text") * (7 + F.col("item_id") % 4) / 10).cast("int")
    bench = items.select(F.replace(F.substring("text", F.lit(1), part), F.lit(" "), F.lit("  ")).alias("user"), F.lit("").alias("assistant"))
    return dedup.contaminated_chats(talks.unionByName(asked), bench, id_col="id").withColumnRenamed("_id", "id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """id, p, refs: each question of a conversation against the one two turns on."""
    asked = t(spark, d, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("p"))
    later = asked.select("conv_id", (F.col("turn") - 2).alias("turn"), F.array("p").alias("refs"))
    return asked.join(later, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "p", "refs")


@query("""WITH RECURSIVE u AS (SELECT conv_id, turn, min(text) AS s FROM conversations WHERE role = 'user' GROUP BY ALL),
w AS (SELECT p.conv_id || ':' || p.turn AS id, list_filter(regexp_split_to_array(lower(coalesce(p.s, '')), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(r.s, '')), '\\s+'), lambda x: x <> '') AS b
 FROM u p JOIN u r ON r.conv_id = p.conv_id AND r.turn = p.turn + 2),
e AS (SELECT id, a, b, 0 AS i, CAST(range(len(b) + 1) AS BIGINT[]) AS row FROM w
 UNION ALL SELECT id, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: list_min(list_transform(range(j + 1), lambda k: CASE WHEN k = 0 THEN i + 1
  ELSE least(row[k + 1] + 1, row[k] + CASE WHEN a[i + 1] = b[k] THEN 0 ELSE 1 END) - k END)) + j) FROM e WHERE i < len(a))
SELECT id, row[len(b) + 1] AS edits, CAST(len(b) AS DOUBLE) AS ref_words FROM e WHERE i = len(a)""")
def question_edits(spark: SparkSession, d: str) -> DataFrame:
    return edit_rate.edit_rows(_questions(spark, d), id_col="id", pred="p", refs="refs", beam=None, shifts=False)


@query(None)
def question_ter(spark: SparkSession, d: str) -> DataFrame:
    """With shifts, which SQL does not state; tested against a search of all moves."""
    return edit_rate.ter(_questions(spark, d), id_col="id", pred="p", refs="refs").select(F.round("score", 9).alias("ter"))


@query(None)
def rouge_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems are tested word by word."""
    return _questions(spark, d).select("id", F.round(stems.rouge_l_stemmed("p", "refs"), 6).alias("rouge_l"))


_N = "SELECT doc_id, text, lang, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS n FROM documents"


@query(f"""WITH a AS ({_N}), f AS (SELECT * FROM a WHERE n <> ''), l AS (SELECT * FROM f WHERE length(trim(text)) >= 200), u AS (SELECT n, min(doc_id) AS doc_id FROM l GROUP BY n),
b AS (SELECT DISTINCT {_PLAIN.format('text')} AS b FROM benchmark),
k AS (SELECT doc_id FROM u WHERE NOT EXISTS (SELECT 1 FROM b WHERE b <> '' AND (substring(n, 1, 500) = substring(b, 1, 500) OR (length(n) > 100 AND length(b) > 100 AND length(n) / length(b) BETWEEN 0.8 AND 1.25 AND (contains(n, b) OR contains(b, n)))))),
c AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM u) AS u, (SELECT count(*) FROM k) AS k)
SELECT 0 AS place, 'filled' AS step, a AS total, f AS valid, 0 AS error, a - f AS filtered, false AS kept_input FROM c UNION ALL SELECT 1, 'long enough', f, l, 0, f - l, false FROM c
 UNION ALL SELECT 2, 'never', l, 0, 0, l, true FROM c UNION ALL SELECT 3, 'distinct', l, u, 0, l - u, false FROM c UNION ALL SELECT 4, 'benchmark', u, k, 0, u - k, false FROM c""")
def cleaning_chain(spark: SparkSession, d: str) -> DataFrame:
    made = chain.REGISTRY
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    steps = [("filled", made["filled"]()), ("long enough", made["least_length"](least=200)), ("never", chain.rows(keep=F.lit(False))), ("distinct", made["distinct"]()), ("benchmark", made["benchmark"](t(spark, d, "benchmark")))]
    return chain.report(spark, chain.run(docs, steps, home=chain.shared_home(spark))[1])


@query("""WITH e AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT position, event_id, o_orderkey FROM e LEFT JOIN o USING (position)""")
def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Events as details of the orders, by place."""
    return positions.by_position(t(spark, d, "events").select("event_id"), t(spark, d, "orders").select("o_orderkey"), details_order=("event_id",), records_order=("o_orderkey",))


@query("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, CASE WHEN value < 20 THEN 0.0 ELSE 1.0 END AS score FROM events),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
SELECT position, event_id, o_orderkey FROM (SELECT * FROM e WHERE score = 0 ORDER BY position LIMIT 10) LEFT JOIN o USING (position)""")
def zero_samples(spark: SparkSession, d: str) -> DataFrame:
    scored = t(spark, d, "events").select("ts", "event_id", F.when(F.col("value") < 20, 0.0).otherwise(1.0).alias("score"))
    found = positions.zero_samples(scored, t(spark, d, "orders").select("o_orderdate", "o_orderkey"), score="score", details_order=("ts", "event_id"), records_order=("o_orderdate", "o_orderkey"))
    return found.select("position", "event_id", "o_orderkey")


@query("""WITH p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, lower(p_type) AS ty FROM part),
c AS (SELECT p_partkey, unnest([a, b, a || b, ty]) || '_id' AS col, b AS tb, a AS other, ty FROM p),
x AS (SELECT DISTINCT p_partkey, col FROM c WHERE p_partkey % 5 <> 0 AND col <> ty || '_id' AND (contains(tb, replace(col, '_id', '')) OR contains(replace(col, '_id', ''), tb)))
SELECT p.p_partkey, coalesce((SELECT string_agg(col, ',' ORDER BY col) FROM x WHERE x.p_partkey = p.p_partkey), '') AS redundant FROM p""")
def redundant_ids(spark: SparkSession, d: str) -> DataFrame:
    """A schema of each part's words before and after columns were added; every fifth table had no id."""
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    a, b, kind = word(1), word(2), F.lower("p_type")
    own = F.when(F.col("p_partkey") % 5 == 0, "key").otherwise("ID")
    old = F.concat(F.lit("-- (first\nCREATE TABLE IF NOT EXISTS "), b, F.lit(" ("), own, F.lit(" INTEGER PRIMARY KEY, "), kind, F.lit("_id DECIMAL(10, 2) DEFAULT ',x_id INT', CHECK (a > 0, b), note TEXT);"))
    extra = [F.concat(F.lit(', "'), c, F.lit('_id" INT')) for c in (a, b, F.concat(a, b))]
    new = F.concat(F.regexp_replace(old, r"\);$", ""), *extra, F.lit(");"))
    read = t(spark, d, "part").select("p_partkey", ddl.tables(old).alias("old"), ddl.tables(new).alias("new"))
    found = read.select("p_partkey", ddl.redundant_ids(F.col("old"), F.col("new")).alias("r"))
    return found.select("p_partkey", F.array_join(F.array_distinct(F.transform("r", lambda x: x["column"])), ",").alias("redundant"))


def _spelled(n: Column) -> Column:
    """A whole number under a hundred thousand in words."""
    small, tens = (F.array(*map(F.lit, words)) for words in (answers.SMALL, ("", "", *answers.TENS)))
    two = lambda x: F.when(x < 20, F.get(small, x)).when(x % 10 == 0, F.get(tens, (x / 10).cast("int"))).otherwise(F.concat(F.get(tens, F.floor(x / 10).cast("int")), F.lit("-"), F.get(small, x % 10)))
    three = lambda x: F.concat_ws(" ", F.when(x >= 100, F.concat(F.get(small, F.floor(x / 100).cast("int")), F.lit(" Hundred"))), F.when((x % 100 > 0) | (x == 0), two(x % 100)))
    thousands, rest = F.floor(n / 1000).cast("int"), (n % 1000).cast("int")
    return F.concat_ws(" and ", F.when(thousands > 0, F.concat(three(thousands), F.lit(" thousand"))), F.when((rest > 0) | (n == 0), three(rest)))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS said FROM orders")
def spelled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Customers' numbers, spelled and read again."""
    return spread(t(spark, d, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", answers.number_words(F.concat(F.lit("customer "), _spelled(F.col("o_custkey")))).alias("said"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'math_verify' END AS found FROM customer""")
def verified_shares(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations over their numbers as an answer in a box, against the same share in another form, or another share."""
    n, m = (F.col("c_nationkey") + 2).cast("string"), (F.col("c_custkey") + 1).cast("string")
    other = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_nationkey") + 3).cast("string")).otherwise(n)
    pred = F.concat(F.lit("So it is \\boxed{\\frac{"), n, F.lit("\\sqrt{8}}{"), m, F.lit("}}."))
    ref = F.concat(F.lit("\\frac{-4"), F.lit("\\cdot"), other, F.lit("}{-"), m, F.lit("\\sqrt{2}}"))
    rows = spread(t(spark, d, "customer").select("c_custkey", "c_nationkey")).select("c_custkey", pred.alias("p"), ref.alias("r"))
    return mathequal.verified(rows, pred="p", ref="r", name="found").select("c_custkey", "found")


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS instruction, text AS output, lang FROM documents)
SELECT 'error' AS level, CAST(doc_id AS VARCHAR) AS id, CASE WHEN instruction IS NULL THEN 'neither conversations nor instruction' ELSE 'no output' END AS message FROM r WHERE instruction IS NULL OR output IS NULL
 UNION ALL SELECT 'warning', NULL, 'several forms' FROM (SELECT count(DISTINCT instruction IS NULL OR output IS NULL) AS n FROM (SELECT * FROM r ORDER BY doc_id LIMIT 10)) WHERE n > 1
 UNION ALL SELECT 'error', NULL, 'a form that is not supported' FROM (SELECT count(*) FILTER (WHERE instruction IS NULL OR output IS NULL) AS n FROM (SELECT * FROM r ORDER BY doc_id LIMIT 10)) WHERE n > 0""")
def trainer_samples(spark: SparkSession, d: str) -> DataFrame:
    """Documents as instructions by source; every seventh lacks its instruction."""
    rows = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("instruction"), F.col("text").alias("output"))
    return validators.trainer_report(rows, id_col="doc_id", order="doc_id")


@query("""WITH RECURSIVE s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), w AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM s),
b AS (SELECT doc_id, CASE WHEN lower(trim(coalesce(l[1], ''))) LIKE 'file list%' THEN l[2:] ELSE l END AS l, len(l) AS n FROM w),
f AS (SELECT doc_id, l, n, 0 AS i, 0 AS chars, 0 AS held, 0 AS parts FROM b
 UNION ALL SELECT doc_id, l, n, i + 1, CASE WHEN held = 0 OR chars + length(l[i + 1]) + 1 > 2000 OR held >= 20 THEN 0 ELSE chars END + length(l[i + 1]) + 1,
  CASE WHEN held = 0 OR chars + length(l[i + 1]) + 1 > 2000 OR held >= 20 THEN 1 ELSE held + 1 END, parts + CASE WHEN held = 0 OR chars + length(l[i + 1]) + 1 > 2000 OR held >= 20 THEN 1 ELSE 0 END FROM f WHERE i < len(l))
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(parts, 1) END AS BIGINT) AS parts FROM f WHERE i = len(l)""")
def listing_parts(spark: SparkSession, d: str) -> DataFrame:
    """Into how many parts each document goes as a listing of its lines; the parts' texts are tested against a plain fold."""
    parts = listings.listing_parts(F.col("text"), max_chars=2000, max_lines=20)
    return t(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("parts"))
