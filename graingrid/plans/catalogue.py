"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows.

The tables hold no judge scores, so scores are derived from other columns by integer arithmetic; what is tested is the
operator. Results are flat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.rows import POS
from ..operators import aggregate, builders, joins, select, votes
from ..sources import jsonl, loaders, media
from .registry import QUERIES, SQL, Query
from .registry import query as _query
from .registry import table as _t

__all__ = ["QUERIES", "SQL"]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """documents with metrics: quality (null where unlabelled), size 0-9, and clean, a boolean."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = _t(spark, sf, "labels")
    return d.join(labels, d.id == labels.doc_id, "left").select(POS, "id", "lang", "source", "n_chars", "quality", (F.col("n_chars") % 10).alias("size"), (F.col("toxic") == 0).alias("clean"))


_SCORED = "SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, l.quality, d.n_chars % 10 AS size, l.toxic = 0 AS clean FROM documents d LEFT JOIN labels l USING (doc_id)"
_METRICS = ["quality", "size", "clean"]
_MEAN = "(coalesce(quality, 0) + size + coalesce(clean::INT, 0))::DOUBLE / (1 + (quality IS NOT NULL)::INT + (clean IS NOT NULL)::INT)"


@_query(f"WITH s AS ({_SCORED}) SELECT id, quality, size, clean FROM s WHERE quality >= 1 AND size >= 3 AND clean")
def quality_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return select.quality_filter(_scored(spark, sf), {"quality": 1, "size": 3, "clean": True}).select("id", "quality", "size", "clean")


@_query(f"WITH s AS ({_SCORED}) SELECT id, quality, size, clean FROM s WHERE (quality IS NULL OR quality >= 1) AND size >= 3 AND (clean IS NULL OR clean)")
def quality_filter_lenient(spark: SparkSession, sf: str) -> DataFrame:
    return select.quality_filter(_scored(spark, sf), {"quality": 1, "size": 3, "clean": True}, require_all=False).select("id", "quality", "size", "clean")


@_query(f"WITH s AS (SELECT *, {_MEAN} AS avg_score FROM ({_SCORED})) SELECT id, avg_score FROM s ORDER BY avg_score DESC, id LIMIT 100")
def quality_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_k(_scored(spark, sf), _METRICS, k=100).select("id", F.col("_avg").alias("avg_score"))


@_query(f"WITH s AS (SELECT *, {_MEAN} AS avg_score FROM ({_SCORED})), r AS (SELECT *, row_number() OVER (ORDER BY avg_score DESC, id) AS rn, count(*) OVER () AS n FROM s) SELECT id, avg_score FROM r WHERE rn <= floor(n * 0.37)")
def quality_top_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_k(_scored(spark, sf), _METRICS, fraction=0.37).select("id", F.col("_avg").alias("avg_score"))


@_query(
    f"WITH s AS (SELECT *, {_MEAN} AS avg_score FROM ({_SCORED})), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY avg_score DESC, id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM s)"
    " SELECT id, lang, avg_score FROM r WHERE k <= greatest(1, ceil(n * 0.3))"
)
def per_group_top_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return select.per_group_top(_scored(spark, sf), "lang", _METRICS, fraction=0.3).select("id", "lang", F.col("_avg").alias("avg_score"))


@_query(f"WITH s AS (SELECT *, {_MEAN} AS avg_score FROM ({_SCORED})), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY avg_score DESC, id) AS rank FROM s) SELECT id, source, avg_score FROM r WHERE rank <= 5")
def per_group_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return select.per_group_top(_scored(spark, sf), "source", _METRICS, k=5).select("id", "source", F.col("_avg").alias("avg_score"))


@_query(f"SELECT avg(quality) AS quality, avg(size) AS size, avg(clean::INT) AS clean FROM ({_SCORED})")
def metric_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.metric_means(_scored(spark, sf), _METRICS)


@_query("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.group_counts(_t(spark, sf, "documents"), "lang")


@_query("WITH r AS (SELECT doc_id AS id, quality, toxic, doc_id AS p FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, doc_id + 1000000000 FROM labels WHERE doc_id % 3 = 0), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC) = 1) SELECT d.doc_id AS id, l.quality, l.toxic FROM documents d LEFT JOIN l ON d.doc_id = l.id")
def score_merge_left(spark: SparkSession, sf: str) -> DataFrame:
    labels = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic", F.col("doc_id").alias(POS))
    again = labels.where("id % 3 = 0").select("id", (1 - F.col("quality")).alias("quality"), "toxic", (F.col(POS) + 1000000000).alias(POS))
    rows = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(-1).alias("quality"))
    return joins.merge_scores(rows, labels.union(again), metrics=["quality", "toxic"])


@_query("SELECT d.doc_id AS id, coalesce(l.quality, 7) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def score_update_left(spark: SparkSession, sf: str) -> DataFrame:
    labels = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", F.col("doc_id").alias(POS))
    return joins.update_scores(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(7).alias("quality")), labels)


@_query("SELECT o_orderkey AS id, o_orderkey % 7 AS m0, (o_orderkey + 1) % 7 AS m1, (o_orderkey + 2) % 7 AS m2 FROM orders")
def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    fanned = joins.fan_metrics(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), ["m0", "m1", "m2"])
    return joins.pivot_metrics(fanned.withColumn("score", (F.col("id") + F.substring("metric", 2, 1).cast("int")) % 7), ["m0", "m1", "m2"], ["id"])


@_query("SELECT d.doc_id::VARCHAR AS id, coalesce(nullif(CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE d.text END, ''), d.source) AS problem, coalesce(nullif(l.quality::VARCHAR, '0'), d.lang) AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def load_truthy_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    rows = d.select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("problem"), F.col("source").alias("instruction"), F.nullif(F.col("quality").cast("string"), F.lit("0")).alias("answer"), F.col("lang").alias("output"))
    return loaders.problem_answer_pairs(rows).drop(POS)


@_query("WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS query, source, lang FROM documents) SELECT 'seed_' || doc_id AS id, coalesce(nullif(query, ''), source) AS question, CASE WHEN doc_id % 5 = 0 THEN source ELSE lang END AS answer, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_aliases FROM r")
def normalize_seed_aliases(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    answers = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(" "), "source")).otherwise(F.array(F.concat(F.lit(" "), "lang"), F.lit(""), F.col("source")))
    rows = d.select(F.col("doc_id").alias(POS), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("query"), F.col("source").alias("prompt"), answers.alias("answers"))
    return loaders.search_seeds(rows).select("id", "question", "answer", F.size("answer_aliases").alias("n_aliases"))


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select(F.col("conv_id").alias(POS), F.col("conv_id").alias("id"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


_LAST = "coalesce(max_by(text, turn) FILTER (WHERE role = '{0}'), '')"


@_query(
    f"WITH c AS (SELECT conv_id::VARCHAR AS id, {_LAST.format('user')} AS instruction, {_LAST.format('assistant')} AS output FROM conversations GROUP BY conv_id)"
    " SELECT id, instruction, output, length(output)::INT AS size FROM c WHERE instruction <> '' AND output <> '' AND length(trim(output, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 50 AND 4000"
)
def sft_from_conversations(spark: SparkSession, sf: str) -> DataFrame:
    samples = loaders.eval_samples(_talks(spark, sf))
    rows = builders.sft(samples, min_length=50, max_length=4000)
    last = F.element_at("messages", -1)["content"]
    return rows.select(F.get_json_object("metadata", "$.request_id").alias("id"), F.element_at("messages", 1)["content"].alias("instruction"), last.alias("output"), F.length(last).alias("size"))


@_query(f"WITH c AS (SELECT conv_id, {_LAST.format('system')} AS s, {_LAST.format('user')} AS u, {_LAST.format('assistant')} AS output FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN s <> '' THEN s || chr(10) || chr(10) || u ELSE u END AS instruction, output FROM c")
def alpaca_convert(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.alpaca(_talks(spark, sf)).withColumnRenamed(POS, "conv_id")


@_query("SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def sft_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    # the key is a digest, so that texts don't travel to be compared
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("digest"))
    return select.keep_first(d, [F.col("digest")], ["doc_id"]).select("doc_id")


_WANT = {"en": 0.4, "fr": 0.3, "de": 0.2, "it": 0.1}


@_query(
    "WITH w(lang, ratio, place) AS (VALUES ('en', 0.4::DOUBLE, 0), ('fr', 0.3::DOUBLE, 1), ('de', 0.2::DOUBLE, 2), ('it', 0.1::DOUBLE, 3)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT count(*) AS total FROM documents),"
    " q AS (SELECT c.lang, n, ratio * total AS target, floor(ratio * total) AS base, place, total FROM c JOIN w USING (lang), t), r AS (SELECT *, total - sum(base) OVER () AS more, row_number() OVER (ORDER BY target - base DESC, place) AS k FROM q),"
    " z AS (SELECT lang, n, (base + (k <= more)::INT)::BIGINT AS quota FROM r), d AS (SELECT doc_id, lang, n, quota, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS turn FROM documents JOIN z USING (lang))"
    " SELECT doc_id, lang, unnest(range(1, (quota // n + (turn <= quota % n)::INT + 1)::BIGINT)) AS copy FROM d"
)
def balance_quota(spark: SparkSession, sf: str) -> DataFrame:
    return select.balance(_t(spark, sf, "documents").select("doc_id", "lang"), _WANT, "lang", "doc_id", 42).withColumnRenamed("_copy", "copy")


@_query(
    "WITH s AS (SELECT d.doc_id AS id, d.n_chars % 12 AS cd, d.doc_id % 10 AS rv, l.quality AS c FROM documents d JOIN labels l USING (doc_id)), b AS (SELECT *, (cd >= 0)::INT + (cd >= 3)::INT + (cd >= 6)::INT + (cd >= 10)::INT - 1 AS cd_bin FROM s WHERE c >= 1 AND cd <= 10),"
    " t AS (SELECT *, 2.0::DOUBLE + cd_bin * 4.0::DOUBLE AS rv_target FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY cd_bin ORDER BY abs(rv - rv_target), id) AS k FROM t) SELECT id, cd_bin, rv_target FROM n WHERE k <= 20"
)
def rvcd_mix(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), (F.col("n_chars") % 12).alias("cd"), (F.col("doc_id") % 10).alias("rv"), F.col("quality").alias("c"))
    return select.mix_by_difficulty(s, per_bin=20, cd="cd", rv="rv", correct="c").select("id", "cd_bin", "rv_target")


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    g = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("i"))
    return g.select(F.col("l_orderkey").alias("id"), F.transform("i", lambda x: F.concat_ws("-", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))).alias("candidates"), F.transform("i", lambda x: x["l_quantity"]).alias("candidate_scores"))


_OFFERS = "SELECT l_orderkey AS id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS t, l_quantity AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


@_query(f"WITH r AS ({_OFFERS}) SELECT a.id, a.t AS chosen, b.t AS rejected, a.s AS chosen_score, b.s AS rejected_score FROM r a JOIN r b ON a.id = b.id AND b.k = CASE WHEN a.k = a.n THEN a.n - 1 ELSE a.n END WHERE a.n >= 2 AND a.k <= 2 AND a.s - b.s >= 5")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return select.preference_pairs(_offers(spark, sf), min_margin=5, max_pairs=2)


@_query(f"WITH r AS ({_OFFERS}) SELECT a.id::VARCHAR AS instruction, '' AS input, a.t AS chosen, b.t AS rejected FROM r a JOIN r b ON a.id = b.id AND b.k = a.n WHERE a.n >= 2 AND a.k = 1 AND length(a.t) <= 9 AND length(b.t) <= 9")
def preference_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    pairs = select.preference_pairs(_offers(spark, sf)).withColumn("instruction", F.col("id").cast("string")).withColumn(POS, F.col("id"))
    return builders.preference(pairs, max_length=9).drop(POS)


@_query("SELECT l_orderkey AS id, array_to_string(list(concat_ws('-', l_linenumber, l_partkey, l_suppkey) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), ',') AS candidates FROM lineitem GROUP BY 1")
def candidates_gather(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    flat = li.select(F.col("l_orderkey").alias(POS), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("candidate_idx"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("response"))
    rows = li.select(F.col("l_orderkey").alias(POS)).distinct()
    return joins.gather(rows, flat).select(F.col(POS).alias("id"), F.array_join("candidates", ",").alias("candidates"))


@_query("SELECT c_custkey::VARCHAR || '_c' || i AS request_id, c_custkey, i::INT AS candidate_idx FROM customer, range(3) r(i)")
def fanout_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("id"))
    return joins.fan_out(rows, 3, id_format="{id}_c{i}").select("request_id", "c_custkey", "candidate_idx")


@_query(
    "WITH a AS (SELECT doc_id, n_chars, 'The answer is ' || doc_id || '.' AS good FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 / (1.0 + 0.001 * length(good)) ELSE 0.0 END AS score_a, 1.0 / (1.0 + 0.001 * length('<thinking>' || repeat('x', (n_chars % 50)::INT) || '</thinking>' || '#### ' || doc_id)) * 0 + 1.0 / (1.0 + 0.001 * CASE WHEN n_chars % 50 = 0 THEN length('<thinking></thinking>#### ' || doc_id) ELSE n_chars % 50 END) AS score_b FROM a"
)
def cot_score(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.judges import cot_scores

    d = _t(spark, sf, "documents")
    ref = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id")).cast("string")
    first = F.concat(F.lit("The answer is "), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1000000).cast("string"), F.lit("."))
    second = F.concat(F.lit("<thinking>"), F.repeat(F.lit("x"), (F.col("n_chars") % 50).cast("int")), F.lit("</thinking>#### "), F.col("doc_id").cast("string"))
    rows = d.select("doc_id", ref.alias("answer"), F.array(first, second).alias("candidates"))
    return cot_scores(rows).select("doc_id", F.element_at("candidate_scores", 1).alias("score_a"), F.element_at("candidate_scores", 2).alias("score_b"))


@_query("SELECT doc_id, trim(lang) AS first_tag, '</answer><answer>' || source AS last_tag, CASE WHEN doc_id % 2 = 0 THEN lang END AS boxed FROM documents")
def extract_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    t = F.concat(F.lit("noise <answer> "), "lang", F.lit("\n</answer> <answer></answer><answer>"), "source", F.lit("</answer> "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[["), "lang", F.lit("]]"))).otherwise(""))
    d = d.select("doc_id", t.alias("t"))
    return d.select("doc_id", text.first_tag(F.col("t"), "answer").alias("first_tag"), text.last_tag(F.col("t"), "answer").alias("last_tag"), text.between(F.col("t"), "[[", "]]").alias("boxed"))


@_query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN (n_chars % 10)::INT WHEN 1 THEN (n_chars % 100)::INT WHEN 2 THEN 1 WHEN 3 THEN 0 END AS score FROM documents")
def extract_score(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat(F.lit("In 3 steps: <score>"), (F.col("n_chars") % 10).cast("string"), F.lit("</score>"))).when(k == 1, F.concat(F.lit("I give "), (F.col("n_chars") % 100).cast("string"), F.lit(" points"))).when(k == 2, "This is Correct").when(k == 3, "simply incorrect").otherwise("no idea")
    return _t(spark, sf, "documents").select("doc_id", text.score(t).alias("score"))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Math' WHEN doc_id % 3 = 1 THEN 'Code' ELSE 'Others' END AS category FROM documents")
def extract_category(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<answer>Math</answer> or Code "), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<answer>code it is</answer> aftermath "), "lang")).otherwise("nothing of the codes")
    return _t(spark, sf, "documents").select("doc_id", text.category(t, ["Math", "Code"]).alias("category"))


@_query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, len(regexp_extract_all(html, '(?s)<p>(.+?)</p>'))::INT AS paragraphs FROM pages")
def html_tag_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.size(text.all_tags(F.col("html"), "p")).alias("paragraphs"))


@_query("SELECT event_id, json_extract_string(CASE WHEN event_id % 7 = 0 THEN '{broken' ELSE props END::VARCHAR, '$.k') AS k FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END AS props FROM events) WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0")
def json_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    props = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props"))
    return _t(spark, sf, "events").select("event_id", jsonx.field(props, "k").alias("k"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 10)::INT WHEN 1 THEN (event_id % 10)::INT WHEN 2 THEN NULL ELSE 4 END AS difficulty, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS format_valid FROM events")
def judge_salvage(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id") % 4, (F.col("event_id") % 10).cast("string")
    t = F.when(k == 0, F.concat(F.lit('{"difficulty": '), n, F.lit(', "format_valid": 1}'))).when(k == 1, F.concat(F.lit('cut {"format_valid": "False", "difficulty": "'), n, F.lit('", "diver'))).when(k == 2, '{"difficulty": 77}').otherwise('{"difficulty": 4}')
    obj = jsonx.sliced_object(t)
    return _t(spark, sf, "events").select("event_id", jsonx.judged_int(t, obj, "difficulty").alias("difficulty"), jsonx.judged_bool(t, obj, "format_valid").alias("format_valid"))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    pos = F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    w = F.round(F.col("l_discount") * 100)
    return li.select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("dimension"), F.col("l_linenumber").alias("teacher"), (F.col("l_suppkey") % 7 != 0).alias("applicable"),
        F.when(F.col("l_suppkey") % 7 != 0, F.floor("l_quantity").cast("int") % 5).alias("score"), w.alias("confidence"), F.concat(F.lit("r"), pos.cast("string")).alias("reason"), pos.alias("_vpos"),
    )


_VOTES = "SELECT l_orderkey AS case_id, 'd' || l_partkey % 3 AS dimension, l_suppkey % 7 <> 0 AS applicable, CASE WHEN l_suppkey % 7 <> 0 THEN floor(l_quantity)::INT % 5 END AS score, coalesce(nullif(round(l_discount * 100), 0), 0.5) AS w, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS p FROM lineitem"
_MAJOR = (
    f"v AS ({_VOTES}), s AS (SELECT case_id, dimension, score, sum(w) AS sw, min(p) AS mp, avg(w) AS confidence FROM v WHERE score IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY case_id, dimension ORDER BY sw DESC, mp, score) = 1),"
    " m AS (SELECT e.case_id, e.dimension, b.score IS NOT NULL AS applicable, b.score, b.confidence, CASE WHEN b.score IS NOT NULL THEN 'r' || b.mp ELSE 'r' || e.np END AS reason FROM (SELECT case_id, dimension, min(p) FILTER (WHERE NOT applicable) AS np FROM v GROUP BY ALL) e LEFT JOIN b USING (case_id, dimension))"
)


@_query(f"WITH {_MAJOR} SELECT case_id, dimension, applicable, score, reason FROM m")
def vote_majority(spark: SparkSession, sf: str) -> DataFrame:
    return votes.majority(_votes(spark, sf)).drop("confidence")


@_query(f"WITH v AS ({_VOTES}), c AS (SELECT case_id, dimension, max(score) - min(score) AS spread, count(*) AS n_votes FROM v WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND max(score) - min(score) >= 2) SELECT case_id, dimension, spread, n_votes, row_number() OVER (PARTITION BY case_id ORDER BY spread DESC, dimension)::INT AS slot FROM c QUALIFY slot <= 2")
def vote_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return votes.conflicts(_votes(spark, sf), 2, 2)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    pool = spark.createDataFrame([("Quality", "d0"), ("Total", "d1"), ("Safety", "d2")], "l1 string, l3 string")
    return joins.with_l1(votes.majority(_votes(spark, sf)), pool)


@_query(
    f"WITH {_MAJOR} SELECT case_id, count(score) FILTER (WHERE dimension <> 'd1') AS n_scored, count(*) FILTER (WHERE score IS NULL) AS n_na, coalesce(bool_or(dimension = 'd2' AND score = 0), false) AS vetoed, CASE WHEN coalesce(bool_or(dimension = 'd2' AND score = 0), false) THEN 0.0 ELSE avg(score * 25.0) FILTER (WHERE dimension <> 'd1') END AS overall FROM m GROUP BY case_id"
)
def overall_score(spark: SparkSession, sf: str) -> DataFrame:
    return votes.overall(_labels(spark, sf), ["Total"], "d2").select("case_id", "n_scored", "n_na", "vetoed", "overall")


@_query(f"WITH {_MAJOR} SELECT case_id, CASE dimension WHEN 'd0' THEN 'Quality' WHEN 'd1' THEN 'Total' ELSE 'Safety' END AS l1, avg(score * 25.0) AS score FROM m WHERE score IS NOT NULL GROUP BY ALL")
def group_scores(spark: SparkSession, sf: str) -> DataFrame:
    return votes.group_scores(_labels(spark, sf))


@_query(
    f"WITH {_MAJOR}, g AS (SELECT case_id, dimension, score, applicable, confidence, case_id % 5 = 0 AND score IS NOT NULL AS debated FROM m), f AS (SELECT case_id, dimension, score AS ms, debated, CASE WHEN debated THEN (score + case_id % 2) % 5 ELSE score END AS score, CASE WHEN debated THEN 0.9 ELSE confidence END AS c, applicable FROM g)"
    " SELECT case_id, dimension, CASE WHEN score IS NOT NULL AND c >= 3 THEN 'sft' ELSE 'uncertain' END AS bin, score::INT AS score FROM f UNION ALL SELECT case_id, dimension, 'dpo', score::INT FROM f WHERE debated AND ms <> score"
)
def export_bins(spark: SparkSession, sf: str) -> DataFrame:
    m = votes.majority(_votes(spark, sf))
    debates = m.where("case_id % 5 = 0 and score is not null").select("case_id", "dimension", ((F.col("score") + F.col("case_id") % 2) % 5).cast("int").alias("score"), F.lit(0.9).alias("confidence"), F.lit("debate").alias("reason"), F.lit("three steps").alias("steps"))
    return votes.training_bins(votes.final_labels(m, debates), 3.0).select("case_id", "dimension", "bin", "score")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with line items as rollouts: turns is the quantity, correct those of even part."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    g = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(items.alias("i"))
    return g.select("id", F.transform("i", lambda x: F.struct(F.concat_ws("-", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")).alias("solution_id"), (x["l_partkey"] % 2 == 0).alias("is_correct"), F.floor(x["l_quantity"]).cast("int").alias("turns"))).alias("trajectories"))


_RUNS = "SELECT l_orderkey AS id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS solution_id, l_partkey % 2 = 0 AS is_correct, floor(l_quantity)::INT AS turns, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem"


def _picked(strategy: str, sign: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = select.judge_filter(_runs(spark, sf), strategy, min_turns=5)
        return out.select("id", F.element_at("trajectories", 1)["solution_id"].alias("solution_id"), F.element_at("trajectories", 1)["turns"].alias("turns"))

    name = f"judge_filter_{strategy.removeprefix('correct_')}"
    run.__name__ = name
    return _query(f"WITH r AS ({_RUNS}) SELECT id, solution_id, turns FROM r WHERE is_correct AND turns >= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY turns {sign}, k) = 1")(run)


_picked("correct_shortest", "ASC")
_picked("correct_longest", "DESC")


@_query(f"WITH r AS ({_RUNS}) SELECT id, avg(is_correct::INT) AS accuracy, avg(turns) AS avg_turns FROM r GROUP BY id")
def trajectory_stats(spark: SparkSession, sf: str) -> DataFrame:
    accuracy, turns = aggregate.rollout_stats()
    return _runs(spark, sf).select("id", accuracy.alias("accuracy"), turns.alias("avg_turns"))


@_query(f"WITH r AS ({_RUNS}) SELECT id, floor(median(turns))::INT AS median_steps, count(*) FILTER (WHERE is_correct) AS n_correct, coalesce(min_by(solution_id, k) FILTER (WHERE is_correct), min_by(solution_id, k)) AS answer FROM r GROUP BY id")
def verify_summary(spark: SparkSession, sf: str) -> DataFrame:
    flat = _runs(spark, sf).select("id", F.posexplode("trajectories").alias(POS, "t")).select("id", POS, F.col("t.turns").alias("steps"), "t.is_correct", F.col("t.solution_id").alias("answer"))
    return aggregate.verify_summary(flat, "id")


@_query(f"WITH r AS ({_RUNS}) SELECT id, CASE WHEN id % 3 = 0 THEN max(solution_id) ELSE min_by(solution_id, k) END AS solution_id FROM r GROUP BY id")
def best_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("id") % 3 == 0, F.array_max(F.transform("trajectories", lambda t: t["solution_id"]))).when(F.col("id") % 3 == 1, "not there")
    rows = _runs(spark, sf).withColumn("best_solution_id", named)
    return rows.select("id", select.best_trajectory(rows)["solution_id"].alias("solution_id"))


@_query(f"WITH r AS ({_RUNS}) SELECT id::VARCHAR AS task_id, array_to_string(list(solution_id ORDER BY k) FILTER (WHERE k <= 3), ',') AS solutions FROM r GROUP BY id")
def first_per_task(spark: SparkSession, sf: str) -> DataFrame:
    flat = _runs(spark, sf).select("id", F.posexplode("trajectories").alias(POS, "t")).select("id", POS, "t.solution_id")
    return aggregate.first_per_task(flat, "id", 3).select("task_id", F.array_join(F.transform("solutions", lambda s: s["solution_id"]), ",").alias("solutions"))


@_query("SELECT conv_id, count(*) FILTER (WHERE role = 'assistant')::INT AS turns, sum(length(text))::BIGINT AS size, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id")
def conversation_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return _talks(spark, sf).select(F.col("id").alias("conv_id"), text.assistant_turns(m).alias("turns"), text.total_length(m).alias("size"), text.trajectory_answer(m).alias("answer"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias(POS), "doc_id", joins.resume_key(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), F.col("source"), F.col("doc_id").cast("string")).alias("_key"))


_KEYED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id:' || doc_id ELSE 'sha1:' || sha1(source || chr(31) || doc_id) END AS _key FROM documents"


@_query(f"SELECT k.doc_id, k._key AS key, l.doc_id IS NOT NULL AS done FROM ({_KEYED}) k LEFT JOIN labels l USING (doc_id)")
def resume_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keyed(spark, sf)
    done, left = joins.split_done(rows, rows.join(_t(spark, sf, "labels"), "doc_id", "left_semi"))
    return done.withColumn("done", F.lit(True)).union(left.withColumn("done", F.lit(False))).select("doc_id", F.col("_key").alias("key"), "done")


@_query(f"SELECT k._key AS key, coalesce(l.quality, 5) AS value FROM ({_KEYED}) k LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR k.doc_id % 4 = 1")
def resume_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keyed(spark, sf)
    cached = rows.join(_t(spark, sf, "labels"), "doc_id").select("_key", POS, F.col("quality").alias("value"))
    fresh = rows.where("doc_id % 4 = 1").select("_key", POS, F.lit(5).alias("value"))
    return joins.merge_done(rows, cached, fresh).select(F.col("_key").alias("key"), "value")


@_query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('hour', ts), event_id) = 1 OR event_type = ''")
def topic_dedup_rounds(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").withColumn("round", F.date_trunc("hour", "ts"))
    return select.topics_once(e, "user_id", "event_type", ["round", "event_id"]).select("event_id", "user_id", "event_type")


@_query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, CASE WHEN length(source || lang) > 0 THEN round(greatest(1, length(text) // 4)::DOUBLE / 4, 4) END AS ratio, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(13))) > 0))::INT AS steps FROM documents")
def longshort_ratio(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    n = text.token_estimate(F.col("text"))
    # quarters need no rounding, so that half-even and half-up agree
    return d.select("doc_id", n.alias("tokens"), text.ratio(n, F.lit(4)).alias("ratio"), text.step_count(F.regexp_replace("text", "\n", "\n\n")).alias("steps"))


@_query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS entities FROM (SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand, 'x'] ELSE [p_brand, p_type, 'x'] END AS list_distinct_ordered FROM part)")
def entity_distinct(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    a = F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"))
    b = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("x"), F.lit(None).cast("string"))
    return p.select("p_partkey", F.array_join(select.ordered_entities(a, b), ",").alias("entities"))


@_query("SELECT 'browse::' || url AS key, CASE WHEN max(page_id) % 2 = 0 THEN 'hit' ELSE 'computed' END AS value FROM pages GROUP BY url")
def anti_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = _t(spark, sf, "pages").groupBy(F.concat(F.lit("browse::"), "url").alias("key")).agg(F.max("page_id").alias("p"))
    cache = r.where("p % 2 = 0").select("key", F.lit("hit").alias("value"))
    out, _ = joins.through_cache(r, cache, lambda misses: misses.select("key", F.lit("computed").alias("value")))
    return out


@_query(
    "WITH p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), d AS (SELECT r AS request, j, md5((7 + r)::VARCHAR || '-' || j) AS h FROM range(50) t(r), range(3) u(j)),"
    " k AS (SELECT request, h, text, row_number() OVER (PARTITION BY request ORDER BY h, text) AS n FROM d JOIN p ON i = j * p.n // 3 + ('0x' || substr(h, 1, 12))::BIGINT % ((j + 1) * p.n // 3 - j * p.n // 3))"
    " SELECT request, array_to_string(list('Example ' || n || chr(10) || text ORDER BY n), chr(10) || chr(10)) AS examples FROM k GROUP BY request"
)
def in_context_examples(spark: SparkSession, sf: str) -> DataFrame:
    pool = _t(spark, sf, "benchmark").select(F.col("item_id").alias(POS), "text")
    asked = spark.range(50).select(F.col("id").alias(POS))
    return select.in_context_examples(asked, pool, 3, 7).select(F.col(POS).alias("request"), text.numbered_examples(F.col("examples")).alias("examples"))


@_query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform(range(least(8, o_orderkey % 40)), lambda i: CASE WHEN least(8, o_orderkey % 40) = 1 THEN 0 ELSE round_even(i * (o_orderkey % 40 - 1)::DOUBLE / (least(8, o_orderkey % 40) - 1), 0)::INT END))), ',') AS frames FROM orders")
def frame_indices(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("o_orderkey") % 40).cast("int")
    return _t(spark, sf, "orders").select("o_orderkey", F.array_join(media.frame_indices(n), ",").alias("frames"))


@_query("SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE greatest(0, least(4, round_even(value / 25, 0)::INT)) END AS score FROM events")
def clamp_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", jsonx.clamp(F.col("value") / 25).alias("score"))


@_query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'b' || doc_id WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN source WHEN 3 THEN doc_id::VARCHAR ELSE 'last line' END AS answer FROM documents")
def final_answers(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    t = F.when(k == 0, F.concat(F.lit("So \\boxed{a} and \\boxed{b"), n, F.lit("} 5"))).when(k == 1, F.concat(F.lit("1 and 2\n#### "), n, F.lit("\n"))).when(k == 2, F.concat(F.lit("7: the answer is "), "source", F.lit(". Yes"))).when(k == 3, F.concat(F.lit("first 3 then "), n, F.lit(" apples"))).otherwise("some words\nlast line\n\n")
    return _t(spark, sf, "documents").select("doc_id", text.final_answer(t).alias("answer"))


@_query("SELECT n_nationkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN 'scene_en' END, ''), 'general_en') AS prompt FROM nation")
def scene_prompt(spark: SparkSession, sf: str) -> DataFrame:
    table = {f"s{k}_en": "scene_en" for k in range(0, 25, 3)} | {"general_en": "general_en", "general_zh": "general_zh"}
    return _t(spark, sf, "nation").select("n_nationkey", joins.by_scene(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")), F.lit("en"), table).alias("prompt"))


@_query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS stem, CASE WHEN url LIKE 'http%' THEN url ELSE '/base/' || url END AS path, CASE WHEN regexp_matches(url, '[.]html$') THEN 'image/png' ELSE 'image/png' END AS mime FROM pages")
def url_functions(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _t(spark, sf, "pages").select("page_id", text.file_stem(u).alias("stem"), jsonl.absolute_path(u, "/base").alias("path"), text.mime_type(u).alias("mime"))


@_query("SELECT doc_id AS id, 'image' AS source, text AS prompt, 'https://m/' || doc_id || '/0' AS url FROM documents WHERE doc_id % 3 <> 0 AND length(text) >= 200")
def media_sft(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    u = lambda k: F.concat(F.lit("https://m/"), F.col("doc_id").cast("string"), F.lit(f"/{k}"))
    rows = d.select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), F.col("text").alias("prompt"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(u(0), u(1))).alias("image_urls"))
    out = builders.media_sft(rows, min_prompt=200)
    return out.select(F.col(POS).alias("id"), F.get_json_object("metadata", "$.source").alias("source"), F.element_at("messages", 1)["content"].alias("prompt"), F.get_json_object(F.element_at("messages", 2)["content"], "$[0].url").alias("url"))


@_query("SELECT doc_id, CASE WHEN length(text) > 60 THEN trim(regexp_replace(substr(text, 1, 60), ' [^ ]*$', ''), ' ' || chr(10) || chr(9) || chr(13)) ELSE text END AS cut FROM documents")
def cut_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.cut_at_word(F.col("text"), 60).alias("cut"))


@_query("SELECT s_suppkey, s_suppkey || '#gen' || s_suppkey % 3 AS id, s_suppkey::VARCHAR AS seed FROM supplier WHERE s_suppkey % 2 = 0")
def seed_resume(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("id"))
    earlier = s.where("s_suppkey % 2 = 1").select(F.concat("id", F.lit("#gen0-evolved")).alias("id"))
    left = joins.not_yet(s, earlier).select("s_suppkey", F.concat("id", F.lit("#gen"), (F.col("s_suppkey") % 3).cast("string")).alias("id"))
    return left.withColumn("seed", joins.seed_of(F.col("id")))




from . import catalogue_functions, catalogue_models  # noqa: E402, F401
