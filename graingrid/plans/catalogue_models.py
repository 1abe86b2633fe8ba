"""Queries that call models, here scripted ones whose answers follow from the request, each with the SQL that gives the same rows.

What is tested is all around the call: what is asked, how answers are parsed, which rows are dropped and what columns
come of it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rows import POS
from ..operators import agents, builders, generate, judges, video, votes
from ..operators.model import FakeBackend, FakeMediaBackend, Request, Transient
from . import jobs, stages
from .registry import query, table


def _answers(f: Callable[[Request], str]):
    """A factory of backends that answer by ``f``."""
    return lambda: FakeBackend(f)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """id, instruction (the source), and whatever else is wanted, of documents with a source."""
    d = table(spark, sf, "documents").where("source <> ''")
    return d.select(F.col("doc_id").alias(POS), F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("instruction"), F.col("source"), F.col("lang"), F.col("n_chars"))


_ASK = "source || ' ' || doc_id"
_OWN = "d AS (SELECT *, " + _ASK + " AS instruction FROM documents WHERE source <> '')"


def _number(s: str) -> int:
    """The last number of a text."""
    found = re.findall(r"\d+", s)
    return int(found[-1]) if found else 0


def _odd_fails(r: Request) -> str:
    if _number(r.user) % 5 == 0:
        raise ValueError("no answer")
    return f"A: {r.user}"


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, instruction, 'A: ' || instruction AS response FROM d WHERE doc_id % 5 <> 0")
def model_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose call fails are dropped."""
    return generate.generate(_docs(spark, sf).select(POS, "id", "instruction"), _answers(_odd_fails), workers=4).select("id", "instruction", "response")


class _Flaky(FakeBackend):
    """Fails for the moment on a request's first tries, as many as its number modulo 3."""

    def generate(self, request: Request):
        n = self.tries[request.id] = self.tries.get(request.id, 0) + 1
        if n <= _number(request.user) % 3:
            raise Transient("busy")
        from ..operators.model import Answer

        return Answer(f"try {n}")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 < 2 THEN 'try ' || (doc_id % 3 + 1) END AS response, doc_id % 3 = 2 AS failed FROM d")
def model_retries(spark: SparkSession, sf: str) -> DataFrame:
    """One retry: what fails twice stays as an error."""
    from ..operators.model import call_model

    rows = _docs(spark, sf).select(POS, "id", "instruction")
    got = call_model(rows, _Flaky, F.array(builders.message("user", F.col("instruction"))), F.col("id"), retries=1, base=0.0, workers=2)
    return got.select("id", "response", F.col("error").isNotNull().alias("failed"))


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, 'A: ' || instruction AS answer, instruction AS asked FROM d WHERE doc_id % 5 <> 0 AND length('A: ' || instruction) >= 12")
def job_instruct_distill(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run("instruct_distill", _docs(spark, sf).select(POS, "id", "instruction"), _answers(_odd_fails), workers=4, min_length=12)
    return out.select(F.get_json_object("metadata", "$.request_id").alias("id"), F.element_at("messages", -1)["content"].alias("answer"), F.element_at("messages", 1)["content"].alias("asked"))


@query(
    "WITH p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), d AS (SELECT r AS request, j, md5((5 + r)::VARCHAR || '-' || j) AS h FROM range(40) t(r), range(3) u(j)),"
    " k AS (SELECT request, text, row_number() OVER (PARTITION BY request ORDER BY h, text) AS n FROM d JOIN p ON i = j * p.n // 3 + ('0x' || substr(h, 1, 12))::BIGINT % ((j + 1) * p.n // 3 - j * p.n // 3))"
    " SELECT request, 'new ' || length(string_agg('Example ' || n || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS text FROM k GROUP BY request"
)
def model_expand(spark: SparkSession, sf: str) -> DataFrame:
    pool = table(spark, sf, "benchmark").select(F.col("item_id").alias(POS), "text")
    out = generate.expand(pool, _answers(lambda r: f"x <answer> new {len(r.user)} </answer>"), 40, 3, 5, prompt="{examples}")
    return out.withColumnRenamed(POS, "request")


def _items(r: Request) -> str:
    n = _number(r.user.splitlines()[-1])
    turn = int(r.id.split("_r")[1].split("_")[0])
    if n % 7 == 0 and turn == 1:
        return "nothing"
    return json.dumps([{"topic": f"t{turn}", "prompt": f"p{n}-{turn}"}, {"topic": "t0", "prompt": f"again {n}"}, {"topic": "", "prompt": f"free {turn}"}])


@query(
    f"WITH {_OWN}, s AS (SELECT doc_id, instruction, r FROM d, range(3) t(r) WHERE doc_id % 7 <> 0 OR r <> 1), p AS (SELECT doc_id, r, 't' || r AS topic, 'p' || doc_id || '-' || r AS instruction FROM s UNION ALL SELECT doc_id, r, '', 'free ' || r FROM s)"
    " SELECT doc_id::VARCHAR AS source_seed_id, r::INT AS round, topic, instruction FROM p"
)
def model_expand_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A topic counts once a seed, an empty one always; a round without items is left out."""
    rows = _docs(spark, sf).select(POS, "id", "instruction")
    return generate.expand_seeds(rows, _answers(_items), rounds=3, retries=1).select("source_seed_id", "round", "topic", "instruction")


@query(f"WITH {_OWN} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(instruction) ELSE 'plain ' || doc_id END AS text FROM d")
def model_refine(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(POS, F.col("instruction").alias("text"))
    answer = lambda r: f"<answer> {r.user.upper()}</answer>" if _number(r.user) % 2 == 0 else f" plain {_number(r.user)}\n"
    return generate.refine(rows, _answers(answer), prompt="{text}").withColumnRenamed(POS, "doc_id")


@query(f"WITH {_OWN} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'said' ELSE lang END AS instruction, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE n_chars::VARCHAR END AS response FROM d WHERE lang <> ''")
def model_extract_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The model's pair where it gives both parts, else the text's own."""
    own = F.concat(F.lit("<instruction>"), "lang", F.lit("</instruction><response>"), F.col("n_chars").cast("string"), F.lit("</response> "), F.col(POS).cast("string"))
    rows = _docs(spark, sf).where("lang <> ''").select(POS, own.alias("text"))
    answer = lambda r: f"<instruction>said</instruction><response>{_number(r.user)}</response>" if _number(r.user) % 3 == 0 else "<instruction>half</instruction>"
    return generate.extract_pairs(rows, _answers(answer), prompt="{text}").withColumnRenamed(POS, "doc_id")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, instruction, CASE WHEN doc_id % 2 = 0 THEN 'think' END AS thought, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS solution FROM d")
def model_reason(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("problem"))
    answer = lambda r: f"<|begin_of_thought|> think<|end_of_thought|><|begin_of_solution|>{_number(r.user)}<|end_of_solution|>" if _number(r.user) % 2 == 0 else "no tags"
    return generate.reason(rows, _answers(answer), prompt="{problem}").select("id", "instruction", "thought", "solution")


def _resized(spark: SparkSession, sf: str, longer: bool, **options) -> DataFrame:
    d = _docs(spark, sf)
    solution = F.concat(F.lit("<|begin_of_solution|>s"), F.col("id"), F.lit("<|end_of_solution|>"))
    rows = d.select(POS, "id", F.col("instruction").alias("problem"), F.concat(F.repeat(F.lit("word "), (F.col(POS) % 9 + 1).cast("int")), solution).alias("answer"))
    return generate.resize(rows, _answers(_rewrite), longer, prompt="{answer} {problem}", **options)


def _rewrite(r: Request) -> str:
    n = _number(r.user)
    if n % 4 == 0:
        return " "
    return f"short s{n} text" if n % 4 < 3 else f"lost\n\nall of {'it ' * (n % 10)}"


_NEW = "CASE WHEN doc_id % 4 < 3 THEN 'short s' || doc_id || ' text' ELSE trim('lost' || chr(10) || chr(10) || 'all of ' || repeat('it ', (doc_id % 10)::INT)) END"
_OLD = "repeat('word ', (doc_id % 9 + 1)::INT) || '<|begin_of_solution|>s' || doc_id || '<|end_of_solution|>'"


@query(f"WITH {_OWN}, r AS (SELECT doc_id, {_NEW} AS new, {_OLD} AS old FROM d WHERE doc_id % 4 IN (1, 2)) SELECT doc_id::VARCHAR AS id, new AS response, greatest(1, length(old) // 4)::INT AS original_tokens, greatest(1, length(new) // 4)::INT AS simplified_tokens FROM r")
def model_shorten(spark: SparkSession, sf: str) -> DataFrame:
    """Verified: a rewrite that lacks the solution is dropped, as is a blank one."""
    return _resized(spark, sf, False, verify=True).select("id", "response", "original_tokens", "simplified_tokens")


@query(f"WITH {_OWN}, r AS (SELECT doc_id, {_NEW} AS new FROM d WHERE doc_id % 4 <> 0), c AS (SELECT doc_id, CASE WHEN length(new) > 14 THEN trim(regexp_replace(substr(new, 1, 14), ' [^ ]*$', ''), ' ' || chr(10)) ELSE new END AS new FROM r) SELECT doc_id::VARCHAR AS id, new AS response, greatest(1, length(new) // 4)::INT AS extended_tokens, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS step_count FROM c")
def model_lengthen(spark: SparkSession, sf: str) -> DataFrame:
    return _resized(spark, sf, True, max_chars=14).select("id", "response", "extended_tokens", "step_count")


def _mm_answer(r: Request) -> str:
    parts = r.messages[-1]["content"]
    if isinstance(parts, str):
        return f"text {_number(parts)}"
    return f"{sum(p['type'] == 'image_url' for p in parts)} images {_number(r.user)}"


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'text ' || doc_id ELSE (doc_id % 3) || ' images ' || doc_id END AS response FROM d")
def model_multimodal(spark: SparkSession, sf: str) -> DataFrame:
    """A row's images come first in its message; a row without any sends plain text."""
    images = F.transform(F.filter(F.sequence(F.lit(0), F.lit(1)), lambda k: k < F.col(POS) % 3), lambda k: F.concat(F.lit("https://i/"), k.cast("string")))
    return generate.generate(_docs(spark, sf).select(POS, "id", "instruction", images.alias("images")), _answers(_mm_answer)).select("id", "response")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, doc_id || '-0,' || doc_id || '-1' || CASE WHEN doc_id % 2 = 0 THEN ',' || doc_id || '-2' ELSE '' END AS candidates FROM d")
def model_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in the order of requests; failed ones are left out."""

    def answer(r: Request) -> str:
        if r.index == 2 and _number(r.user) % 2:
            raise ValueError("failed")
        return f"{_number(r.user)}-{r.index}"

    return judges.candidates(_docs(spark, sf).select(POS, "id", "instruction"), _answers(answer), 3).select("id", F.array_join("candidates", ",").alias("candidates"))


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN n_chars % 4 <> 0 THEN (n_chars % 10)::INT END AS helpfulness, n_chars % 2 = 1 AS correctness FROM d WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id::VARCHAR, NULL, NULL FROM d WHERE doc_id % 6 = 0")
def model_judge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A blank answer isn't judged, and has nulls; a tag without a number is no score."""
    rows = _docs(spark, sf).select(POS, "id", "instruction", F.when(F.col(POS) % 6 == 0, " ").otherwise(F.col("n_chars").cast("string")).alias("output"))

    def answer(r: Request) -> str:
        n = _number(r.user.rsplit("Answer:", 1)[-1])
        if "true or false" in r.user:
            return "<score>true</score>" if n % 2 else "It is incorrect."
        return f"<score> {n % 10} </score>" if n % 4 else "no score"

    return judges.judge_metrics(rows, _answers(answer), ["helpfulness", "correctness"]).select("id", "helpfulness", "correctness")


@query(f"WITH {_OWN}, m AS (SELECT (n_chars % 10) + k AS s, k, doc_id FROM d, range(3) t(k)) SELECT doc_id::VARCHAR AS id, array_to_string(list(s::VARCHAR ORDER BY k), ',') AS scores FROM m GROUP BY doc_id")
def model_judge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("a"), (F.col("n_chars") % 10 + k).cast("string")))
    rows = _docs(spark, sf).select(POS, "id", "instruction", texts.alias("candidates"))
    out = judges.judge_candidates(rows, _answers(lambda r: f"<score>{_number(r.user.rsplit('Answer:', 1)[-1])}</score>"), ["helpfulness", "depth"])
    return out.select("id", F.array_join(F.transform("candidate_scores", lambda s: s.cast("int").cast("string")), ",").alias("scores"))


def _verdict(r: Request) -> str:
    n = _number(r.user)
    body = {"intent_fidelity": n % 12, "usability": str(n % 10), "language_consistency": "True" if n % 2 else 0}
    whole = json.dumps(body)
    return (f"```json\n{whole}\n```", f"Here: {whole} done", whole[:-1] + ', "no_confl', "not json")[n % 4]


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 < 3 AND doc_id % 12 <= 9 THEN (doc_id % 12)::INT END AS intent_fidelity, CASE WHEN doc_id % 4 < 3 THEN (doc_id % 10)::INT END AS usability, CASE WHEN doc_id % 4 < 3 THEN doc_id % 2 = 1 END AS language_consistency, NULL::INT AS detail_enrichment, instruction AS response FROM d")
def model_judge_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(POS, "id", F.lit("x").alias("instruction"), F.col("instruction").alias("response"))
    return judges.judge_rewrites(rows, _answers(_verdict)).select("id", "intent_fidelity", "usability", "language_consistency", "detail_enrichment", "response")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE doc_id % 3 WHEN 0 THEN 'Math' WHEN 1 THEN 'Code' ELSE 'Others' END AS category FROM d")
def model_classify(spark: SparkSession, sf: str) -> DataFrame:
    answer = lambda r: ("<answer>Math</answer>", "it is code, I think", "<answer>Poetry</answer>")[_number(r.user) % 3]
    return judges.classify(_docs(spark, sf).select(POS, "id", "instruction"), _answers(answer), ["Math", "Code"]).select("id", "category")


def _writer(r: Request) -> str:
    n = _number(r.user)
    if "Plan a rewrite" in r.user:
        return ('{"scene": "UI_Interface", "language": "zh"}', '{"scene": "coding", "language": "fr"}', "no plan")[n % 3]
    if "after the plan" in r.user:
        if n % 11 == 0:
            raise ValueError("failed")
        return (f'{{"rewritten_prompt": "better {n}"}}', f'{{"rewritten_prompt": "cut {n}', f"plain {n}")[n % 3]
    return (f'{{"changed": true, "revised_prompt": "revised {n}"}}', '{"changed": false}')[n % 2]


@query(
    f"WITH {_OWN}, r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'better ' WHEN 1 THEN 'cut ' ELSE 'plain ' END || doc_id AS draft FROM d WHERE doc_id % 11 <> 0) SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'revised ' || doc_id ELSE draft END AS response,"
    " CASE WHEN doc_id % 3 = 0 THEN 'ui_interface' ELSE 'general' END AS scene, CASE WHEN doc_id % 3 = 0 THEN 'zh' ELSE 'en' END AS language, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid_scene' ELSE 'parse_failed' END AS plan, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok_salvaged' ELSE 'plain_text' END AS rewrite FROM r"
)
def model_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    out = generate.rewrite(_docs(spark, sf).select(POS, "id", "instruction"), _answers(_writer), workers=2)
    return out.select("id", "response", "scene", "language", "agent_trace.plan", "agent_trace.rewrite")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, 'https://media.example/' || doc_id || '/0.png' AS url, instruction AS prompt FROM d")
def model_images(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run("t2i_generation", _docs(spark, sf).select(POS, "id", F.col("instruction").alias("prompt")), FakeMediaBackend)
    return out.select("id", F.element_at("image_urls", 1).alias("url"), "prompt")


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, instruction AS original_prompt, CASE WHEN doc_id % 3 = 0 THEN instruction ELSE 'fine ' || doc_id END AS prompt FROM d")
def model_prompt_optimize(spark: SparkSession, sf: str) -> DataFrame:
    """Where the call fails the old prompt stays."""

    def answer(r: Request) -> str:
        n = _number(r.user)
        if n % 3 == 0:
            raise ValueError("failed")
        return f" fine {n} "

    out = jobs.run("prompt_optimize", _docs(spark, sf).select(POS, "id", F.col("instruction").alias("prompt")), _answers(answer))
    return out.select("id", "original_prompt", "prompt")


def _video_writer(r: Request) -> str:
    n = _number(r.user)
    if "caption by this schema" in r.user:
        return f"<answer>caption {n}</answer>" if n % 5 else " "
    frame = not isinstance(r.messages[-1]["content"], str)
    return f'<answer>{{"frame": {str(frame).lower()}, "aspect_ratio": "{n % 9 + 1}: 9"}}</answer>'


@query(
    f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, instruction AS raw_prompt, 'caption ' || doc_id AS optimized_prompt, doc_id % 4 = 0 AS framed, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '1:1' WHEN doc_id % 3 = 1 THEN (doc_id % 9 + 1) || ':9' END AS ratio FROM d WHERE doc_id % 5 <> 0"
)
def model_video_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """An automatic resolution takes its ratio from the draft, unless the row has one or a first frame; a row without a caption is dropped."""
    frame = F.when(F.col(POS) % 4 == 0, "https://f/1.png")
    ratio = F.when((F.col(POS) % 3 == 0) & (F.col(POS) % 4 != 0), "1:1")
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("prompt"), frame.alias("first_frame_image"), F.when(F.col(POS) % 3 < 2, "Auto").otherwise("720p").alias("resolution"), ratio.alias("ratio"))
    out = jobs.run("t2v_prompt_optimize", rows, _answers(_video_writer))
    return out.select("id", "raw_prompt", "optimized_prompt", F.get_json_object("draft", "$.frame").cast("boolean").alias("framed"), "ratio")


# Evaluation of images


def _teacher(shift: int):
    def answer(r: Request) -> str:
        n = _number(re.search(r"Prompt: (.*)", r.user)[1])
        if n % 13 == 0:
            return "no object"
        dims = re.findall(r"^- (\w+):", r.user, re.M)
        out = [{"dimension": d, "applicable": (n + k) % 6 != 0, "score": None if (n + k) % 6 == 0 else (n * (k + 1) + shift * (n % 4)) % 5, "confidence": 0.5 + shift / 4, "reason": f"t{shift}"} for k, d in enumerate(dims)]
        return json.dumps({"dimension_judgments": out + [{"dimension": "other", "score": 4}]})

    return answer


def _arbiter(r: Request) -> str:
    n = _number(re.search(r"Prompt: (.*)", r.user)[1])
    if "Decide on" in r.user:
        return json.dumps({"score": n % 5, "confidence": 0.9, "reason": "arbiter"}) if n % 3 else "undecided"
    return json.dumps({"score": 1, "prosecution": "p", "defense": "d"})


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias(POS), F.col("item_id").cast("string").alias("prompt_id"), F.concat(F.lit("p "), F.col("item_id").cast("string")).alias("prompt"), F.lit("https://i/1.png").alias("image"))


def _pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Quality", "a", "fine"), ("Quality", "b", None), ("Out", "c", "x")], "l1 string, l3 string, criteria string")


_VOTED = (
    "p(dimension, l1, k) AS (VALUES ('a', 'Quality', 0), ('b', 'Quality', 1), ('c', 'Out', 0)), b AS (SELECT item_id AS n, item_id::VARCHAR AS case_id FROM benchmark WHERE item_id IS NOT NULL AND item_id % 13 <> 0),"
    " v AS (SELECT case_id, n, dimension, l1, t.t, (n + k) % 6 <> 0 AS applicable, CASE WHEN (n + k) % 6 <> 0 THEN (n * (k + 1) + t.t * (n % 4)) % 5 END AS score, 0.5 + t.t / 4 AS w FROM b, p, range({0}) t(t))"
)


@query(f"WITH {_VOTED.format(1)} SELECT case_id, dimension, applicable, score::INT AS score FROM v")
def image_single_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One teacher's scores; a case whose answers can't be read has no labels."""
    return jobs.run("t2i_single_model_eval", _seeds(spark, sf), _answers(_teacher(0)), pool=_pool(spark), result="labels", retries=1).select("case_id", "dimension", "applicable", "score")


_MULTI = (
    _VOTED.format(3)
    + ", s AS (SELECT case_id, dimension, score, sum(w) AS w, min(t) AS t FROM v WHERE score IS NOT NULL GROUP BY ALL), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY case_id, dimension ORDER BY w DESC, t) = 1),"
    " y AS (SELECT case_id, dimension, max(score) - min(score) AS spread FROM v WHERE score IS NOT NULL GROUP BY case_id, dimension HAVING count(*) >= 2 AND max(score) - min(score) >= 2), x AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY spread DESC, dimension) <= 2),"
    " l AS (SELECT e.case_id, e.dimension, e.l1, x.spread IS NOT NULL AS debated, coalesce(x.spread IS NOT NULL AND e.n % 3 <> 0, false) AS won, CASE WHEN x.spread IS NOT NULL AND e.n % 3 <> 0 THEN e.n % 5 ELSE m.score END AS score, m.score AS majority_score FROM (SELECT DISTINCT case_id, n, dimension, l1 FROM v) e LEFT JOIN m USING (case_id, dimension) LEFT JOIN x USING (case_id, dimension))"
)


def _multi(spark: SparkSession, sf: str, result: str) -> DataFrame:
    teachers = {f"t{k}": _answers(_teacher(k)) for k in range(3)}
    return jobs.run("t2i_multi_model_eval", _seeds(spark, sf), pool=_pool(spark), teachers=teachers, arbiter=_answers(_arbiter), max_dims=2, excludes=["Out"], veto="b", result=result, retries=1)


@query(
    f"WITH {_MULTI} SELECT case_id, dimension, debated, score::INT AS score, majority_score::INT AS majority_score, CASE WHEN won THEN 'debate_arbitration' WHEN debated THEN 'fallback_weighted_majority' ELSE 'weighted_majority_consensus' END AS source FROM l"
)
def image_debated_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _multi(spark, sf, "labels").select("case_id", "dimension", "debated", "score", "majority_score", "source")


@query(
    f"WITH {_MULTI}, o AS (SELECT case_id, count(score) FILTER (WHERE l1 <> 'Out') AS n_scored, count(*) FILTER (WHERE debated) AS n_debated, coalesce(bool_or(dimension = 'b' AND score = 0), false) AS vetoed, avg(score * 25.0) FILTER (WHERE l1 <> 'Out') AS mean FROM l GROUP BY case_id)"
    " SELECT b.item_id::VARCHAR AS case_id, n_scored, coalesce(n_debated, 0) AS n_debated, vetoed, CASE WHEN vetoed THEN 0.0 ELSE mean END AS overall FROM benchmark b LEFT JOIN o ON o.case_id = b.item_id::VARCHAR WHERE b.item_id IS NOT NULL"
)
def image_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of whole quarters over one or two dimensions, which need no rounding."""
    return _multi(spark, sf, "cases").select("case_id", "n_scored", "n_debated", "vetoed", "overall")


@query(f"WITH {_MULTI} SELECT case_id, dimension, 'dpo' AS bin FROM l WHERE won AND majority_score <> score UNION ALL SELECT case_id, dimension, CASE WHEN won AND score IS NOT NULL THEN 'sft' ELSE 'other' END FROM l")
def image_training_bins(spark: SparkSession, sf: str) -> DataFrame:
    out = _multi(spark, sf, "labels")
    bins = votes.training_bins(out, 0.85).withColumn("bin", F.when((F.col("bin") == "dpo") | (F.col("source") == "debate_arbitration"), F.col("bin")).otherwise("other"))
    return bins.select("case_id", "dimension", F.when(F.col("bin") == "uncertain", "other").otherwise(F.col("bin")).alias("bin"))


@query(f"WITH {_VOTED.format(1)}, l AS (SELECT case_id, avg(score * 25.0) AS overall, count(score) AS n_scored FROM v GROUP BY case_id) SELECT case_id, n_scored, CASE WHEN n_scored <> 3 THEN overall END AS overall FROM l")
def edit_single_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Edited images: three images a case, no veto and nothing left out. Thirds, which would be rounded, are not compared."""

    def answer(r: Request) -> str:
        assert sum(p["type"] == "image_url" for p in r.messages[-1]["content"]) == 3
        return _teacher(0)(Request([{"role": "user", "content": r.user.replace("Edit: ", "Prompt: ")}]))

    seeds = _seeds(spark, sf).select(POS, F.col("prompt_id").alias("case_id"), F.col("prompt").alias("instruction"), F.lit("https://b").alias("before_image"), F.lit("https://a").alias("after_image"), F.array(F.lit("https://r")).alias("reference_images"))
    out = jobs.run("ti2i_single_model_eval", seeds, _answers(answer), pool=_pool(spark), result="cases", retries=0).where("n_scored is not null")
    return out.select("case_id", "n_scored", F.when(F.col("n_scored") != 3, F.col("overall")).alias("overall"))


# Videos


def _viewer(r: Request) -> str:
    n = _number(r.user)
    if n % 5 == 0:
        return "nothing"
    return json.dumps({"dimension_judgments": [{"dimension": "visual_quality", "score": n % 7, "confidence": 0.5, "reason": "r"}, {"dimension": "prompt_consistency", "applicable": False, "score": 3}]})


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 <> 0 THEN least(4, doc_id % 7)::INT END AS visual_quality, NULL::INT AS prompt_consistency, CASE WHEN doc_id % 5 <> 0 THEN 0.5::DOUBLE END AS visual_quality_confidence, NULL::DOUBLE AS vbench_dynamic_degree, 'ValueError: no benchmark' AS vbench_skipped_reason FROM d")
def video_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A checker that fails blanks its own columns, and the next one runs."""

    def broken(df: DataFrame) -> DataFrame:
        raise ValueError("no benchmark")

    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("prompt"), F.array(F.lit("https://v/1.mp4")).alias("video_urls"))
    chain = [video.Checker("vbench", ["vbench_dynamic_degree"], broken), video.frame_checker(_answers(_viewer), retries=0)]
    out = jobs.run("t2v_eval", rows, checkers=chain)
    return out.select("id", "visual_quality", "prompt_consistency", "visual_quality_confidence", "vbench_dynamic_degree", "vbench_skipped_reason")


# Agents


def _planner(r: Request) -> str:
    n = _number(r.user)
    if "Invent a task" in r.user:
        return f'<task>task {n}</task><tools>[{{"name": "t", "outputs": 1}}]</tools><workflow>w</workflow>' + ("" if n % 4 else "<restriction>none</restriction>") if n % 5 else "<task>half</task>"
    if "Say this task vaguely" in r.user:
        return f"<fuzzy_task>fuzzy {n}</fuzzy_task><task_background>bg {n}</task_background>"
    return '<tools>[{"name": "t"}, {"name": "u"}]</tools>' if n % 7 else "<tools>broken</tools>"


@query(f"WITH {_OWN} SELECT doc_id, 'task ' || doc_id AS task, 'fuzzy ' || doc_id AS fuzzy_task, 'bg ' || doc_id AS task_background, 'u' AS last_tool FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def agent_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Incomplete tasks and unreadable tool lists are dropped along the chain."""
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("persona"))
    make = _answers(lambda r: _planner(Request([{"role": "user", "content": r.user.split("Tools:\n")[0]}])))
    out = agents.check_tools(agents.blur_tasks(agents.synthesize_tasks(rows, make), make), make)
    return out.select(F.col(POS).alias("doc_id"), "task", "fuzzy_task", "task_background", F.get_json_object("checked_tools", "$[1].name").alias("last_tool"))


def _actor(r: Request) -> str:
    if r.id.startswith("tool:"):
        return "<tool_response_start>found</tool_response_start><new_bg_introduced>NO</new_bg_introduced>"
    if r.id.startswith("user:"):
        return "go on"
    n = _number(r.messages[1]["content"])
    if n % 4 == 3:
        return "thinking"
    return "<answer>done</answer>" if r.index >= n % 4 else 'a <tool_call>{"name": "t", "arguments": {}}</tool_call>'


@query(f"WITH {_OWN}, s AS (SELECT doc_id, k FROM d, range(2) t(k)) SELECT doc_id || '_solution_' || (k + 1) || '.json' AS solution_id, CASE WHEN doc_id % 4 = 3 THEN 4 ELSE doc_id % 4 + 1 END::INT AS turns, CASE WHEN doc_id % 4 = 3 THEN 'The limit of steps is reached.' ELSE 'done' END AS answer FROM s")
def agent_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Tools answer, a simulated user goes on, and a limit of steps ends what doesn't end itself."""
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("task"), F.lit('[{"name": "t"}]').alias("tools"))
    out = agents.rollouts(rows, _answers(_actor), 2, 3)
    m = F.col("trajectory")
    return out.select("solution_id", text.assistant_turns(m).alias("turns"), text.trajectory_answer(m).alias("answer"))


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, 'rule ' || doc_id AS rubrics, CASE WHEN doc_id % 2 = 0 THEN doc_id || '_solution_2.json' END AS best, 2 AS runs FROM d WHERE doc_id % 3 <> 0")
def agent_rubrics(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks to discard are dropped; the best rollout is taken by its file's name."""

    def answer(r: Request) -> str:
        n = _number(r.user.split("### Solution")[0])
        best = f"<best>I take {n}_solution_2.json</best>" if n % 2 == 0 else ""
        return f"<rubrics>rule {n}</rubrics><alignment>{'Discard' if n % 3 == 0 else 'keep'}</alignment>{best}"

    run = lambda k: F.struct(F.concat(F.col("id"), F.lit(f"_solution_{k}.json")).alias("solution_id"), F.array(builders.message("user", F.lit("u")), builders.message("assistant", F.lit("a"))).alias("trajectory"), F.lit(k).alias("n"))
    rows = _docs(spark, sf).select(F.col(POS).alias("p"), "id", F.col("instruction").alias("task"), F.explode(F.array(run(1), run(2))).alias("r"))
    rows = rows.select((F.col("p") * 10 + F.col("r.n")).alias(POS), "id", "task", "r.solution_id", "r.trajectory")
    out = agents.judge_rubrics(rows, _answers(answer))
    return out.select("id", "rubrics", F.nullif("best_solution_id", F.lit("")).alias("best"), F.size("trajectories").alias("runs"))


def _solver(r: Request) -> str:
    if r.id.startswith("search:"):
        return '{"results": [{"title": "t", "url": "https://a", "snippet": "snip"}]}'
    if r.id.startswith("browse:"):
        return "page"
    if r.id.startswith("equivalence:"):
        return "no object"
    n = _number(r.messages[1]["content"])
    if n % 5 == 4:
        return "no idea"
    if r.index >= n % 5:
        return f"<answer>It is {n}</answer>"
    return '<tool_call>{"name": "web_search", "arguments": {"query": "q"}}</tool_call>' if r.index % 2 == 0 else '<tool_call>{"name": "web_browse", "arguments": {"url": "https://a"}}</tool_call>'


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS accuracy, CASE WHEN doc_id % 5 = 4 THEN 2 ELSE doc_id % 5 + 1 END::DOUBLE AS avg_turns, 2 AS runs FROM d")
def agent_search(spark: SparkSession, sf: str) -> DataFrame:
    """Searches and pages are simulated; where no judge can be read, an answer is right if one contains the other."""
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("question"), F.col("id").alias("answer"))
    out = agents.search_rollouts(rows, _answers(_solver), 2)
    return out.select("id", "accuracy", "avg_turns", F.size("trajectories").alias("runs"))


def _evolver(r: Request) -> str:
    role = r.id.split(":")[0]
    if role == "strategist":
        return "by rule"
    if role == "expander":
        target = re.search(r"bridge to (.*): a JSON", r.user)[1]
        n = _number(r.id)
        return json.dumps({"bridge": f"bridge {n}", "relation": "near", "bridge_fact": "f" * (60 if n % 4 else 10), "atomic_question": "which one?", "atomic_answer": target, "rewritten_question": f"harder {n}"})
    if role == "gate":
        return '{"passed": true}'
    if role == "judge":
        return '{"is_correct": true, "difficulty": "good", "action": "FINALIZE"}'
    if role == "equivalence":
        return '{"is_correct": true}'
    return "<answer>x</answer>"


@query(f"WITH {_OWN} SELECT doc_id || '-evolved' AS id, doc_id::VARCHAR AS seed_id, 'harder ' || doc_id AS question, 'good' AS difficulty, 1 AS evolve_level, 1 AS edges, 1.0::DOUBLE AS accuracy FROM d WHERE doc_id % 4 <> 0")
def agent_evolve(spark: SparkSession, sf: str) -> DataFrame:
    """A seed whose expansion fails a guard (too short a fact) isn't saved."""
    rows = _docs(spark, sf).select(POS, "id", F.col("instruction").alias("question"), F.concat(F.lit("answer "), F.col("id")).alias("answer"), F.array().cast("array<string>").alias("answer_aliases"))
    out = agents.evolve_tasks(rows, _answers(_evolver), fast_runs=1, final_runs=1)
    return out.select("id", "seed_id", "question", "difficulty", "evolve_level", F.size("graph_edges").alias("edges"), "accuracy")


# Staged pipelines


def _staged_answer(r: Request) -> str:
    if "<score>" in r.user:
        n = _number(r.user.rsplit("Answer:", 1)[-1])
        return "<score>true</score>" if "true or false" in r.user else f"<score>{n % 10}</score>"
    return f"{r.user} is {_number(r.user)}"


@query(f"WITH {_OWN} SELECT doc_id::VARCHAR AS id, upper(instruction) AS asked, upper(instruction) || ' is ' || doc_id AS answer FROM d WHERE doc_id % 10 >= 6")
def staged_instruct(spark: SparkSession, sf: str) -> DataFrame:
    """Answered, judged, filtered and built, by a list of stages with backends of their own."""
    rows = _docs(spark, sf).select(POS, "id", F.upper("instruction").alias("instruction"))
    todo = [{"stage": "generate"}, {"stage": "instruct_eval", "config": {"metrics": ["helpfulness", "correctness"]}}, {"stage": "quality_filter", "config": {"thresholds": {"helpfulness": 6, "correctness": True}}}, {"stage": "build_sft"}]
    out = stages.run("advanced_instruct_distill", rows, {"": _answers(_staged_answer), "generate": _answers(_staged_answer)}, todo)
    return out.select(F.get_json_object("metadata", "$.request_id").alias("id"), F.element_at("messages", 1)["content"].alias("asked"), F.element_at("messages", -1)["content"].alias("answer"))


def _rival(r: Request) -> str:
    if "<score>" in r.user:
        return f"<score>{_number(r.user.rsplit('Answer:', 1)[-1]) % 10}</score>"
    return f"try {r.index}: {(_number(r.user) + 3 * r.index) % 10}"


@query(f"WITH {_OWN}, s AS (SELECT instruction, doc_id % 10 AS a, (doc_id + 3) % 10 AS b FROM d) SELECT instruction, CASE WHEN a > b THEN 'try 0: ' || a ELSE 'try 1: ' || b END AS chosen, CASE WHEN a > b THEN 'try 1: ' || b ELSE 'try 0: ' || a END AS rejected FROM s WHERE abs(a - b) >= 5")
def staged_preference(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates answered, scored and paired beyond a margin."""
    todo = [{"stage": "generate_candidates"}, {"stage": "score_candidates", "config": {"metrics": ["helpfulness"]}}, {"stage": "build_preference_pairs", "config": {"min_margin": 5}}, {"stage": "build_preference_dataset"}]
    return stages.run("dpo_data_build", _docs(spark, sf).select(POS, "id", "instruction"), _answers(_rival), todo).select("instruction", "chosen", "rejected")
