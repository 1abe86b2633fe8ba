"""Queries over text, JSON and row functions, loaders and builders, each with the SQL that gives the same rows.

Answers of models are made up of the tables' columns, in the several shapes that parsers have to take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, rows, text
from ..functions.rows import POS
from ..operators import agents, builders, generate, joins, judges, select, video, votes
from ..sources import jsonl, loaders, media
from .registry import query, table

def _d() -> Column:
    return F.col("doc_id").cast("string")


def _n() -> Column:
    return F.col("n_chars").cast("string")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id is not null")


def _cat(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _by(n: int, *cases: Column) -> Column:
    """By doc_id modulo n."""
    out = F.when(F.col("doc_id") % n == 0, cases[0])
    for k, c in enumerate(cases[1:], 1):
        out = out.when(F.col("doc_id") % n == k, c)
    return out


# Text


@query("SELECT doc_id, trim(lang) AS instruction, 'r' || n_chars AS response FROM documents WHERE doc_id % 4 IN (0, 3)")
def instruction_response_pairs(spark: SparkSession, sf: str) -> DataFrame:
    whole = _cat("x <instruction> ", F.col("lang"), "\n</instruction> <response>r", _n(), "</response>")
    t = _by(4, whole, _cat("<instruction>", F.col("lang"), "</instruction>"), _cat("<instruction> </instruction><response>r", _n(), "</response>"), _cat(whole, "<instruction>later</instruction>"))
    return generate.extract_pairs(_docs(spark, sf).select(F.col("doc_id").alias(POS), t.alias("text"))).withColumnRenamed(POS, "doc_id")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 't' || n_chars WHEN 2 THEN 's' || lang END AS thought, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang WHEN 2 THEN source END AS solution FROM documents")
def thought_and_solution(spark: SparkSession, sf: str) -> DataFrame:
    both = _cat("<|begin_of_thought|>t", _n(), " <|end_of_thought|> <|begin_of_solution|>\n", F.col("lang"), "<|end_of_solution|><thinking>no</thinking>")
    t = _by(4, both, _cat("<|begin_of_solution|>", F.col("lang"), "<|end_of_solution|><thinking>not this</thinking>"), _cat("<thinking>s", F.col("lang"), "</thinking> <answer>", F.col("source"), "</answer>"), F.lit("plain"))
    a, b = text.thought_and_solution(t)
    return _docs(spark, sf).select("doc_id", a.alias("thought"), b.alias("solution"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN doc_id::VARCHAR ELSE 'none of ' || lang END AS by_group, CASE doc_id % 3 WHEN 0 THEN 'Result: ' || n_chars WHEN 1 THEN doc_id::VARCHAR ELSE 'none of ' || lang END AS by_match FROM documents")
def answer_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    t = _by(3, _cat("Result: ", _n(), " units of 7"), _cat("first 5, then ", _d()), _cat("none of ", F.col("lang")))
    return _docs(spark, sf).select("doc_id", text.answer_by(t, r"Result: (\d+)").alias("by_group"), text.answer_by(t, r"Result: \d+").alias("by_match"))


@query("SELECT doc_id, lang || ' has {' || n_chars || '} in ' || lang AS filled, 'a {missing} of {lang}' AS unknown, 'broken {lang' AS broken FROM documents")
def template_fill(spark: SparkSession, sf: str) -> DataFrame:
    v = {"lang": F.col("lang"), "n": F.col("n_chars")}
    return _docs(spark, sf).select("doc_id", text.fill("{lang} has {{{n}}} in {lang}", **v).alias("filled"), text.fill("a {missing} of {lang}", **v).alias("unknown"), text.fill("broken {lang", **v).alias("broken"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || source ELSE lang END AS said, doc_id % 3 = 0 AS images FROM documents")
def content_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("url"))
    none = F.lit(None).cast("string")
    picture = F.when(F.col("doc_id") % 3 == 0, part("image_url", none, _cat("https://i/", _d())))
    parts = F.array_compact(F.array(picture, part("text", F.col("lang"), none), F.when(F.col("doc_id") % 2 == 0, part("text", F.col("source"), none))))
    return _docs(spark, sf).select("doc_id", text.parts_text(parts).alias("said"), text.has_images(parts).alias("images"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text || CASE WHEN doc_id % 4 = 0 THEN '中' ELSE 'é' END, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS language FROM documents WHERE text IS NOT NULL")
def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null").select("doc_id", text.language(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "中").otherwise("é"))).alias("language"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '_solution_1.json' WHEN 1 THEN 'solution_' || doc_id WHEN 2 THEN doc_id || '.json' END AS file FROM documents")
def solution_files(spark: SparkSession, sf: str) -> DataFrame:
    t = _by(4, _cat(" ", _d(), "_solution_1.json\n"), _cat("I take solution_", _d(), " as best\nof all"), _cat(_d(), ".json"), F.lit("none at all"))
    return _docs(spark, sf).select("doc_id", text.solution_file(t).alias("file"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang || ' ' || n_chars END AS reply, doc_id % 3 = 1 AS changes FROM documents")
def tool_replies(spark: SparkSession, sf: str) -> DataFrame:
    said = _cat("<tool_response_start>old</tool_response_start> <tool_response_start>\n", F.col("lang"), " ", _n(), "</tool_response_start>")
    t = _by(3, _cat(said, "<new_bg_introduced>no</new_bg_introduced>"), _cat(said, "<new_bg_introduced> Yes, it does </new_bg_introduced>"), F.lit("nothing"))
    reply, changes = text.tool_reply(t)
    return _docs(spark, sf).select("doc_id", reply.alias("reply"), changes.alias("changes"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (n_chars % 90 + 1) || ':9' WHEN 1 THEN '16:' || (n_chars % 9 + 1) END AS ratio FROM documents")
def aspect_ratios(spark: SparkSession, sf: str) -> DataFrame:
    w, h = (F.col("n_chars") % 90 + 1).cast("string"), (F.col("n_chars") % 9 + 1).cast("string")
    t = _by(4, _cat('draft {"aspect_ratio": "', w, ' : 9", "x": {}} end'), _cat('{"aspect_ratio":"16:', h, '"}'), F.lit('{"aspect_ratio": "wide"}'), F.lit("16:9"))
    return _docs(spark, sf).select("doc_id", text.aspect_ratio(t).alias("ratio"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN false WHEN 2 THEN contains(lower(source), 'zzz') ELSE true END AS same FROM documents")
def same_answers(spark: SparkSession, sf: str) -> DataFrame:
    a = _by(4, _cat(" The ", F.upper("lang"), " one "), F.col("lang"), F.col("source"), F.lit(""))
    b = _by(4, F.col("lang"), _cat("it is ", F.upper("lang")), F.lit("ZZZ"), F.col("lang"))
    return _docs(spark, sf).select("doc_id", text.same_answer(a, b).alias("same"))


_TURNS = "c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)"


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return c.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


@query(
    f"WITH {_TURNS}, r AS (SELECT *, CASE WHEN role = 'user' AND i % 4 = 2 THEN '<tool_response>' || text || '</tool_response>' ELSE text END AS t FROM c), l AS (SELECT conv_id, i, CASE"
    " WHEN role = 'assistant' THEN '### Assistant (Turn ' || i || '):' || chr(10) || t || chr(10) WHEN role = 'user' AND t LIKE '<tool_response>%' THEN '### Tool Response:' || chr(10) || CASE WHEN length(trim(text)) > 500 THEN substr(trim(text), 1, 500) || '... [truncated]' ELSE trim(text) END || chr(10)"
    " WHEN role = 'user' THEN '### User (Turn ' || i || '):' || chr(10) || t || chr(10) END AS line FROM r), w AS (SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE line IS NOT NULL), '') AS s FROM l GROUP BY conv_id)"
    " SELECT conv_id, CASE WHEN length(s) > 600 THEN substr(s, 1, 600) || chr(10) || chr(10) || '... [trajectory truncated for length]' ELSE s END AS report FROM w"
)
def judge_reports(spark: SparkSession, sf: str) -> DataFrame:
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((m["role"] == "user") & (i % 4 == 2), F.concat(F.lit("<tool_response>"), m["content"], F.lit("</tool_response>"))).otherwise(m["content"]).alias("content")))
    return _talks(spark, sf).select("conv_id", text.judge_report(m, total=600).alias("report"))


@query(
    f"WITH {_TURNS}, l AS (SELECT conv_id, i, CASE WHEN role = 'assistant' THEN '[Search ' || count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY i) || '] Query: q' || i WHEN role = 'user' AND EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.i < c.i AND b.role = 'assistant')"
    " THEN '  └─ Got response...' END AS line FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n FROM l WHERE line IS NOT NULL)"
    " SELECT t.conv_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE n <= 15), 'Solver trajectory is empty or unparseable') AS report FROM (SELECT DISTINCT conv_id FROM c) t LEFT JOIN k USING (conv_id) GROUP BY t.conv_id"
)
def action_reports(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda m, i: F.when(m["role"] == "assistant", F.concat(F.lit('<tool_call>{"name": "web_search", "arguments": {"query": "q'), i.cast("string"), F.lit('"}}</tool_call>'))).otherwise(F.lit("<tool_response>x</tool_response>"))
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), said(m, i).alias("content")))
    return _talks(spark, sf).select("conv_id", text.action_report(m).alias("report"))


@query(
    f"WITH {_TURNS}, l AS (SELECT conv_id, i, CASE WHEN role = 'user' AND i = 1 THEN chr(10) || '[User Request]' || chr(10) || substr(text, 1, 800) || '...' || chr(10) WHEN role = 'user' AND contains(text, 'tool_response') THEN 'x' WHEN role = 'assistant' AND i % 3 = 0 THEN chr(10) || '[Assistant-Step' || i // 2 || ']' || chr(10) || 'Reasoning: why...' || chr(10) || 'Tool Call: <tool_call>{{\"name\": \"t' || i || '\"}}</tool_call>' || chr(10)"
    " WHEN role = 'assistant' THEN chr(10) || '[Assistant-Final Answer]' || chr(10) || substr(text, 1, 1000) || '...' || chr(10) END AS line, CASE WHEN role = 'assistant' AND i % 3 = 0 THEN 't' || i END AS tool FROM c)"
    " SELECT conv_id, '### Solution: s' || conv_id || chr(10) || chr(10) || '**Tool Call Count**: ' || count(tool) || chr(10) || '**Tools Used**: ' || coalesce(string_agg(tool, ', ' ORDER BY i) FILTER (WHERE tool IS NOT NULL), '') || chr(10) || chr(10) || '**Trajectory Summary**:' || chr(10) || coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE line IS NOT NULL), '') AS report FROM l GROUP BY conv_id"
)
def solution_reports(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda m, i: F.when((m["role"] == "assistant") & (i % 3 == 0), F.concat(F.lit(' why <tool_call>{"name": "t'), i.cast("string"), F.lit('"}</tool_call> after'))).otherwise(m["content"])
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), said(m, i).alias("content")))
    return _talks(spark, sf).select("conv_id", text.solution_report(m, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("report"))


@query(f"WITH {_TURNS} SELECT conv_id, coalesce(sum(CASE WHEN role = 'assistant' THEN (i % 2 = 0)::INT + (i % 3 = 0)::INT END), 0)::INT AS steps FROM c GROUP BY conv_id")
def tool_steps(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda i: F.concat_ws(" ", F.when(i % 2 == 0, "web_search"), F.when(i % 3 == 0, "web_browse web_browse"))
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), said(i).alias("content")))
    return _talks(spark, sf).select("conv_id", text.tool_steps(m).alias("steps"))


@query(f"WITH {_TURNS}, l AS (SELECT *, '[' || (i + 1) || '] ' || upper(role) || ': ' || CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS line FROM c), w AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i < 3) AS s FROM l GROUP BY conv_id) SELECT conv_id, CASE WHEN length(s) > 90 THEN substr(s, 1, 90) || chr(10) || '[cut]' ELSE s END AS report FROM w")
def text_caps(spark: SparkSession, sf: str) -> DataFrame:
    return _talks(spark, sf).select("conv_id", text.trajectory_text(F.col("messages"), 40, 90, 3).alias("report"))


@query(f"WITH {_TURNS}, s AS (SELECT conv_id, sum(length(text)) AS n FROM c GROUP BY conv_id) SELECT conv_id, n::BIGINT AS n FROM s WHERE n BETWEEN 100 AND 3000")
def trajectory_length_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows_ = _talks(spark, sf).select(F.col("conv_id").alias(POS), F.col("conv_id").alias("id"), F.array(F.struct(F.lit("s").alias("solution_id"), F.col("messages").alias("trajectory"), F.lit(1).alias("turns"))).alias("trajectories"))
    out = builders.search_sft(rows_, 100, 3000)
    return out.select(F.col(POS).alias("conv_id"), text.total_length(F.col("messages")).alias("n"))


# JSON


def _object(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with {"a": doc_id} whole, fenced, in prose after a broken one, and cut off."""
    one = _cat('{"a": ', _d(), ', "b": {"c": "}"}}')
    t = _by(5, one, _cat("Sure:\n```json\n", one, "\n```\n"), _cat("well {no json} but ", one, " and {"), _cat('cut {"a": ', _d()), _cat("[", _d(), "]"))
    return _docs(spark, sf).select("doc_id", t.alias("t"))


_ONE = "'{\"a\": ' || doc_id || ', \"b\": {\"c\": \"}\"}}'"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '{{no json}}' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE {_ONE} END AS first, CASE WHEN doc_id % 5 < 3 THEN {_ONE} END AS parsed FROM documents")
def balanced_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _object(spark, sf).select("doc_id", jsonx.balanced("t").alias("first"), jsonx.balanced_json("t").alias("parsed"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN {_ONE} END AS strict, CASE WHEN doc_id % 5 < 2 THEN {_ONE} END AS sliced, CASE WHEN doc_id % 5 < 2 THEN {_ONE} END AS block, CASE WHEN doc_id % 5 < 3 THEN doc_id END AS a FROM documents")
def json_blocks(spark: SparkSession, sf: str) -> DataFrame:
    strict = jsonx.strict_object(F.col("t"))
    return _object(spark, sf).select("doc_id", strict.alias("strict"), jsonx.sliced_object(F.col("t")).alias("sliced"), jsonx.block_object(F.col("t")).alias("block"), jsonx.field(strict, "a", "bigint").alias("a"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || chr(10) || '\"' || source WHEN 1 THEN lang || ' cut' END AS value FROM documents")
def string_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = _by(3, _cat('{"x": 1, "value" : "', F.col("lang"), '\\n\\"', F.col("source"), '", "y": "z"}'), _cat('{"value": "', F.col("lang"), " cut"), F.lit('{"other": "v"}'))
    return _docs(spark, sf).select("doc_id", jsonx.string_field(t, "value").alias("value"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 't:' || lang || ',:' || n_chars WHEN 1 THEN 't:' || lang WHEN 2 THEN ':' || source || ',:' || lang ELSE '' END AS items FROM documents")
def expansion_items(spark: SparkSession, sf: str) -> DataFrame:
    item = _cat('{"topic": " t ", "prompt": "', F.col("lang"), '"}')
    t = _by(4, _cat("```json\n[", item, ', {"prompt": "', _n(), '"}, {"topic": "u", "prompt": "  "}]\n```'), _cat("[", item, ', {"topic": "cut", "pro'), _cat('["', F.col("source"), '", "", "', F.col("lang"), '"]'), F.lit("no array"))
    shown = F.transform(jsonx.expansion_items(t), lambda x: F.concat(x["topic"], F.lit(":"), x["prompt"]))
    return _docs(spark, sf).select("doc_id", F.array_join(shown, ",").alias("items"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'web_search' WHEN 1 THEN 'run' END AS name, CASE doc_id % 3 WHEN 0 THEN lang END AS query FROM documents")
def tool_call_json(spark: SparkSession, sf: str) -> DataFrame:
    t = _by(3, _cat('{"name": "web_search", "arguments": {"query": "', F.col("lang"), '"}}'), F.lit('{"name": "run"}'), F.lit("{broken"))
    name, arguments = jsonx.tool_call(t)
    return _docs(spark, sf).select("doc_id", name.alias("name"), F.get_json_object(arguments, "$.query").alias("query"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE least(4, n_chars % 6)::INT END AS q, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS q_confidence, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS q_reason, NULL::INT AS absent FROM documents")
def judgment_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Of a dimension that is named twice the last counts; one that isn't applicable is null."""
    row = lambda ok, s: _cat('{"dimension": "q", "applicable": ', ok, ', "score": ', s, ', "confidence": 0.5, "reason": "', F.col("lang"), '"}')
    ok = F.when(F.col("doc_id") % 3 == 0, "false").otherwise("true")
    t = _cat("[", row(F.lit("true"), F.lit("1")), ', {"dimension": "other", "score": 3}, ', row(ok, (F.col("n_chars") % 6).cast("string")), "]")
    cols = jsonx.judgment_columns(t, ["q", "absent"])
    return _docs(spark, sf).select("doc_id", *(cols[c].alias(c) for c in ("q", "q_confidence", "q_reason", "absent")))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'search' WHEN 1 THEN 'search' WHEN 2 THEN 'search' WHEN 3 THEN 'search' WHEN 4 THEN 'run' END AS name, CASE WHEN doc_id % 6 < 4 THEN lang END AS q FROM documents")
def lenient_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    call = _cat('{"name": "search", "arguments": {"q": "', F.col("lang"), '"}}')
    t = _by(6, _cat("so <tool_call>", call, "</tool_call>"), _cat("<tool_call>", call, "</tool>"), _cat("<|tool_call_begin|>", call), _cat("x\n```json\n", call, "\n```"), F.lit('functions.run:0({"a": 1})'), F.lit("no call"))
    found = F.pandas_udf(_calls, "struct<name:string,q:string>")(t)
    return _docs(spark, sf).select("doc_id", found.alias("c")).select("doc_id", "c.name", "c.q")


def _calls(texts):
    import pandas as pd

    got = [agents.tool_call(t) or {} for t in texts]
    return pd.DataFrame({"name": [g.get("name") for g in got], "q": [(g.get("arguments") or {}).get("q") for g in got]})


# Rules


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN n_chars % 8 >= 4 THEN 'good' ELSE 'too_easy' END ELSE CASE WHEN n_chars % 8 >= 4 THEN 'too_hard' ELSE 'broken' END END AS difficulty,"
    " CASE WHEN doc_id % 2 = 0 THEN CASE WHEN n_chars % 8 >= 4 THEN 'FINALIZE' ELSE 'EXPAND' END ELSE CASE WHEN n_chars % 8 >= 4 THEN 'REFINE' ELSE 'ROLLBACK' END END AS action,"
    " CASE WHEN doc_id % 2 = 0 THEN CASE WHEN n_chars % 8 >= 4 THEN 'FINALIZE' WHEN doc_id % 5 < 4 THEN 'EXPAND' ELSE 'REFINE' END ELSE CASE WHEN n_chars % 8 < 4 AND doc_id % 5 > 0 THEN 'ROLLBACK' ELSE 'REFINE' END END AS next FROM documents"
)
def rule_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that stand in for a judge and a strategist."""
    told = F.pandas_udf(_decide, "struct<difficulty:string,action:string,next:string>")(F.col("doc_id"), F.col("n_chars"))
    return _docs(spark, sf).select("doc_id", told.alias("d")).select("doc_id", "d.*")


def _decide(ids, sizes):
    import pandas as pd

    out = []
    for i, n in zip(ids, sizes):
        j = agents.fallback_judgment(i % 2 == 0, int(n % 8))
        out.append((j["difficulty"], j["action"], agents.next_action({"judgment": j, "level": int(i % 5), "max_level": 4})))
    return pd.DataFrame(out, columns=["difficulty", "action", "next"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'too_hard' ELSE 'broken' END AS difficulty, CASE WHEN doc_id % 3 = 1 THEN 'REFINE' ELSE 'FINALIZE' END AS action, doc_id % 3 <> 1 AS is_correct, lang AS tip FROM documents")
def judge_reports_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown difficulties are broken, unknown actions end the work, one suggestion is a list of one."""
    t = _by(3, _cat('{"is_correct": true, "difficulty": "too_hard", "action": "JUMP", "suggestions": "', F.col("lang"), '"}'), _cat('{"is_correct": false, "difficulty": 7, "action": "REFINE", "suggestions": ["', F.col("lang"), '"]}'), _cat('{"suggestions": ["', F.col("lang"), '"]}'))
    told = F.pandas_udf(_normal, "struct<difficulty:string,action:string,is_correct:boolean,tip:string>")(t)
    return _docs(spark, sf).select("doc_id", told.alias("d")).select("doc_id", "d.*")


def _normal(texts):
    import pandas as pd

    from ..operators.model import FakeBackend

    out = []
    for t in texts:
        j = agents.judge_task(agents.Caller(FakeBackend(t.replace("{user}", ""))), "q", "a", "g", 5, True)
        out.append((j["difficulty"], j["action"], j["is_correct"], (j.get("suggestions") or [None])[0]))
    return pd.DataFrame(out, columns=["difficulty", "action", "is_correct", "tip"])


# Rewritten prompts


def _rewritten(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("scene"), "n_chars")
    ints = {m: (5 + (F.col("n_chars") + k * F.col("id")) % 5).cast("int") for k, m in enumerate(judges.REWRITE_INT)}
    return d.withColumns(ints | {"language_consistency": F.col("id") % 10 != 3, "no_conflict": F.when(F.col("id") % 11 != 5, True)}).drop("n_chars")


_R = (
    "r AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 OR source = '' THEN 'unknown' ELSE source END AS scene, doc_id % 10 <> 3 AS lc, CASE WHEN doc_id % 11 <> 5 THEN true END AS nc, "
    + ", ".join(f"5 + (n_chars + {k} * doc_id) % 5 AS m{k}" for k in range(7))
    + " FROM documents), g AS (SELECT *, (m0 + m1 + m2 + m3 + m4 + m5 + m6) / 7.0 AS s FROM r WHERE m0 >= 7 AND m1 >= 7 AND m6 >= 7 AND m2 >= 6 AND m3 >= 6 AND m4 >= 5 AND m5 >= 5 AND lc AND nc)"
)


@query(f"WITH {_R} SELECT id FROM g")
def pe_default_gates(spark: SparkSession, sf: str) -> DataFrame:
    return select.rewrite_filter(_rewritten(spark, sf)).select("id")


@query(f"WITH {_R} SELECT id FROM g QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round(s, 9) DESC, id) <= greatest(1, ceil(count(*) OVER (PARTITION BY scene) * 0.4))")
def pe_per_scene(spark: SparkSession, sf: str) -> DataFrame:
    return select.rewrite_filter(_rewritten(spark, sf), fraction=0.4).select("id")


@query(f"WITH {_R} SELECT id FROM g QUALIFY row_number() OVER (ORDER BY round(s, 9) DESC, id) <= floor(count(*) OVER () * 0.4)")
def pe_global(spark: SparkSession, sf: str) -> DataFrame:
    return select.rewrite_filter(_rewritten(spark, sf), fraction=0.4, per_scene=False).select("id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Rewrite.' WHEN 'de' THEN 'Schreib um.' ELSE 'Any.' END AS system, source AS asked, 'r' || doc_id AS answer, n_chars::VARCHAR AS lineage, true AS clean FROM documents WHERE source <> ''")
def rewrite_sft(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias(POS), "doc_id", F.upper("lang").alias("language"), F.col("source").alias("instruction"), _cat("r", _d()).alias("response"), F.col("n_chars").alias("source_seed_id"), F.lit(7).alias("usability"), F.lit("t").alias("agent_trace"), F.lit(3).alias("some_score"))
    out = builders.rewrite_sft(d, {"EN": "Rewrite.", "de": "Schreib um."}, "Any.")
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    return out.select(F.col(POS).alias("doc_id"), F.element_at("messages", 1)["content"].alias("system"), F.element_at("messages", 2)["content"].alias("asked"), F.element_at("messages", 3)["content"].alias("answer"), meta("source_seed_id").alias("lineage"), (meta("usability").isNull() & meta("agent_trace").isNull() & meta("some_score").isNull()).alias("clean"))


# Joins and lookups


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'E' WHEN 'fr' THEN 'F' ELSE 'X' END AS prompt FROM documents")
def language_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", joins.by_language(F.initcap("lang"), {"EN": "E", "fr": "F"}, "X").alias("prompt"))


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'Quality' WHEN 1 THEN 'Safety' ELSE 'unknown' END AS l1 FROM events")
def l3_to_l1(spark: SparkSession, sf: str) -> DataFrame:
    pool = spark.createDataFrame([("Quality", "d0"), ("Safety", "d1"), ("Safety", "d1")], "l1 string, l3 string")
    votes_ = table(spark, sf, "events").select("event_id", F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dimension"))
    return joins.with_l1(votes_, pool).select("event_id", "l1")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'late' WHEN 1 THEN 'q' || page_id ELSE '' END AS context FROM pages")
def browse_context(spark: SparkSession, sf: str) -> DataFrame:
    hit = lambda s, q: F.struct(F.when(F.col("page_id") % 3 < 2, F.col("url")).otherwise("other").alias("url"), s.alias("snippet"), q.alias("query"))
    seen = F.array(hit(F.lit("early"), F.lit("x")), hit(F.when(F.col("page_id") % 3 == 0, "late").otherwise(""), _cat("q", F.col("page_id").cast("string"))))
    return table(spark, sf, "pages").where("url is not null").select("page_id", joins.url_context(F.col("url"), seen).alias("context"))


@query("SELECT c_custkey AS case_id, t.t AS teacher, g.g AS l1 FROM customer, (VALUES ('a'), ('b')) t(t), (VALUES ('q'), ('s'), ('z')) g(g)")
def teacher_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    return joins.cases_by_teacher(table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), one("teacher", "a", "b"), one("l1", "q", "s", "z"))


@query("SELECT d.doc_id AS id, d.lang AS prompt, l.quality, l.toxic AS extra FROM documents d LEFT JOIN labels l USING (doc_id)")
def companion_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Scores come with companion columns that rows lack, but never replace what identifies a row."""
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias(POS), "quality", F.col("toxic").alias("extra"), F.lit("other").alias("prompt"))
    return joins.carry_companions(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("prompt")), scores).select("id", "prompt", "quality", "extra")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS optimize, doc_id % 3 = 0 AS generate, doc_id % 5 = 0 AS eval FROM documents")
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(
        "doc_id", _by(4, F.lit("p"), F.lit(""), F.lit(None), F.lit(None)).alias("optimized_prompt"), _by(4, F.lit(None), F.lit(None), F.lit("q"), F.lit("")).alias("prompt"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("video_urls"),
        F.when(F.col("doc_id") % 5 == 0, 1.0).alias("x_confidence"), F.lit("r").alias("vbench_skipped_reason"),
    )
    return d.select("doc_id", *(joins.complete(d, k).alias(k) for k in ("optimize", "generate", "eval")))


@query("SELECT doc_id, '{\"lang\":' || to_json(lang) || ',\"n_chars\":' || n_chars || '}' AS metadata FROM documents")
def metadata_projection(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", "lang", "n_chars", F.lit(None).cast("string").alias("gone"))
    return d.select("doc_id", rows.rest_as_json(d, {"doc_id"}).alias("metadata"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def input_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias(POS)).orderBy(POS).limit(25).withColumnRenamed(POS, "event_id")


# Votes


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 4).cast("string")).alias("dimension")).agg(F.min("l_suppkey").alias("k"))
    return li.select("case_id", "dimension", F.concat(F.lit("g"), (F.col("k") % 2).cast("string")).alias("l1"), F.when(F.col("k") % 5 != 0, (F.col("k") % 5).cast("int")).alias("score"), (F.col("k") % 5 != 0).alias("applicable"))


_L = "l AS (SELECT l_orderkey AS case_id, 'd' || l_partkey % 4 AS dimension, min(l_suppkey) AS k FROM lineitem GROUP BY ALL), s AS (SELECT case_id, dimension, CASE WHEN k % 5 <> 0 THEN k % 5 END AS score FROM l)"


@query(f"WITH {_L} SELECT case_id, count(score) AS n_scored, count(*) - count(score) AS n_na, avg(score * 25.0) AS overall FROM s GROUP BY case_id")
def overall_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Edited images: no group is left out, and nothing vetoes. Means of quarters, compared before they are rounded."""
    out = votes.overall(_labelled(spark, sf), None, None)
    exact = _labelled(spark, sf).groupBy("case_id").agg(F.avg(F.col("score") * 25.0).alias("exact"))
    return out.join(exact, "case_id").select("case_id", "n_scored", "n_na", F.when(F.abs(F.col("overall") - F.col("exact")) <= 0.005000001, F.col("exact")).otherwise(F.col("overall")).alias("overall"))


@query("SELECT count(*) AS cases, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS cases_failed, min(o_orderkey % 101)::DOUBLE AS min, max(o_orderkey % 101)::DOUBLE AS max, sum(o_orderkey % 3)::BIGINT AS n_debated, round(avg(o_orderkey % 101), 1) AS mean FROM orders")
def case_summary(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "failed").alias("error"), (F.col("o_orderkey") % 101).cast("double").alias("overall"), (F.col("o_orderkey") % 3).alias("n_debated"))
    return votes.summary(cases).withColumn("mean", F.round("mean", 1))


# Builders


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias(POS), F.col("source").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("system"), _cat("good ", _d()).alias("chosen"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(_cat("bad ", _n())).alias("rejected"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'system:' || lang || ',human:' || source ELSE 'human:' || source END AS turns, 'gpt:good ' || doc_id AS chosen, 'gpt:bad ' || n_chars AS rejected FROM documents WHERE doc_id % 5 <> 0")
def preference_sharegpt(spark: SparkSession, sf: str) -> DataFrame:
    out = builders.preference(_pairs(spark, sf), "llama_factory_sharegpt")
    shown = lambda x: F.concat(x["from"], F.lit(":"), x["value"])
    return out.select(F.col(POS).alias("doc_id"), F.array_join(F.transform("conversations", shown), ",").alias("turns"), shown(F.col("chosen")).alias("chosen"), shown(F.col("rejected")).alias("rejected"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'system:' || lang || ',user:' || source ELSE 'user:' || source END AS prompt, 'assistant:good ' || doc_id AS chosen, 'assistant:bad ' || n_chars AS rejected FROM documents WHERE doc_id % 5 <> 0")
def preference_messages(spark: SparkSession, sf: str) -> DataFrame:
    out = builders.preference(_pairs(spark, sf), "openai_messages")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), ",")
    return out.select(F.col(POS).alias("doc_id"), *(shown(c).alias(c) for c in ("prompt", "chosen", "rejected")))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda k, t: F.struct(F.lit(f"s{k}").alias("solution_id"), F.array(builders.message("user", F.col("lang")), builders.message("assistant", t)).alias("trajectory"), F.lit(k).alias("turns"))
    named = _by(3, F.lit("s2"), F.lit("s9"), F.lit(None).cast("string"))
    return _docs(spark, sf).select(F.col("doc_id").alias(POS), F.col("doc_id").alias("id"), F.col("source").alias("task"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("fuzzy_task"), named.alias("best_solution_id"), F.array(run(1, _cat("a", _d())), run(2, _cat("b", _n()))).alias("trajectories"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' || n_chars ELSE 'a' || doc_id END AS answer, CASE WHEN doc_id % 3 = 0 THEN 's2' ELSE 's1' END AS solution FROM documents")
def agent_sft(spark: SparkSession, sf: str) -> DataFrame:
    return builders.trajectory_sft(_tasks(spark, sf)).select(F.col(POS).alias("doc_id"), F.element_at("messages", -1)["content"].alias("answer"), F.get_json_object("metadata", "$.solution_id").alias("solution"))


@query("SELECT doc_id, 's' || k AS solution, CASE k WHEN 1 THEN 'a' || doc_id ELSE 'b' || n_chars END AS answer FROM documents, (VALUES (1), (2)) v(k)")
def search_agent_sft(spark: SparkSession, sf: str) -> DataFrame:
    return builders.search_sft(_tasks(spark, sf)).select(F.col(POS).alias("doc_id"), F.get_json_object("metadata", "$.solution_id").alias("solution"), F.element_at("messages", -1)["content"].alias("answer"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, source) AS instruction, 'b' || n_chars AS chosen, 'a' || doc_id AS rejected FROM documents WHERE doc_id % 3 = 0")
def agent_preference(spark: SparkSession, sf: str) -> DataFrame:
    """The rollout named best against the other; a name that no rollout has gives no pair."""
    out = builders.agent_preference(_tasks(spark, sf))
    last = lambda c: F.get_json_object(c, "$[1].content")
    return out.select(F.col(POS).alias("doc_id"), "instruction", last("chosen").alias("chosen"), last("rejected").alias("rejected"))


@query("SELECT doc_id, CASE WHEN lang <> '' THEN 'system:' || lang || ',' ELSE '' END || 'user:' || source || ',assistant:' || n_chars AS chat FROM documents")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    chat = builders.chat(F.col("source"), F.col("n_chars"), F.col("lang"))
    return _docs(spark, sf).select("doc_id", F.array_join(F.transform(chat, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), ",").alias("chat"))


# Loaders


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias(POS), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("i"), _d())).alias("id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("instruction"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("system"), "n_chars")


_ID = "CASE WHEN doc_id % 2 = 0 THEN 'i' || doc_id ELSE doc_id::VARCHAR END AS id"


@query(f"SELECT {_ID}, source AS instruction, CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN lang ELSE 'Default.' END AS system, '{{\"n_chars\":' || n_chars || '}}' AS metadata FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_requests(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.requests(_rows(spark, sf), system_prompt="Default.").drop(POS)


@query("SELECT doc_id, source AS text FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_strings(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.strings(_rows(spark, sf)).withColumnRenamed(POS, "doc_id")


@query(f"SELECT {_ID}, source AS instruction FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.seeds(_rows(spark, sf)).drop(POS)


@query(f"SELECT {_ID}, source AS instruction, n_chars FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_instruction_rows(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.instruction_rows(_rows(spark, sf).withColumnRenamed("instruction", "ask"), "ask").select("id", "instruction", "n_chars")


@query(f"SELECT {_ID}, CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN lang ELSE source END AS problem FROM documents WHERE (doc_id % 3 = 0 AND lang <> '') OR (doc_id % 5 <> 0 AND source <> '')")
def load_problems(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.problems(_rows(spark, sf).withColumnRenamed("system", "problem")).drop(POS)


def _pictured(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return _rows(spark, sf).select(POS, "id", "instruction", F.when(F.col(POS) % 3 == 0, F.array(F.concat(F.lit("u"), F.col(POS).cast("string")), F.lit("v"))).otherwise(none).alias("images"), F.struct(F.when(F.col(POS) % 3 == 1, F.array(F.lit("m"))).otherwise(none).alias("images")).alias("metadata"), F.array(builders.message("user", F.lit("asked")), builders.message("assistant", F.lit("said"))).alias("messages"))


_IMG = "CASE doc_id % 3 WHEN 0 THEN 'u' || doc_id || ',v' WHEN 1 THEN 'm' ELSE '' END AS images"


@query(f"SELECT {_ID}, source AS instruction, {_IMG} FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_multimodal(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.multimodal_inputs(_pictured(spark, sf)).select("id", "instruction", F.array_join("images", ",").alias("images"))


@query(f"SELECT {_ID}, CASE WHEN doc_id % 5 <> 0 AND source <> '' THEN source ELSE 'asked' END AS problem, 'said' AS answer, {_IMG} FROM documents")
def load_multimodal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.problem_answer_pairs(_pictured(spark, sf), multimodal=True).select("id", "problem", "answer", F.array_join("images", ",").alias("images"))


@query(f"SELECT {_ID}, 'asked' AS instruction, 'said' AS output, {_IMG} FROM documents WHERE doc_id % 5 = 0 OR source = ''")
def load_multimodal_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with neither instruction nor answer take both from their messages; those with an instruction alone have nothing to judge."""
    return loaders.eval_samples(_pictured(spark, sf), multimodal=True).select("id", "instruction", "output", F.array_join("images", ",").alias("images"))


@query(f"SELECT {_ID}, CASE WHEN doc_id % 3 = 0 AND lang <> '' THEN lang ELSE source END AS prompt, '{{\"instruction\":\"x\",\"n_chars\":' || n_chars || '}}' AS metadata FROM documents WHERE (doc_id % 3 = 0 AND lang <> '') OR (doc_id % 5 <> 0 AND source <> '')")
def load_image_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A missing prompt is the instruction; all other columns go to the metadata."""
    out = loaders.image_seeds(_rows(spark, sf).withColumnRenamed("system", "prompt"))
    return out.select("id", "prompt", F.regexp_replace("metadata", '"instruction":"[^"]*"', '"instruction":"x"').alias("metadata"))


@query(f"SELECT {_ID}, source AS prompt, CASE WHEN doc_id % 3 = 0 THEN nullif(lang, '') END AS first_frame_image, NULL::VARCHAR AS ratio FROM documents WHERE doc_id % 5 <> 0 AND source <> ''")
def load_video_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.video_seeds(_rows(spark, sf).withColumnRenamed("system", "first_frame_image")).select("id", "prompt", "first_frame_image", "ratio")


@query("SELECT r_name AS l1, n_name AS l3, 'c' || n_nationkey AS criteria FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 3")
def dimension_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of regions and nations, flattened; items without a name are left out."""
    n = table(spark, sf, "nation").select("n_regionkey", F.struct(F.when(F.col("n_nationkey") % 7 != 3, F.col("n_name")).alias("name"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("criteria")).alias("item"))
    g = n.groupBy("n_regionkey").agg(F.array(F.struct(F.lit("g").alias("name"), F.sort_array(F.collect_list("item")).alias("items"))).alias("l2_groups"))
    tree = g.join(table(spark, sf, "region"), g.n_regionkey == F.col("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("r_name").alias("name"), "l2_groups"))).alias("dimensions"))
    return loaders.dimension_pool(tree).select("l1", "l3", "criteria")


@query("SELECT p_partkey, p_type AS instruction, p_brand AS response, 'kept' AS other FROM part")
def alias_columns(spark: SparkSession, sf: str) -> DataFrame:
    """instruction and output of a stage's rows, by the first alias that holds anything."""
    p = table(spark, sf, "part").select("p_partkey", F.lit("").alias("input"), F.col("p_type").alias("problem"), F.lit(None).cast("string").alias("output"), F.col("p_brand").alias("response"), F.lit("kept").alias("other"))
    return judges.eval_input(p).select("p_partkey", "instruction", F.col("output").alias("response"), "other")


# Videos


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'clip.v' || page_id WHEN 1 THEN 'p' || page_id WHEN 2 THEN '.hidden' ELSE 'folder' END AS stem FROM pages")
def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/a/b/clip.v"), p, F.lit(".mp4"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("p"), p)).when(F.col("page_id") % 4 == 2, F.lit("/x/.hidden")).otherwise("/a/folder/")
    return table(spark, sf, "pages").select("page_id", video.stem(path).alias("stem"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN (o_orderkey % 100) / 10.0 END AS vbench_dynamic_degree, NULL::DOUBLE AS vbench_imaging_quality FROM orders WHERE o_orderkey % 2 = 0")
def vbench_join(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark scores joined to videos by their file names; videos on the web have none."""
    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0")
    k = F.col("o_orderkey").cast("string")
    scores = o.select(F.lit("dynamic_degree").alias("dimension"), F.concat(F.lit("v"), k).alias("stem"), ((F.col("o_orderkey") % 100) / 10.0).alias("score"))
    url = F.concat(F.when(F.col("o_orderkey") % 5 == 4, "https://v/v").otherwise("file:///tmp/v"), k, F.lit(".mp4"))
    return video.with_bench(o.select("o_orderkey", F.array(url).alias("video_urls")), scores, ["dynamic_degree", "imaging_quality"]).select("o_orderkey", "vbench_dynamic_degree", "vbench_imaging_quality")


@query("SELECT p_partkey, least(p_size * 20, 100 + p_partkey % 900) >= 256 AND greatest(p_size * 20, 100 + p_partkey % 900)::DOUBLE / least(p_size * 20, 100 + p_partkey % 900) <= 3 AS fits FROM part")
def first_frame_bounds(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("p_size") * 20, 100 + F.col("p_partkey") % 900
    return table(spark, sf, "part").select("p_partkey", video.frame_fits(w, h).alias("fits"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AS web, CASE WHEN regexp_matches(url, '^https?://') THEN url END AS inline FROM pages WHERE url IS NOT NULL")
def media_references(spark: SparkSession, sf: str) -> DataFrame:
    """Web addresses stay; a path without a file gives null."""
    p = table(spark, sf, "pages").where("url is not null").select("page_id", "url")
    return media.data_urls(p, "url", "inline").select("page_id", text.is_image_reference(F.col("url")).alias("web"), "inline")


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), '') AS instruction, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), '') AS output FROM conversations GROUP BY conv_id")
def alpaca_without_system(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.alpaca(_talks(spark, sf).withColumnRenamed("conv_id", POS), include_system=False).withColumnRenamed(POS, "conv_id")
