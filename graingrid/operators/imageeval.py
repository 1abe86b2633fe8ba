"""Evaluation of generated and edited images by several teachers, debates over what they disagree on, and overall scores.

Every step is one frame: cases times teachers times groups of dimensions, one model call each, parsed to a long table of
votes; conflicts, majority and scores are group-bys on the case; a debate is three calls in a row for each conflict. A
call whose answer is no JSON object is made again, and then left out, so a failing teacher costs only its own votes.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.rows import POS, first_truthy, pystrip, truthy, with_pos
from . import votes as V
from .builders import message
from .joins import with_l1
from .model import Factory, call_model

PROMPTS = {
    "teacher": "Score the images on each dimension below from 0 to 4. Answer with a JSON object of dimension_judgments: an array of dimension, applicable, score, confidence (0 to 1) and reason.\n\n{context}\n\nGroup: {l1}\n{dims}",
    "first": "Teachers disagree on {dimension}. Judge it yourself: a JSON object of score, reason.\n\n{context}\nCriteria: {criteria}\nTheir scores: {scores}",
    "second": "Argue both sides on {dimension}: a JSON object of prosecution and defense.\n\n{context}\nTheir scores: {scores}\nFirst judgment: {first}",
    "third": "Decide on {dimension}: a JSON object of applicable, score, confidence and reason.\n\n{context}\nCriteria: {criteria}\nTheir scores: {scores}\nFirst judgment: {first}\nAgainst: {prosecution}\nFor: {defense}",
    "reason": "Write one reason for this score out of the teachers' reasons: a JSON object of reason.\n\nDimension: {dimension}\nScore: {score}\nVotes: {votes}",
}
_JUDGMENTS = "array<struct<dimension:string,applicable:boolean,score:double,confidence:double,reason:string>>"


def _have(df: DataFrame, *names: str) -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(first_truthy(*found), F.lit("")) if found else F.lit("")


def cases(df: DataFrame, edited: bool = False) -> DataFrame:
    """case_id, instruction and images of seed rows: one image, or the images before and after an edit and its references."""
    df = with_pos(df, dense=True)
    if edited:
        two = F.array(*(F.col(n).cast("string") for n in ("before_image", "after_image") if n in df.columns))
        more = F.coalesce("reference_images", F.array().cast("array<string>")) if "reference_images" in df.columns else F.array().cast("array<string>")
        found, ident, asked = F.concat(two, more), _have(df, "case_id", "id"), _have(df, "instruction", "raw_prompt")
    else:
        found, ident, asked = F.array(_have(df, "image")), _have(df, "prompt_id", "id", "case_id"), _have(df, "prompt", "instruction")
    images = F.filter(found, lambda i: F.coalesce(i, F.lit("")) != "").cast("array<string>")
    return df.select(POS, F.coalesce(F.nullif(ident, F.lit("")), F.col(POS).cast("string")).alias("case_id"), asked.alias("instruction"), images.alias("images"))


def call_json(df: DataFrame, make: Factory, words: Column, ident: Column, images: Column | None = None, retries: int = 2, workers: int = 4, out: str = "json", **options: Any) -> DataFrame:
    """The frame with ``out``, the answer's JSON object as text; null where no try gave one."""
    asked = words if images is None else F.when(F.size(images) > 0, F.to_json(text.user_parts(words, images))).otherwise(words)
    left, done = df, None
    for n in range(retries + 1):
        got = call_model(left, make, F.array(message("user", asked)), ident, F.lit(n), {"temperature": 0.0, "max_tokens": 8000} | options, workers)
        got = got.withColumn(out, jsonx.block_object(F.col("response"))).select(*df.columns, out)
        good = got.where(F.col(out).isNotNull())
        done = good if done is None else done.unionByName(good)
        left = got.where(F.col(out).isNull())
        if n == retries or left.isEmpty():
            return done.unionByName(left)
        left = left.drop(out)
    raise AssertionError


def teacher_votes(rows: DataFrame, pool: DataFrame, teachers: dict[str, Factory], context: Column, **call: Any) -> DataFrame:
    """Votes of every teacher on every case, one call for each top group of the pool (l1, l3, criteria: a configured table)."""
    dims = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l3", "criteria"))), lambda d: F.concat(F.lit("- "), d["l3"], F.lit(": "), F.coalesce(d["criteria"].cast("string"), F.lit("")))), "\n")
    groups = pool.groupBy("l1").agg(dims.alias("__dims"), F.collect_set("l3").alias("__names"))
    asked = rows.crossJoin(F.broadcast(groups))
    out = None
    for k, (teacher, make) in enumerate(teachers.items()):
        words = text.fill(PROMPTS["teacher"], context=context, l1=F.col("l1"), dims=F.col("__dims"))
        got = call_json(asked, make, words, F.concat_ws("::", "case_id", F.lit(teacher), "l1"), F.col("images"), **call)
        items = F.from_json(F.get_json_object("json", "$.dimension_judgments"), _JUDGMENTS)
        one = got.select("case_id", "l1", "__names", F.posexplode(items).alias("__n", "j")).where(F.array_contains("__names", F.col("j.dimension")))
        one = one.select(
            "case_id", F.col("j.dimension").alias("dimension"), "l1", F.lit(teacher).alias("teacher"), F.col("j.applicable").alias("applicable"), jsonx.clamp(F.col("j.score")).alias("score"),
            F.col("j.confidence").alias("confidence"), F.coalesce(F.col("j.reason"), F.lit("")).alias("reason"), F.struct(F.lit(k).alias("teacher"), F.col("l1").alias("group"), F.col("__n").alias("n")).alias("_vpos"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def debates(rows: DataFrame, votes: DataFrame, spread: DataFrame, pool: DataFrame, arbiter: Factory, context: Column, **call: Any) -> DataFrame:
    """The outcome of each conflict's debate: a first judgment, both sides argued, a decision. ``success`` is false where a step failed."""
    scores = F.map_from_entries(F.sort_array(F.collect_list(F.struct("teacher", "score"))))
    asked = spread.join(votes.groupBy(*V.CASE).agg(F.to_json(scores).alias("__scores")), V.CASE).join(rows.select("case_id", "instruction", "images"), "case_id")
    criteria = pool.select(F.col("l3").alias("dimension"), F.col("criteria").cast("string").alias("__criteria"))
    asked = asked.join(F.broadcast(criteria), "dimension", "left").select(*V.CASE, "instruction", "images", "__scores", F.coalesce("__criteria", F.lit("")).alias("__criteria"))
    base = {"dimension": F.col("dimension"), "context": context, "scores": F.col("__scores"), "criteria": F.col("__criteria")}
    ident = lambda step: F.concat_ws("::", "case_id", "dimension", F.lit(step))
    got = call_json(asked, arbiter, text.fill(PROMPTS["first"], **base), ident("first"), F.col("images"), out="first", **call)
    lost = got.where("first is null")
    got = call_json(got.where("first is not null"), arbiter, text.fill(PROMPTS["second"], **base, first=jsonx.field(F.col("first"), "score")), ident("second"), F.col("images"), out="second", **call)
    lost = lost.withColumn("second", F.lit(None).cast("string")).unionByName(got.where("second is null"))
    sides = {k: jsonx.field(F.col("second"), k) for k in ("prosecution", "defense")}
    got = call_json(got.where("second is not null"), arbiter, text.fill(PROMPTS["third"], **base, first=F.col("first"), **sides), ident("third"), F.col("images"), out="third", **call)
    got = got.unionByName(lost.withColumn("third", F.lit(None).cast("string")))
    third = F.col("third")
    return got.select(
        *V.CASE, third.isNotNull().alias("success"), jsonx.clamp(jsonx.field(third, "score")).alias("score"), F.coalesce(jsonx.field(third, "applicable", "boolean"), F.lit(True)).alias("applicable"),
        jsonx.field(third, "confidence", "double").alias("confidence"), F.coalesce(jsonx.field(third, "reason"), F.lit("")).alias("reason"), F.when(third.isNotNull(), F.to_json(F.struct("first", "second", "third"))).alias("steps"),
    )


def single_labels(votes: DataFrame) -> DataFrame:
    """One teacher's votes as labels, the last vote on a dimension."""
    last = votes.groupBy(*V.CASE).agg(F.max_by(F.struct("applicable", "score", "confidence", "reason"), "_vpos").alias("v"))
    na = F.coalesce(~F.col("v.applicable"), F.lit(False))
    return last.select(
        *V.CASE, F.coalesce("v.applicable", F.lit(True)).alias("applicable"), F.when(~na, F.col("v.score")).alias("score"), "v.confidence", "v.reason", F.lit("single_teacher_score").alias("source"),
        F.lit(False).alias("debated"), F.lit(None).cast("int").alias("majority_score"), F.lit(None).cast("string").alias("steps"),
    )


def debated_labels(votes: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Majority labels, a successful debate's outcome in its place; a failed debate leaves the majority."""
    major = V.majority(votes)
    if outcomes is None:
        return major.withColumns({"source": F.lit("weighted_majority_consensus"), "debated": F.lit(False), "majority_score": F.col("score"), "steps": F.lit(None).cast("string")})
    d = outcomes.select(*V.CASE, F.struct("success", "score", "applicable", "confidence", "reason", "steps").alias("d"))
    out = major.join(d, V.CASE, "left")
    won = F.coalesce(F.col("d.success"), F.lit(False))
    pick = lambda n: F.when(won, F.col(f"d.{n}")).otherwise(F.col(n))
    source = F.when(won, "debate_arbitration").when(F.col("d").isNotNull(), "fallback_weighted_majority").otherwise("weighted_majority_consensus")
    return out.select(*V.CASE, pick("applicable").alias("applicable"), pick("score").alias("score"), pick("confidence").alias("confidence"), pick("reason").alias("reason"), source.alias("source"), F.col("d").isNotNull().alias("debated"), F.col("score").alias("majority_score"), "d.steps")


def synthesized(labels: DataFrame, votes: DataFrame, make: Factory, **call: Any) -> DataFrame:
    """Labels that were scored without a debate get a reason written from the votes' reasons; where that fails they keep theirs."""
    said = votes.groupBy(*V.CASE).agg(F.to_json(F.sort_array(F.collect_list(F.struct("teacher", "score", "reason")))).alias("__votes"))
    wanted = labels.where("score is not null and source <> 'debate_arbitration'").join(said, V.CASE)
    words = text.fill(PROMPTS["reason"], dimension=F.col("dimension"), score=F.col("score"), votes=F.col("__votes"))
    got = call_json(wanted, make, words, F.concat_ws("::", "case_id", "dimension", F.lit("reason")), **call)
    new = got.select(*V.CASE, F.nullif(pystrip(jsonx.field(F.col("json"), "reason")), F.lit("")).alias("__reason"))
    return labels.join(new, V.CASE, "left").withColumn("reason", F.coalesce("__reason", "reason")).drop("__reason")


def evaluate(
    df: DataFrame, pool: DataFrame, teachers: dict[str, Factory], arbiter: Factory | None = None, reason: Factory | None = None, edited: bool = False, excludes: list[str] | None = None, veto: str | None = "Safety Compliance",
    threshold: int = 2, max_dims: int = 6, limit_cases: int | None = None, folder: str | None = None, **call: Any,
) -> dict[str, DataFrame]:
    """``votes``, ``conflicts``, ``labels`` and ``cases`` of seed rows; one teacher scores alone, several vote and may debate.

    Edited images have no veto and no excluded groups. A case for which no call succeeded has no labels and no overall score.
    """
    rows = cases(df, edited)
    if limit_cases is not None:
        rows = rows.orderBy(POS).limit(limit_cases)
    context = F.concat(F.lit("Edit: " if edited else "Prompt: "), F.col("instruction"))
    votes = teacher_votes(rows, pool, teachers, context, **call)
    spread = V.conflicts(votes, threshold, max_dims) if len(teachers) > 1 else V.conflicts(votes.where("false"))
    if len(teachers) == 1:
        labels = single_labels(votes)
    else:
        labels = debated_labels(votes, debates(rows, votes, spread, pool, arbiter, context, **call) if arbiter else None)
    if reason:
        labels = synthesized(labels, votes, reason, **call)
    labels = with_l1(labels, pool)
    scores = V.overall(labels, None if edited else excludes, None if edited else veto)
    groups = V.group_scores(labels).groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l1", "score")))).alias("l1_scores"))
    counted = labels.groupBy("case_id").agg(F.count_if("debated").alias("n_debated"))
    found = rows.join(scores, "case_id", "left").join(groups, "case_id", "left").join(counted, "case_id", "left").withColumn("n_debated", F.coalesce("n_debated", F.lit(0)))
    labels = labels.join(found.select("case_id", F.col("overall").alias("case_overall")), "case_id")
    done = found.withColumn("error", F.lit(None).cast("string"))
    if folder:
        V.artifacts(votes.drop("_vpos"), spread, labels, done.drop(POS), folder)
    return {"votes": votes, "conflicts": spread, "labels": labels, "cases": done}
