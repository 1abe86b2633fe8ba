"""Judges: sample by metric fan-out or one call for all metrics, scores parsed and put back as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..functions.rows import POS, first_truthy, pystrip, truthy, with_pos
from .builders import message
from .joins import fan_metrics, pivot_metrics
from .model import Factory, call_model

INSTRUCT = ["informativeness", "helpfulness", "generalization", "correctness"]
COT = ["reasoning_verbosity", "cognitive_difficulty", "logical_correctness"]
IMAGE = ["prompt_consistency", "aesthetic_quality", "detail_richness", "artifact_absence"]
VIDEO = ["prompt_consistency", "visual_quality", "subject_consistency"]
TRUTHS = {"correctness", "logical_correctness"}
REWRITE_INT = ["intent_fidelity", "text_rendering_completeness", "detail_enrichment", "visual_concreteness", "compositional_coverage", "scene_alignment", "usability"]
REWRITE_BOOL = ["language_consistency", "no_conflict"]

_ASK = "Judge the answer below for {metric}. Give {scale} inside <score></score>.\n\nTask:\n{instruction}\n\nAnswer:\n{output}"


def _user(words: Column, df: DataFrame) -> Column:
    """A user message; with the row's images, if it has any, as content parts."""
    if "images" not in df.columns:
        return words
    return F.when(F.size("images") > 0, F.to_json(text.user_parts(words, F.col("images")))).otherwise(words)


def judge_metrics(df: DataFrame, make: Factory, metrics: list[str] | None = None, prompts: dict[str, str] | None = None, strict: bool = False, workers: int = 10, retries: int = 3) -> DataFrame:
    """Rows (id, instruction, output, maybe images) with a score column for each metric; blank samples get nulls.

    Without a list the default metrics are judged, by an empty one none. ``strict`` raises if a score can't be read.
    """
    metrics = list(INSTRUCT if metrics is None else metrics)
    df = with_pos(df)
    if not metrics:
        return df
    ok = (F.length(F.coalesce(pystrip(F.col("instruction")), F.lit(""))) > 0) & (F.length(F.coalesce(pystrip(F.col("output")), F.lit(""))) > 0)
    asked = fan_metrics(df.where(ok), metrics)
    wanted = F.lit(None).cast("string")
    for m in metrics:
        t = (prompts or {}).get(m, _ASK)
        scale = F.lit("true or false" if m in TRUTHS else "an integer from 0 to 9")
        wanted = F.when(F.col("metric") == m, text.fill(t, metric=F.lit(m), scale=scale, instruction=F.col("instruction"), output=F.col("output"))).otherwise(wanted)
    words = F.array(message("user", _user(wanted, asked)))
    got = call_model(asked.select(POS, "metric", *(c for c in ("id", "instruction", "output", "images") if c in df.columns)), make, words, F.concat_ws("::", F.col(POS).cast("string"), "metric"), options={"temperature": 0, "max_tokens": 512}, workers=workers, retries=retries)
    scored = got.withColumn("score", text.score(F.col("response")))
    if strict and not (bad := scored.where("score is null").limit(1)).isEmpty():
        raise ValueError(f"no score in: {bad.first()['response']}")
    wide = pivot_metrics(scored, metrics, [POS])
    for m in metrics:
        if m in TRUTHS:
            wide = wide.withColumn(m, F.col(m) > 0)
    return df.drop(*metrics).join(wide, POS, "left")


def judge_rewrites(df: DataFrame, make: Factory, prompt: str | None = None, workers: int = 10) -> DataFrame:
    """Rows with nine metrics of a rewritten prompt from one call each: integers 0 to 9, two truths; what can't be read is null."""
    df = with_pos(df)
    t = prompt or "Compare the rewritten prompt to the original. Answer with a JSON object of {fields}.\n\nOriginal:\n{instruction}\n\nRewritten:\n{response}"
    words = text.fill(t, fields=F.lit(", ".join(REWRITE_INT + REWRITE_BOOL)), instruction=F.col("instruction"), response=F.col("response"))
    staged = df.withColumn("__words", words).withColumnRenamed("response", "__rewritten")
    got = call_model(staged, make, F.array(message("user", F.col("__words"))), F.col(POS), options={"temperature": 0}, workers=workers).drop("__words")
    obj = jsonx.strict_object(F.col("response"))
    got = got.withColumn("__obj", obj)
    got = got.withColumns({m: jsonx.judged_int(F.col("response"), F.col("__obj"), m) for m in REWRITE_INT} | {m: jsonx.judged_bool(F.col("response"), F.col("__obj"), m) for m in REWRITE_BOOL})
    got = got.drop("__obj", "response", "urls", "prompt_tokens", "completion_tokens", "model", "error")
    return got.withColumnRenamed("__rewritten", "response")


def classify(df: DataFrame, make: Factory, categories: list[str], workers: int = 1) -> DataFrame:
    """Rows with ``category``; what can't be read is Others."""
    df = with_pos(df)
    ask = "Put the instruction into one of these categories: " + ", ".join(categories) + ". Answer inside <answer></answer>.\n\n{instruction}"
    got = call_model(df, make, F.array(message("user", text.fill(ask, instruction=F.col("instruction")))), F.col(POS), options={"temperature": 0, "max_tokens": 512}, workers=workers)
    return got.withColumn("category", F.coalesce(text.category(F.col("response"), categories), F.lit("Others"))).select(*[c for c in df.columns if c != "category"], "category")


def candidates(df: DataFrame, make: Factory, n: int = 2, key: str = "instruction", workers: int = 1) -> DataFrame:
    """Rows with ``candidates``, n answers each in request order; failed ones are left out."""
    from .joins import fan_out, gather

    df = with_pos(df)
    asked = fan_out(df.select(POS, *[c for c in ("system", "id") if c in df.columns], key), n)
    words = F.array(message("user", F.col(key))) if "system" not in df.columns else F.when(truthy(F.col("system")), F.array(message("system", F.col("system")), message("user", F.col(key)))).otherwise(F.array(message("user", F.col(key))))
    got = call_model(asked, make, words, F.concat(F.col(POS).cast("string"), F.lit("_c"), F.col("candidate_idx").cast("string")), F.col("candidate_idx"), workers=workers)
    return gather(df, got)


def judge_candidates(df: DataFrame, make: Factory, metrics: list[str] | None = None, key: str = "instruction", workers: int = 10) -> DataFrame:
    """Rows with ``candidate_scores``, each candidate's mean judged score. Blank candidates aren't judged, so a row that has any gets fewer scores."""
    from .select import mean_score

    metrics = metrics or ["helpfulness", "correctness"]
    df = with_pos(df)
    flat = df.select(F.col(POS).alias("__row"), F.col(key).alias("instruction"), F.posexplode("candidates").alias("k", "output")).where(F.length(pystrip(F.col("output"))) > 0)
    # a candidate's position is its row's and its own, which no arithmetic could hold
    judged = judge_metrics(flat.withColumn(POS, F.struct("__row", "k")), make, metrics, workers=workers)
    scores = judged.withColumn("s", F.coalesce(mean_score(judged, metrics), F.lit(0.0))).groupBy(F.col("__row").alias(POS)).agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("__s"))
    return df.join(scores, POS, "left").withColumn("candidate_scores", F.coalesce(F.transform("__s", lambda x: x["s"]), F.array().cast("array<double>"))).drop("__s")


def cot_scores(df: DataFrame, alpha: float = 0.001, normalize: bool = True, pattern: str | None = None, answer: str = "answer", tag: str = "thinking") -> DataFrame:
    """Rows with candidate_scores = correct / (1 + alpha * reasoning length) and candidate_correctness; no reference scores 0. No model is called."""
    norm = text.normal_answer if normalize else pystrip
    right = F.transform("candidates", lambda c: F.coalesce(truthy(F.col(answer).cast("string")) & (norm(text.answer_by(c, pattern)) == norm(F.col(answer).cast("string"))), F.lit(False)))
    df = df.withColumn("candidate_correctness", right)
    score = lambda c, i: F.when(F.get("candidate_correctness", i), 1.0 / (1.0 + F.lit(alpha) * text.reasoning_length(c, tag))).otherwise(0.0)
    return df.withColumn("candidate_scores", F.transform("candidates", score))


def required(metrics: list[str], needed: list[str]) -> list[str]:
    """The metrics, and after them those needed that are missing."""
    return [*metrics, *(m for m in needed if m not in metrics)]


def reasoned_pairs(df: DataFrame) -> DataFrame:
    """Problem and answer of rows as the reasoning stages make them."""
    df = with_pos(df)
    pick = lambda *n: first_truthy(*(F.col(c).cast("string") for c in n if c in df.columns))
    keep = [c for c in ("id", "images") if c in df.columns]
    return df.select(POS, *keep, pick("problem", "instruction").alias("problem"), pick("response", "answer", "output").alias("answer")).where("problem is not null and answer is not null")


def eval_input(df: DataFrame) -> DataFrame:
    """instruction and output of rows as stages make them, other columns kept."""
    pick = lambda *n: first_truthy(*(F.col(c).cast("string") for c in n if c in df.columns))
    return df.withColumn("instruction", pick("instruction", "input", "problem", "prompt")).withColumn("output", pick("output", "response", "answer"))

