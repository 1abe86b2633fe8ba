"""Whole jobs by name: loader, operators and builder of each composed to one lazy plan around its model calls.

A job takes rows and a backend factory and gives rows. ``options`` of a job are
keyword arguments, named as in its function; unknown jobs and options raise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rows import POS, first_truthy, pystrip, truthy, with_pos
from ..operators import agents, builders, generate, imageeval, judges, select, video
from ..operators.builders import message
from ..operators.model import Factory, call_model
from ..operators.votes import training_bins
from ..sources import loaders
from . import stages as pipelines

JOBS: dict[str, Callable[..., DataFrame]] = {}


def _job(*names: str, **fixed: Any):
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in names:
            JOBS[n] = (lambda df, make=None, **o: f(df, make, **(fixed | o))) if fixed else f
        return f

    return put


def run(job: str, df: DataFrame, make: Factory | None = None, **options: Any) -> DataFrame:
    """The job's result rows. A pipeline's job takes its ``stages``, too, as :func:`stages.run` does; without them it has a fixed order."""
    if job not in JOBS:
        raise ValueError(f"job {job} is none of {', '.join(sorted(JOBS))}")
    if "stages" in options:
        return pipelines.run(job, df, make, options.pop("stages"), **options)
    return JOBS[job](df, make, **options)


def _kept(df: DataFrame, thresholds: dict | None, metrics: list[str], k: int | None, fraction: float | None) -> DataFrame:
    if thresholds:
        df = select.quality_filter(df, thresholds)
    return select.top_k(df, metrics, k, fraction) if k is not None or fraction is not None else df


def _judged(df: DataFrame, make: Factory, metrics: list[str], workers: int) -> DataFrame:
    return judges.judge_metrics(judges.eval_input(df), make, metrics, workers=workers)


@_job("instruct_distill")
def distill(df: DataFrame, make: Factory, workers: int = 1, **sft: Any) -> DataFrame:
    return builders.sft(generate.generate(loaders.requests(df), make, workers=workers), **sft)


@_job("mm_instruct_distill")
def mm_distill(df: DataFrame, make: Factory, workers: int = 1, **sft: Any) -> DataFrame:
    return builders.sft(generate.generate(loaders.multimodal_inputs(df), make, workers=workers), **sft)


@_job("instruction_expansion")
def expansion(df: DataFrame, make: Factory, **options: Any) -> DataFrame:
    return builders.synthesis_output(generate.expand(loaders.strings(df), make, **options))


@_job("seed_anchored_expansion")
def seed_expansion(df: DataFrame, make: Factory, **options: Any) -> DataFrame:
    return generate.expand_seeds(loaders.seeds(df), make, **options)


@_job("agentic_rewrite")
def rewriting(df: DataFrame, make: Factory, **options: Any) -> DataFrame:
    return generate.rewrite(loaders.instruction_rows(df), make, **options)


@_job("instruction_refinement")
def refinement(df: DataFrame, make: Factory, key: str = "instruction", **options: Any) -> DataFrame:
    return builders.synthesis_output(generate.refine(loaders.strings(df, key), make, **options))


@_job("instruction_response_extraction")
def extraction(df: DataFrame, make: Factory | None = None, key: str = "text", **options: Any) -> DataFrame:
    return generate.extract_pairs(loaders.strings(df, key), make, **options)


@_job("augmented_instruct_distill")
def augmented(df: DataFrame, make: Factory, outputs: int = 10, k: int = 3, seed: int = 0, refine: bool = False, distribution: dict[str, float] | None = None, workers: int = 1, **sft: Any) -> DataFrame:
    new = generate.expand(loaders.strings(df), make, outputs, k, seed, workers)
    new = builders.synthesis_output(generate.refine(new, make, workers) if refine else new)
    if distribution:
        new = select.balance(judges.classify(loaders.seeds(new), make, list(distribution), workers), distribution)
    return builders.sft(generate.generate(new, make, workers=workers), **sft)


@_job("balanced_instruct_distill")
def balanced(df: DataFrame, make: Factory, distribution: dict[str, float], seed: int = 42, expand: dict | None = None, workers: int = 1, **sft: Any) -> DataFrame:
    rows = loaders.seeds(df) if expand is None else loaders.seeds(builders.synthesis_output(generate.expand(loaders.strings(df), make, workers=workers, **expand)))
    sorted_in = judges.classify(rows, make, list(distribution), workers)
    return builders.sft(generate.generate(select.balance(sorted_in, distribution, seed=seed), make, workers=workers), **sft)


@_job("advanced_instruct_distill")
@_job("advanced_mm_distill", multimodal=True)
def advanced(
    df: DataFrame, make: Factory, multimodal: bool = False, expand: dict | None = None, refine: bool = False, distribution: dict[str, float] | None = None, metrics: list[str] | None = None, thresholds: dict | None = None,
    keep_top_k: int | None = None, keep_top_ratio: float | None = None, workers: int = 1, **sft: Any,
) -> DataFrame:
    """Instructions, maybe expanded, refined and balanced, answered, judged, filtered and built."""
    rows = loaders.multimodal_inputs(df) if multimodal else loaders.seeds(df)
    if expand is not None:
        rows = loaders.seeds(builders.synthesis_output(generate.expand(loaders.strings(rows), make, workers=workers, **expand)))
    if refine:
        rows = loaders.seeds(builders.synthesis_output(generate.refine(loaders.strings(rows), make, workers)))
    if distribution:
        rows = select.balance(judges.classify(rows, make, list(distribution), workers), distribution)
    metrics = metrics or judges.INSTRUCT
    got = _judged(generate.generate(rows, make, workers=workers), make, metrics, workers)
    return builders.sft(_kept(got, thresholds, metrics, keep_top_k, keep_top_ratio), **sft)


@_job("cot_distill")
@_job("mm_cot_distill", multimodal=True)
def cot(df: DataFrame, make: Factory, multimodal: bool = False, workers: int = 1, **sft: Any) -> DataFrame:
    rows = loaders.multimodal_inputs(df).withColumnRenamed("instruction", "problem") if multimodal else loaders.problems(df)
    return builders.sft(generate.reason(rows, make, workers), **sft)


@_job("cot_long2short", longer=False)
@_job("cot_short2long", longer=True)
@_job("mm_cot_long2short", longer=False, multimodal=True)
@_job("mm_cot_short2long", longer=True, multimodal=True)
def resized(df: DataFrame, make: Factory, longer: bool, multimodal: bool = False, **options: Any) -> DataFrame:
    return generate.resize(loaders.problem_answer_pairs(df, multimodal=multimodal), make, longer, **options)


@_job("advanced_cot_distill", "advanced_mm_cot_distill")
def advanced_cot(df: DataFrame, make: Factory, mix: dict | None = None, thresholds: dict | None = None, keep_top_k: int | None = None, keep_top_ratio: float | None = None, workers: int = 1, **sft: Any) -> DataFrame:
    """Reasoned, judged for verbosity, difficulty and correctness, then mixed by difficulty (``mix`` given) or filtered."""
    rows = loaders.multimodal_inputs(df).withColumnRenamed("instruction", "problem") if "images" in df.columns else loaders.problems(df)
    got = _judged(generate.reason(rows, make, workers), make, judges.COT, workers)
    got = select.mix_by_difficulty(got, **mix) if mix is not None else _kept(got, thresholds, judges.COT, keep_top_k, keep_top_ratio)
    return builders.sft(got, **sft)


@_job("instruct_eval", metrics=judges.INSTRUCT)
@_job("cot_eval", metrics=judges.COT)
@_job("mm_instruct_eval", metrics=judges.INSTRUCT, multimodal=True)
@_job("mm_cot_eval", metrics=judges.COT, multimodal=True)
def evaluation(df: DataFrame, make: Factory, metrics: list[str], multimodal: bool = False, **options: Any) -> DataFrame:
    return judges.judge_metrics(loaders.eval_samples(df, multimodal=multimodal), make, metrics, **options)


@_job("t2v_eval")
def video_eval(df: DataFrame, make: Factory | None = None, checkers: list[video.Checker] | None = None, metrics: list[str] | None = None, **call: Any) -> DataFrame:
    """Videos through a chain of checkers, by default one judge of frames."""
    return video.check_videos(df, [video.frame_checker(make, metrics, **call)] if checkers is None else checkers)


def _image_eval(edited: bool, many: bool) -> Callable[..., DataFrame]:
    def run(df: DataFrame, make: Factory | None = None, pool: DataFrame | None = None, teachers: dict[str, Factory] | None = None, result: str = "cases", **options: Any) -> DataFrame:
        """The table ``result`` of an evaluation: cases, labels, votes or conflicts; ``bins`` for labels as training rows. ``folder`` keeps all of them."""
        teachers = teachers or ({"teacher": make} if make else {})
        if pool is None or not teachers or (many != (len(teachers) > 1)):
            raise ValueError("an evaluation takes a pool of dimensions and " + ("several teachers" if many else "one teacher"))
        bound = options.pop("export_threshold", 0.85)
        got = imageeval.evaluate(df, pool, teachers, edited=edited, **options)
        return training_bins(got["labels"], bound) if result == "bins" else got[result]

    return run


for _name, _edited, _many in (("t2i_single_model_eval", False, False), ("t2i_multi_model_eval", False, True), ("ti2i_single_model_eval", True, False), ("ti2i_multi_model_eval", True, True)):
    _job(_name)(_image_eval(_edited, _many))


@_job("t2i_eval", metrics=judges.IMAGE, urls="image_urls")
def media_eval(df: DataFrame, make: Factory, metrics: list[str], urls: str, **options: Any) -> DataFrame:
    """Judged by prompt and first URL; other columns stay."""
    rows = with_pos(df).where(truthy(F.col("prompt")) & (F.size(urls) > 0))
    seen = judges.judge_metrics(rows.select(POS, F.col("prompt").alias("instruction"), F.element_at(urls, 1).alias("output"), F.slice(urls, 1, 1).alias("images")), make, metrics, **options)
    return rows.join(seen.select(POS, *metrics), POS, "left")


@_job("pe_rewrite_eval")
def rewrite_eval(df: DataFrame, make: Factory, **options: Any) -> DataFrame:
    return judges.judge_rewrites(df, make, **options)


@_job("pe_rewrite_filter")
def rewrite_filter(df: DataFrame, make: Factory | None = None, **options: Any) -> DataFrame:
    return select.rewrite_filter(df, **options)


@_job("pe_rewrite_build_sft")
def rewrite_build(df: DataFrame, make: Factory | None = None, prompts: dict[str, str] | None = None, **options: Any) -> DataFrame:
    return builders.rewrite_sft(df, prompts or {}, **options)


@_job("pe_rewrite_distill")
def rewrite_distill(df: DataFrame, make: Factory, rounds: int = 3, thresholds: dict | None = None, k: int | None = None, fraction: float | None = None, per_scene: bool = True, prompts: dict[str, str] | None = None, workers: int = 1) -> DataFrame:
    grown = generate.expand_seeds(loaders.seeds(df), make, rounds)
    judged = judges.judge_rewrites(generate.rewrite(grown, make, workers=workers), make, workers=workers)
    return builders.rewrite_sft(select.rewrite_filter(judged, thresholds, k, fraction, per_scene), prompts or {})


@_job("dpo_data_build")
def preference(df: DataFrame, make: Factory, n: int = 2, scorer: str = "judge", metrics: list[str] | None = None, min_margin: float = 0.0, max_pairs: int = 1, form: str = builders.FORMATS[0], workers: int = 1) -> DataFrame:
    rows = judges.candidates(loaders.instruction_rows(df), make, n, workers=workers)
    scored = judges.cot_scores(rows) if scorer == "cot" else judges.judge_candidates(rows, make, metrics, workers=workers)
    return builders.preference(select.preference_pairs(scored, min_margin, max_pairs), form)


def _media(df: DataFrame, make: Factory, kind: str, workers: int, **options: Any) -> DataFrame:
    """Rows with ``image_urls`` or ``video_urls``; failed ones are dropped. A row's own first frame, resolution and ratio go before the options."""
    value = lambda v: F.lit(v) if isinstance(v, str | int | float) else F.parse_json(F.lit(json.dumps(v)))
    given = {k: value(v) for k, v in options.items() if v is not None}
    for c in ("first_frame_image", "resolution", "ratio", "size"):
        if c in df.columns:
            own = F.nullif(F.col(c).cast("string"), F.lit(""))
            given[c] = F.coalesce(own, given[c].cast("string")) if c in given else own
    told = F.to_json(F.struct(*(v.alias(k) for k, v in given.items()))) if given else None
    got = call_model(df, make, F.array(message("user", F.col("prompt"))), F.col("id"), options=told, workers=workers).where("error is null")
    return got.withColumnRenamed("urls", f"{kind}_urls").drop("response", "prompt_tokens", "completion_tokens", "model", "error")


def _optimized(df: DataFrame, make: Factory, workers: int, prompt: str = "Write this prompt out in detail.\n\n") -> DataFrame:
    """Rows with the prompt rewritten and the old one as original_prompt; where the call fails the old one stays."""
    got = call_model(df, make, F.array(message("user", F.concat(F.lit(prompt), F.col("prompt")))), F.col("id"), workers=workers)
    return got.withColumn("original_prompt", F.col("prompt")).withColumn("prompt", F.when(truthy(F.col("response")), F.trim("response")).otherwise(F.col("prompt"))).drop("response", "urls", "prompt_tokens", "completion_tokens", "model", "error")


def _media_seeds(df: DataFrame, kind: str) -> DataFrame:
    return loaders.video_seeds(df) if kind == "video" else loaders.image_seeds(df)


_EXTRACT = {
    False: "List what the video of this prompt shows, and how it moves: a JSON object inside <answer></answer>, with aspect_ratio where the prompt implies one.\n\n{prompt}",
    True: "List what the given first frame shows (first_frame_inventory), then how the video goes on from it after the prompt; the frame counts where both differ. A JSON object inside <answer></answer>.\n\n{prompt}",
}
_COMPOSE = "Write the video's caption by this schema, inside <answer></answer>.\n\nSchema: {schema}\nDraft: {draft}\nPrompt: {prompt}"


def video_prompts(df: DataFrame, make: Factory, compose: Factory | None = None, schema: str = "subject, scene, motion, camera, style", workers: int = 1) -> DataFrame:
    """Rows with raw_prompt, draft and optimized_prompt by two calls: what the video shows (given the first frame, if there is one), then a caption of it.

    A row without a draft or caption is dropped. ``resolution`` auto takes its ratio from the draft, unless the row has one or a
    first frame.
    """
    df = with_pos(df)
    frame = truthy(F.col("first_frame_image")) if "first_frame_image" in df.columns else F.lit(False)
    words = F.when(frame, text.fill(_EXTRACT[True], prompt=F.col("prompt"))).otherwise(text.fill(_EXTRACT[False], prompt=F.col("prompt")))
    seen = F.when(frame, F.to_json(text.user_parts(words, F.array("first_frame_image")))).otherwise(words) if "first_frame_image" in df.columns else words
    tidy = lambda got: got.drop("response", "urls", "prompt_tokens", "completion_tokens", "model", "error")
    tagged = first_truthy(text.first_tag(F.col("response"), "answer"), pystrip(F.col("response")))
    got = call_model(df.where(truthy(F.col("prompt"))), make, F.array(message("user", seen)), F.col("id"), options={"max_tokens": 1024}, workers=workers)
    got = tidy(got.withColumn("draft", tagged)).where("draft is not null").withColumnRenamed("prompt", "raw_prompt")
    if "resolution" in got.columns:
        auto = F.coalesce((F.lower("resolution") == "auto") & ~frame, F.lit(False))
        have = F.col("ratio") if "ratio" in got.columns else F.lit(None).cast("string")
        got = got.withColumn("ratio", F.when(auto, F.coalesce(F.nullif(have, F.lit("")), text.aspect_ratio(F.col("draft")))).otherwise(have))
    words = text.fill(_COMPOSE, schema=F.lit(schema), draft=F.col("draft"), prompt=F.col("raw_prompt"))
    got = call_model(got, compose or make, F.array(message("user", words)), F.col("id"), options={"max_tokens": 1024}, workers=workers)
    return tidy(got.withColumn("optimized_prompt", tagged)).where("optimized_prompt is not null").withColumn("prompt", F.col("optimized_prompt"))


@_job("prompt_optimize", kind="image")
@_job("t2v_prompt_optimize", kind="video")
def media_prompts(df: DataFrame, make: Factory, kind: str, workers: int = 1, **options: Any) -> DataFrame:
    return video_prompts(_media_seeds(df, kind), make, workers=workers, **options) if kind == "video" else _optimized(_media_seeds(df, kind), make, workers)


@_job("t2i_generation", kind="image")
@_job("t2v_generation", kind="video")
def media_generation(df: DataFrame, make: Factory, kind: str, workers: int = 1, frames: str = "off", min_edge: int = 256, max_aspect: float = 3.0, **options: Any) -> DataFrame:
    """Rows with URLs of what was made; ``frames`` says what becomes of videos' first frames that are out of bounds."""
    rows = _media_seeds(df, kind)
    extra = [c for c in ("raw_prompt", "draft", "optimized_prompt") if c in df.columns and c not in rows.columns]
    if extra:
        rows = rows.join(with_pos(df, dense=True).select(POS, *extra), POS, "left")
    return _media(video.check_first_frames(rows, frames, min_edge, max_aspect) if kind == "video" else rows, make, kind, workers, **options)


@_job("t2i_distill", kind="image")
@_job("t2v_distill", kind="video")
def media_distill(df: DataFrame, make: Factory, kind: str, workers: int = 1, min_prompt: int = 0) -> DataFrame:
    return builders.media_sft(media_generation(df, make, kind, workers), f"{kind}_urls", kind=kind, min_prompt=min_prompt)


@_job("advanced_t2i_distill", kind="image", metrics=judges.IMAGE)
@_job("advanced_t2v_distill", kind="video", metrics=judges.VIDEO)
def advanced_media(df: DataFrame, make: Factory, kind: str, metrics: list[str], media: Factory | None = None, thresholds: dict | None = None, keep_top_k: int | None = None, keep_top_ratio: float | None = None, workers: int = 1) -> DataFrame:
    """``make`` optimises and judges, ``media`` draws."""
    made = _media(media_prompts(df, make, kind, workers), media or make, kind, workers)
    judged = media_eval(made, make, metrics, f"{kind}_urls", workers=workers)
    return builders.media_sft(_kept(judged, thresholds, metrics, keep_top_k, keep_top_ratio), f"{kind}_urls", kind=kind, scores=metrics)


@_job("agent_distill")
def agent(df: DataFrame, make: Factory, repeat: int = 2, max_steps: int = 10, use_rubrics: bool = True, preference: bool = False, workers: int = 1) -> DataFrame:
    tasks = agents.check_tools(agents.blur_tasks(agents.synthesize_tasks(df, make, workers=workers), make, workers), make, workers)
    runs = agents.judge_rubrics(agents.rollouts(tasks, make, repeat, max_steps, workers=workers), make, workers=workers)
    return builders.agent_preference(runs) if preference else builders.trajectory_sft(runs, use_rubrics)


@_job("search_agent_distill")
def search_agent(df: DataFrame, make: Factory, repeat: int = 2, strategy: str = "correct_shortest", workers: int = 2, **limits: Any) -> DataFrame:
    tasks = agents.evolve_tasks(loaders.search_seeds(df), make, workers=workers, **limits)
    return builders.search_sft(select.judge_filter(agents.search_rollouts(tasks, make, repeat, workers=workers), strategy))
