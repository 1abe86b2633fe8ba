"""Pipelines put together of stages: which stages a pipeline takes and which may be its last, each stage's own output, and what is left when one fails.

A stage takes and gives a frame. Frames between stages that call no model stay lazy unless a stage's output is asked
for; where one fails, the last stage's rows are written beside the final output, and the failure is raised again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import POS, with_pos
from ..operators import agents, builders, generate, judges, select
from ..operators.model import Factory
from ..sources import loaders
from ..sources.jsonl import write_jsonl
from ..streaming.incremental import resumed

Stage = Callable[..., DataFrame]


def _strings(df: DataFrame, key: str) -> DataFrame:
    return df if set(df.columns) <= {POS, "text"} else loaders.strings(df, key)


def _generated(df: DataFrame, make: Factory, workers: int = 1, **options: Any) -> DataFrame:
    rows = loaders.multimodal_inputs(df) if "images" in df.columns else loaders.instruction_rows(df)
    return generate.generate(rows, make, workers=workers, **options)


def _filter(metrics: list[str]) -> Stage:
    def run(df: DataFrame, make: Factory | None = None, thresholds: dict | None = None, keep_top_k: int | None = None, keep_top_ratio: float | None = None, require_all: bool = True, metrics: list[str] = metrics) -> DataFrame:
        if thresholds:
            df = select.quality_filter(df, thresholds, require_all)
        return select.top_k(df, metrics, keep_top_k, keep_top_ratio) if keep_top_k is not None or keep_top_ratio is not None else df

    return run


def _judge(metrics: list[str]) -> Stage:
    def run(df: DataFrame, make: Factory, metrics: list[str] = metrics, **options: Any) -> DataFrame:
        return judges.judge_metrics(judges.eval_input(with_pos(df)), make, metrics, **options)

    return run


def _judge_media(kind: str, metrics: list[str]) -> Stage:
    def run(df: DataFrame, make: Factory, metrics: list[str] = metrics, **options: Any) -> DataFrame:
        from . import jobs

        return jobs.media_eval(df, make, metrics, f"{kind}_urls", **options)

    return run


def _jobs(name: str, **fixed: Any) -> Stage:
    def run(df: DataFrame, make: Factory | None = None, **options: Any) -> DataFrame:
        from . import jobs

        return getattr(jobs, name)(df, make, **(fixed | options))

    return run


def _sft(df: DataFrame, make: Factory | None = None, **options: Any) -> DataFrame:
    return builders.sft(df, **options)


def _scored(df: DataFrame, make: Factory, scorer: str = "judge", **options: Any) -> DataFrame:
    return judges.cot_scores(df, **options) if scorer == "cot" else judges.judge_candidates(df, make, **options)


_SYNTHESIS: dict[str, Stage] = {
    "instruction_expansion": lambda df, make, **o: builders.synthesis_output(generate.expand(_strings(df, "instruction"), make, **o)),
    "instruction_refinement": lambda df, make, **o: builders.synthesis_output(generate.refine(_strings(df, "instruction"), make, **o)),
    "instruction_response_extraction": lambda df, make=None, **o: generate.extract_pairs(_strings(df, "text"), make, **o),
    "instruction_balance": lambda df, make, distribution, seed=42, total=None, workers=1: select.balance(judges.classify(loaders.instruction_rows(df), make, list(distribution), workers), distribution, seed=seed, total=total),
}
_INSTRUCT = _SYNTHESIS | {"generate": _generated, "instruct_eval": _judge(judges.INSTRUCT), "quality_filter": _filter(judges.INSTRUCT), "build_sft": _sft}
_COT: dict[str, Stage] = {
    "cot_distill": lambda df, make, **o: generate.reason(loaders.multimodal_inputs(df).withColumnRenamed("instruction", "problem") if "images" in df.columns else loaders.problems(df), make, **o),
    "cot_long2short": lambda df, make, **o: generate.resize(judges.reasoned_pairs(df), make, False, **o),
    "cot_short2long": lambda df, make, **o: generate.resize(judges.reasoned_pairs(df), make, True, **o),
    "cot_eval": _judge(judges.COT),
    # what the mixer needs is judged whatever else is asked for
    "cot_rvcd_score": lambda df, make, metrics=(), **o: _judge(judges.COT)(df, make, metrics=judges.required(list(metrics), judges.COT), **o),
    "cot_mix_by_rv_cd": lambda df, make=None, **o: select.mix_by_difficulty(df, **o),
    "quality_filter": _filter(judges.COT),
    "build_sft": _sft,
    "build_preference_dataset": lambda df, make=None, **o: builders.preference(df, **o),
}


def _media_stages(kind: str, metrics: list[str]) -> dict[str, Stage]:
    return {
        "prompt_optimize": _jobs("media_prompts", kind=kind),
        "generate": _jobs("media_generation", kind=kind),
        "eval": _judge_media(kind, metrics),
        "quality_filter": _filter(metrics),
        f"build_{'t2i' if kind == 'image' else 't2v'}_sft": lambda df, make=None, **o: builders.media_sft(df, f"{kind}_urls", kind=kind, **o),
    }


#: By pipeline: its stages, and those that may be the last.
PIPELINES: dict[str, tuple[dict[str, Stage], tuple[str, ...]]] = {
    "advanced_instruct_distill": (_INSTRUCT, ("build_sft",)),
    "balanced_instruct_distill": (_INSTRUCT, ("build_sft",)),
    "augmented_instruct_distill": (_SYNTHESIS | {"instruct_distill": lambda df, make, workers=1, **o: builders.sft(_generated(df, make, workers), **o)}, ("instruct_distill",)),
    "advanced_cot_distill": (_COT, ("build_sft",)),
    "advanced_mm_distill": ({k: v for k, v in _INSTRUCT.items() if k not in _SYNTHESIS} | {"mm_eval": _judge(judges.INSTRUCT)}, ("build_sft",)),
    "advanced_mm_cot_distill": (_COT | {"mm_cot_eval": _judge(judges.COT)}, ("build_sft",)),
    "dpo_data_build": (
        {
            "generate_candidates": lambda df, make, **o: judges.candidates(loaders.instruction_rows(df), make, **o),
            "score_candidates": _scored,
            "build_preference_pairs": lambda df, make=None, **o: select.preference_pairs(df, **o),
            "build_preference_dataset": lambda df, make=None, **o: builders.preference(df, **o),
        },
        ("build_preference_dataset",),
    ),
    "pe_rewrite_distill": (
        {
            "seed_anchored_expansion": lambda df, make, **o: generate.expand_seeds(loaders.seeds(df), make, **o),
            "agentic_rewrite": lambda df, make, **o: generate.rewrite(df, make, **o),
            "pe_rewrite_eval": lambda df, make, **o: judges.judge_rewrites(df, make, **o),
            "quality_filter": lambda df, make=None, **o: select.rewrite_filter(df, **o),
            "build_sft": lambda df, make=None, prompts=None, **o: builders.rewrite_sft(df, prompts or {}, **o),
        },
        ("build_sft",),
    ),
    "agent_distill": (
        {
            "task_synthesis": agents.synthesize_tasks, "fuzzy_task": agents.blur_tasks, "tool_check": agents.check_tools, "trajectory": agents.rollouts, "rubrics": agents.judge_rubrics, "quality_filter": _filter([]),
            "build_sft": lambda df, make=None, **o: builders.trajectory_sft(df, **o), "build_preference_dataset": lambda df, make=None, **o: builders.agent_preference(df, **o),
        },
        ("build_sft", "build_preference_dataset"),
    ),
    "search_agent_distill": (
        {
            "search_task_evolve": lambda df, make, **o: agents.evolve_tasks(loaders.search_seeds(df), make, **o), "search_trajectory": agents.search_rollouts,
            "search_judge_filter": lambda df, make=None, **o: select.judge_filter(df, **o), "quality_filter": _filter([]), "build_sft": lambda df, make=None, **o: builders.search_sft(df, **o),
        },
        ("build_sft",),
    ),
    "advanced_t2i_distill": (_media_stages("image", judges.IMAGE), ("build_t2i_sft",)),
    "advanced_t2v_distill": (_media_stages("video", judges.VIDEO), ("build_t2v_sft",)),
}

#: Stages whose rows an earlier output can stand in for, by what makes such a row complete.
RESUMABLE = {"advanced_t2v_distill": {"prompt_optimize": "optimize", "generate": "generate", "eval": "eval"}}


def check(pipeline: str, stages: list[dict[str, Any]]) -> None:
    """Raises unless the stages are some, all known, and the last one may be last."""
    if pipeline not in PIPELINES:
        raise ValueError(f"pipeline {pipeline} is none of {', '.join(sorted(PIPELINES))}")
    known, last = PIPELINES[pipeline]
    if not stages:
        raise ValueError("a pipeline needs at least one stage")
    if stages[-1].get("stage") not in last:
        raise ValueError(f"the last stage of {pipeline} must be {' or '.join(last)}")
    for s in stages:
        if s.get("stage") not in known:
            raise ValueError(f"stage {s.get('stage')} is none of {', '.join(known)}")


def run(pipeline: str, df: DataFrame, make: Factory | dict[str, Factory] | None, stages: list[dict[str, Any]], output: str | None = None) -> DataFrame:
    """The last stage's rows. A stage is ``stage``, maybe ``config`` (its options), ``output_path`` (its rows as JSON lines) and ``resume``.

    ``make`` may give each stage a backend of its own by name, others taking that of ''. With ``resume`` the rows that a
    stage's earlier output has complete aren't worked on again. With ``output`` the result is written there, and if a stage
    fails, the rows before it to ``<output>.recovery.stage_<number>.<name>.jsonl``.
    """
    check(pipeline, stages)
    known = PIPELINES[pipeline][0]
    for number, s in enumerate(stages):
        name, options, path = s["stage"], dict(s.get("config") or {}), s.get("output_path")
        backend = make.get(name, make.get("")) if isinstance(make, dict) else make
        try:
            work = lambda rows, f=known[name], b=backend, o=options: f(rows, b, **o)
            kind = RESUMABLE.get(pipeline, {}).get(name)
            if s.get("resume") and not (kind and path):
                raise ValueError(f"stage {name} can't be resumed" if not kind else f"to resume stage {name} takes an output_path")
            new = resumed(df, work, path, kind) if s.get("resume") else work(df)
            if path and not s.get("resume"):
                write_jsonl(new, path)
            if number == len(stages) - 1 and output:
                write_jsonl(new, output)
        except Exception:
            if output:
                write_jsonl(df, f"{output}.recovery.stage_{number}.{name}.jsonl")
            raise
        df = new
    return df
