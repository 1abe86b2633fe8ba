"""Builders of training data: projections, filters and deduplication of finished rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import POS, coalesce_columns, first_truthy, rest_as_json, truthy, with_pos
from ..functions.text import total_length, user_parts
from .joins import by_language
from .select import REWRITE_THRESHOLDS, best_trajectory, keep_first, preference_pairs, valid_length


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def chat(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """System (if there is one), user and assistant messages."""
    two = [message("user", user), message("assistant", assistant)]
    if system is None:
        return F.array(*two)
    return F.when(truthy(system), F.array(message("system", system), *two)).otherwise(F.array(*two))


def sft(
    df: DataFrame, instruction_key: str = "instruction", response_key: str | None = None, system: Column | None = None, min_length: int = 0, max_length: int | None = None,
    skip_empty: bool = True, dedup: str | list[str] | None = None, model: str = "pipeline", source: str = "teacher_model",
) -> DataFrame:
    """messages and metadata (JSON) of rows with an answer of valid length.

    The answer is the first truthy of response and output. ``dedup`` keeps the first row of each key, after the length
    filter: ``instruction``, ``response``, their names joined by ``_``, or a list of any column names.
    """
    df = with_pos(df)
    answer = coalesce_columns(df, *([response_key] if response_key else ["response", "output"]))
    asked = F.col(instruction_key).cast("string")
    if system is None and "system" in df.columns:
        system = F.col("system").cast("string")
    rows = df.withColumn("__answer", answer).where(truthy(asked) & valid_length(F.col("__answer"), min_length, max_length, skip_empty))
    if dedup:
        names = dedup.split("_") if isinstance(dedup, str) else dedup
        known = {"instruction": asked, "response": F.col("__answer")}
        rows = keep_first(rows, [known.get(n) if n in known else F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("") for n in names])
    ident = F.col("id").cast("string") if "id" in df.columns else F.col(POS).cast("string")
    used = {instruction_key, "response", "output", "system", "id", "images", "__answer", response_key or ""}
    meta = F.to_json(F.struct(F.lit(source).alias("source"), F.lit(model).alias("model"), ident.alias("request_id"), *[F.col(c) for c in df.columns if c not in used and c != POS and c not in ("source", "model", "request_id")]))
    messages = chat(asked, F.coalesce("__answer", F.lit("")), system)
    if "images" in df.columns:
        parts = F.to_json(user_parts(asked, F.coalesce("images", F.array().cast("array<string>"))))
        messages = F.when(F.size("images") > 0, chat(parts, F.coalesce("__answer", F.lit("")), system)).otherwise(messages)
    return rows.select(POS, messages.alias("messages"), meta.alias("metadata"))


def rewrite_sft(df: DataFrame, prompts: dict[str, str], default: str | None = None, **options) -> DataFrame:
    """SFT rows of rewritten prompts: the system prompt by the row's language, scores and trace left out of the metadata."""
    drop = [c for c in df.columns if c == "agent_trace" or c in REWRITE_THRESHOLDS or c.endswith("_score")]
    language = F.col("language") if "language" in df.columns else F.lit("")
    return sft(df.withColumn("__system", by_language(language, prompts, default)).drop("system", *drop).withColumnRenamed("__system", "system"), **options)


def trajectory_sft(df: DataFrame, use_rubrics: bool = False, min_length: int = 0, max_length: int | None = None) -> DataFrame:
    """The best rollout of each row as messages, its total length in bounds."""
    df = with_pos(df).withColumn("__best", best_trajectory(df, use_rubrics=use_rubrics)).where("__best is not null")
    n = total_length(F.col("__best.trajectory"))
    ok = (n >= min_length) & (n > 0) if max_length is None else n.between(max(1, min_length), max_length)
    keep = [c for c in ("id", "task", "tools", "restriction", "task_background") if c in df.columns]
    meta = F.to_json(F.struct(F.lit("agent").alias("source"), *keep, F.col("__best.solution_id").alias("solution_id")))
    return df.where(ok).select(POS, F.col("__best.trajectory").alias("messages"), meta.alias("metadata"))


def search_sft(df: DataFrame, min_length: int = 0, max_length: int | None = None) -> DataFrame:
    """Every selected rollout of each row as messages, with the task's lineage."""
    df = with_pos(df)
    keep = [c for c in ("id", "seed_id", "question", "answer", "answer_aliases", "difficulty", "evolve_level", "n_layers", "accuracy", "avg_turns") if c in df.columns]
    rows = df.select(POS, *keep, F.posexplode("trajectories").alias("__n", "t"))
    n = total_length(F.col("t.trajectory"))
    ok = (n >= max(1, min_length)) if max_length is None else n.between(max(1, min_length), max_length)
    meta = F.to_json(F.struct(F.lit("search_agent").alias("source"), *keep, F.col("t.solution_id").alias("solution_id"), F.col("t.turns").alias("turns")))
    return rows.where(ok).select(POS, "__n", F.col("t.trajectory").alias("messages"), meta.alias("metadata"))


def media_sft(df: DataFrame, urls: str = "image_urls", prompt: str = "prompt", kind: str = "image", min_prompt: int = 0, scores: list[str] | None = None) -> DataFrame:
    """Prompt and first URL as messages, of rows that have both; score columns go to the metadata where present."""
    df = with_pos(df)
    rows = df.where(truthy(F.col(prompt)) & (F.coalesce(F.size(urls), F.lit(0)) > 0) & (F.length(prompt) >= min_prompt))
    url = F.element_at(F.col(urls), 1)
    answer = F.to_json(F.array(F.struct(F.lit(f"{kind}_url").alias("type"), url.alias("url"))))
    asked = F.col(prompt)
    if kind == "video" and "first_frame_image" in df.columns:
        asked = F.when(truthy(F.col("first_frame_image")), F.to_json(user_parts(F.col(prompt), F.array("first_frame_image")))).otherwise(asked)
    keep = [c for c in ("id", *(scores or [])) if c in df.columns]
    return rows.select(POS, F.array(message("user", asked), message("assistant", answer)).alias("messages"), F.to_json(F.struct(F.lit(kind).alias("source"), *keep)).alias("metadata"))


FORMATS = ("llama_factory_alpaca", "llama_factory_sharegpt", "openai_messages")


def preference(df: DataFrame, form: str = FORMATS[0], instruction_key: str = "instruction", min_length: int = 0, max_length: int | None = None, skip_empty: bool = True) -> DataFrame:
    """Chosen and rejected answers, both of valid length, in one of three formats."""
    df = with_pos(df)
    ok = valid_length(F.col("chosen"), min_length, max_length, skip_empty) & valid_length(F.col("rejected"), min_length, max_length, skip_empty)
    rows = df.where(ok)
    system = F.col("system").cast("string") if "system" in df.columns else F.lit(None).cast("string")
    asked, good, bad = F.col(instruction_key), F.col("chosen"), F.col("rejected")
    if form == "llama_factory_alpaca":
        return rows.select(POS, asked.alias("instruction"), F.lit("").alias("input"), good.alias("chosen"), bad.alias("rejected"), *([F.coalesce(system, F.lit("")).alias("system")] if "system" in df.columns else []))
    if form == "llama_factory_sharegpt":
        said = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
        turns = F.when(truthy(system), F.array(said("system", system), said("human", asked))).otherwise(F.array(said("human", asked)))
        return rows.select(POS, turns.alias("conversations"), said("gpt", good).alias("chosen"), said("gpt", bad).alias("rejected"))
    if form == "openai_messages":
        prompt = F.when(truthy(system), F.array(message("system", system), message("user", asked))).otherwise(F.array(message("user", asked)))
        return rows.select(POS, prompt.alias("prompt"), F.array(message("assistant", good)).alias("chosen"), F.array(message("assistant", bad)).alias("rejected"))
    raise ValueError(f"format {form} is none of {', '.join(FORMATS)}")


def agent_preference(df: DataFrame, form: str = FORMATS[0], **options) -> DataFrame:
    """Preference rows of rollouts: the named best scores 1, the others 0."""
    text = F.transform("trajectories", lambda t: F.to_json(t["trajectory"]))
    scores = F.transform("trajectories", lambda t: F.when(t["solution_id"] == F.col("best_solution_id"), 1.0).otherwise(0.0))
    rows = df.where(truthy(F.col("best_solution_id"))).withColumn("candidates", text).withColumn("candidate_scores", scores)
    asked = first_truthy(*(F.col(c) for c in ("fuzzy_task", "task") if c in df.columns))
    return preference(preference_pairs(rows.withColumn("instruction", asked), min_margin=0.5), form, **options)


def synthesis_output(df: DataFrame) -> DataFrame:
    """Plain texts as ``instruction``, pairs as ``instruction`` and ``response``, other rows as they are."""
    if set(df.columns) - {POS} == {"text"}:
        return df.withColumnRenamed("text", "instruction")
    return df


def packed_metadata(df: DataFrame, but: set[str]) -> DataFrame:
    return df.withColumn("metadata", rest_as_json(df, but))
