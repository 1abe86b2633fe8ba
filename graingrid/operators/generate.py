"""Generating, expanding, refining and rewriting text with a model."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions import jsonx, text
from ..functions.rows import POS, first_truthy, pystrip, truthy, with_pos
from .builders import message
from .joins import fan_out
from .model import Factory, Request, call_model, with_retries
from .select import in_context_examples

PROMPTS = {
    "expand": "Write one new instruction in the manner of these.\n\n{examples}\n\nPut it inside <answer></answer>.",
    "refine": "Rewrite this instruction so that it is clear and complete. Put the result inside <answer></answer>.\n\n{text}",
    "extract": "Turn this text into an instruction and its response, inside <instruction></instruction> and <response></response>.\n\n{text}",
    "cot": "Solve the problem. Reason inside <|begin_of_thought|><|end_of_thought|>, then answer inside <|begin_of_solution|><|end_of_solution|>.\n\n{problem}",
    "shorten": "Shorten the reasoning of this answer and keep its solution.\n\nProblem:\n{problem}\n\nAnswer:\n{answer}",
    "lengthen": "Spell out the reasoning of this answer step by step.\n\nProblem:\n{problem}\n\nAnswer:\n{answer}",
    "seed_first": "Name {n} topics near this instruction, each with a prompt: a JSON array of objects with topic and prompt.\n\n{instruction}",
    "seed_next": "Name {n} more topics near this instruction, each with a prompt: a JSON array of objects with topic and prompt. Not these:\n{topics}\n\n{instruction}",
    "plan": "Plan a rewrite of this prompt: a JSON object with scene, language, intent and plan.\n\n{instruction}",
    "rewrite": "Rewrite the prompt after the plan: a JSON object with rewritten_prompt.\n\nPlan:\n{plan}\n\nPrompt:\n{instruction}",
    "reflect": "Check the rewritten prompt: a JSON object with changed and revised_prompt.\n\nPrompt:\n{instruction}\n\nRewritten:\n{draft}",
}
SCENES = (
    "general", "photographic_realism", "artistic_illustration", "design_layout", "structured_diagram", "ui_interface", "brand_commercial_ad", "narrative_panels", "cultural_heritage_art",
    "game_art_production",
)


def _ask(df: DataFrame, make: Factory, words: Column, workers: int, system: Column | None = None, **options: Any) -> DataFrame:
    msgs = F.array(message("user", words))
    if system is not None:
        msgs = F.when(truthy(system), F.array(message("system", system), message("user", words))).otherwise(msgs)
    return call_model(df, make, msgs, F.col("id") if "id" in df.columns else F.col(POS), options=options, workers=workers)


def generate(df: DataFrame, make: Factory, key: str = "instruction", workers: int = 1, on_error: str = "skip", **options: Any) -> DataFrame:
    """Rows with ``response``; failed rows are dropped, or raise."""
    df = with_pos(df).where(truthy(F.col(key)))
    words = F.when(F.size("images") > 0, F.to_json(text.user_parts(F.col(key), F.col("images")))).otherwise(F.col(key)) if "images" in df.columns else F.col(key)
    got = _ask(df, make, words, workers, F.col("system") if "system" in df.columns else None, **options)
    if on_error == "raise" and not (bad := got.where("error is not null").limit(1)).isEmpty():
        raise RuntimeError(bad.first()["error"])
    return got.where("error is null").drop("urls", "error")


def expand(pool: DataFrame, make: Factory, outputs: int = 10, k: int = 3, seed: int = 0, workers: int = 1, prompt: str | None = None) -> DataFrame:
    """New instructions, ``text``, from k examples of the pool each; an answer without tags counts whole."""
    asked = in_context_examples(pool.sparkSession.range(outputs).select(F.col("id").alias(POS)), with_pos(pool), k, seed)
    got = _ask(asked, make, text.fill(prompt or PROMPTS["expand"], examples=text.numbered_examples(F.col("examples"))), workers)
    out = F.coalesce(text.first_tag(F.col("response"), "answer"), pystrip(F.col("response")))
    return got.select(POS, out.alias("text")).where(truthy(F.col("text")))


def refine(df: DataFrame, make: Factory, workers: int = 1, prompt: str | None = None) -> DataFrame:
    got = _ask(with_pos(df), make, text.fill(prompt or PROMPTS["refine"], text=F.col("text")), workers)
    return got.select(POS, F.coalesce(text.first_tag(F.col("response"), "answer"), pystrip(F.col("response"))).alias("text")).where(truthy(F.col("text")))


def extract_pairs(df: DataFrame, make: Factory | None = None, workers: int = 1, prompt: str | None = None) -> DataFrame:
    """instruction and response from tags in the model's answer, else in the text itself; without a model from the text alone."""
    df = with_pos(df)
    pair = lambda c: (text.first_tag(c, "instruction"), text.first_tag(c, "response"))
    own = pair(F.col("text"))
    if make is None:
        a, b = own
    else:
        df = _ask(df, make, text.fill(prompt or PROMPTS["extract"], text=F.col("text")), workers)
        said = pair(F.col("response"))
        both = truthy(said[0]) & truthy(said[1])
        a, b = (F.when(both, s).otherwise(o) for s, o in zip(said, own))
    return df.select(POS, a.alias("instruction"), b.alias("response")).where(truthy(F.col("instruction")) & truthy(F.col("response")))


def reason(df: DataFrame, make: Factory, workers: int = 1, prompt: str | None = None) -> DataFrame:
    """instruction, response, thought and solution of problems (with images, if they have any)."""
    df = with_pos(df)
    words = text.fill(prompt or PROMPTS["cot"], problem=F.col("problem"))
    if "images" in df.columns:
        words = F.when(F.size("images") > 0, F.to_json(text.user_parts(words, F.col("images")))).otherwise(words)
    got = _ask(df, make, words, workers).where("error is null")
    thought, solution = text.thought_and_solution(F.col("response"))
    keep = [c for c in ("id", "images", "answer") if c in df.columns]
    return got.select(POS, *keep, F.col("problem").alias("instruction"), "response", thought.alias("thought"), solution.alias("solution"))


def resize(df: DataFrame, make: Factory, longer: bool, max_chars: int | None = None, verify: bool = False, workers: int = 1, prompt: str | None = None) -> DataFrame:
    """Problems and answers with the answer rewritten shorter or longer: sizes, ratio and, if longer, steps.

    ``max_chars`` cuts at a word; ``verify`` drops rewrites that lack the original solution's text.
    """
    df = with_pos(df)
    words = text.fill(prompt or PROMPTS["lengthen" if longer else "shorten"], problem=F.col("problem"), answer=F.col("answer"))
    if "images" in df.columns:
        words = F.when(F.size("images") > 0, F.to_json(text.user_parts(words, F.col("images")))).otherwise(words)
    got = _ask(df, make, words, workers).where("error is null").withColumn("response", pystrip(F.col("response"))).where(F.col("response") != "")
    if max_chars:
        got = got.withColumn("response", text.cut_at_word(F.col("response"), max_chars))
    if verify:
        solution = text.thought_and_solution(F.col("answer"))[1]
        got = got.where(F.coalesce(F.instr("response", solution) > 0, F.lit(True)))
    old, new = text.token_estimate(F.col("answer")), text.token_estimate(F.col("response"))
    size = [new.alias("extended_tokens"), text.ratio(new, old).alias("expansion_ratio"), text.step_count(F.col("response")).alias("step_count")] if longer else [new.alias("simplified_tokens"), text.ratio(new, old).alias("compression_ratio")]
    keep = [c for c in ("id", "images") if c in df.columns]
    return got.select(POS, *keep, F.col("problem").alias("instruction"), "response", F.col("answer").alias("original_response"), old.alias("original_tokens"), *size)


def expand_seeds(df: DataFrame, make: Factory, rounds: int = 3, per_round: int = 10, retries: int = 2) -> DataFrame:
    """Topics and prompts from each seed (id, instruction), round after round; what a round finds is told to the next.

    Rounds are sequential within a seed and seeds are parallel, so a seed is one unit of work of a partition. A round
    without any item is tried ``retries`` more times, then left out. A topic counts once a seed; empty topics always.
    """
    df = with_pos(df).withColumn("__text", pystrip(F.col("instruction"))).where(truthy(F.col("__text")))
    rows = df.select(POS, F.coalesce(F.col("id").cast("string"), F.concat(F.lit("seed_"), F.col(POS).cast("string"))).alias("id"), F.col("__text").alias("instruction"))
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [POS, "source_seed_id", "round", "item", "topic", "instruction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()
        try:
            for b in batches:
                for pos, seed, ask in zip(*(c.to_pylist() for c in b.columns)):
                    seen: list[str] = []
                    out: list[tuple] = []
                    for r in range(rounds):
                        t = PROMPTS["seed_next" if seen else "seed_first"].replace("{n}", str(per_round)).replace("{topics}", "\n".join(f"- {s}" for s in seen)).replace("{instruction}", ask)
                        for k in range(retries + 1):
                            try:
                                got = parse_items(with_retries(lambda: backend.generate(Request([{"role": "user", "content": t}], f"{seed}_r{r}" + (f"_retry{k}" if k else ""), k, {"temperature": 0.9, "max_tokens": 4096}))).text)
                            except Exception:
                                got = []
                            if got:
                                break
                        for topic, prompt in got:
                            if topic and topic in seen:
                                continue
                            seen += [topic] if topic else []
                            out.append((pos, seed, r, len(out), topic, prompt))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
        finally:
            backend.close()

    got = checkpointed(rows.mapInArrow(run, f"{POS} long, source_seed_id string, round int, item int, topic string, instruction string"))
    return got.withColumn("id", F.concat_ws("_", "source_seed_id", F.col("round").cast("string"), F.col("item").cast("string"))).withColumn(POS, F.struct(F.col(POS).alias("seed"), "item")).drop("item")


def parse_items(answer: str | None) -> list[tuple[str, str]]:
    """(topic, prompt) items of an answer's array, also of one that is cut off."""
    bare = (answer or "").strip()
    if "```" in bare:
        bare = bare.split("```")[1].removeprefix("json").strip()
    at = bare.find("[")
    if at < 0:
        return []
    items: Any = None
    for end in (bare.rfind("]") + 1, bare.rfind("}") + 1):
        try:
            items = json.loads(bare[at:end] + ("" if bare[at:end].endswith("]") else "]"))
            break
        except ValueError:
            continue
    out = []
    for i in items if isinstance(items, list) else []:
        topic, prompt = (i.get("topic") or "", i.get("prompt") or "") if isinstance(i, dict) else ("", i if isinstance(i, str) else "")
        if str(prompt).strip():
            out.append((str(topic).strip(), str(prompt).strip()))
    return out


def rewrite(df: DataFrame, make: Factory, prompts: dict[str, str] | None = None, workers: int = 1) -> DataFrame:
    """Rows with ``response`` (the rewritten prompt), scene, language and agent_trace, by plan, rewrite and reflection.

    A failed plan falls back to the general scene and the detected language; a failed rewrite drops the row; the
    reflection replaces the draft only if it says so and has another, non-empty one.
    """
    p = PROMPTS | (prompts or {})
    df = with_pos(df).withColumn("instruction", pystrip(F.col("instruction"))).where(truthy(F.col("instruction")))
    if "id" not in df.columns:
        df = df.withColumn("id", F.concat(F.lit("row_"), F.col(POS).cast("string")))
    one = lambda got, name: got.withColumnRenamed("response", name).withColumnRenamed("error", f"{name}_error").drop("urls", "prompt_tokens", "completion_tokens", "model")
    got = one(_ask(df, make, text.fill(p["plan"], instruction=F.col("instruction")), workers, temperature=0.3), "__plan")
    obj = jsonx.sliced_object(F.col("__plan"))
    scene, language = F.lower(jsonx.field(obj, "scene")), F.lower(jsonx.field(obj, "language"))
    status = F.when(F.col("__plan_error").isNotNull(), "failed").when(obj.isNull(), "parse_failed").when(~F.coalesce(scene.isin(*SCENES), F.lit(False)), "invalid_scene").otherwise("ok")
    got = got.withColumns({"scene": F.when(scene.isin(*SCENES), scene).otherwise("general"), "language": F.when(language.isin("zh", "en"), language).otherwise(text.language(F.col("instruction"))), "__plan_status": status})
    got = one(_ask(got, make, text.fill(p["rewrite"], plan=F.col("__plan"), instruction=F.col("instruction")), workers, temperature=0.7, max_tokens=8192), "__draft")
    obj = jsonx.sliced_object(F.col("__draft"))
    whole, part = jsonx.field(obj, "rewritten_prompt"), jsonx.string_field(F.col("__draft"), "rewritten_prompt")
    status = F.when(F.col("__draft_error").isNotNull(), "failed").when(truthy(whole), "ok").when(truthy(part), "ok_salvaged").otherwise("plain_text")
    got = got.withColumn("__draft_status", status).withColumn("__text", pystrip(first_truthy(whole, part, jsonx.unfenced(F.col("__draft"))))).where((F.col("__draft_status") != "failed") & truthy(F.col("__text")))
    got = one(_ask(got, make, text.fill(p["reflect"], instruction=F.col("instruction"), draft=F.col("__text")), workers, temperature=0.3), "__reflect")
    obj = jsonx.sliced_object(F.col("__reflect"))
    changed, revised = jsonx.judged_bool(F.col("__reflect"), obj, "changed"), first_truthy(jsonx.field(obj, "revised_prompt"), jsonx.string_field(F.col("__reflect"), "revised_prompt"))
    status = F.when(F.col("__reflect_error").isNotNull(), "failed").when(obj.isNotNull(), "ok").when(changed.isNotNull(), "ok_salvaged").otherwise("parse_failed")
    final = F.when(F.coalesce(changed, F.lit(False)) & truthy(pystrip(revised)) & (revised != F.col("__text")), pystrip(revised)).otherwise(F.col("__text"))
    trace = F.struct(F.col("__plan_status").alias("plan"), F.col("__draft_status").alias("rewrite"), status.alias("reflection"), F.col("__text").alias("draft"))
    return got.withColumns({"response": final, "agent_trace": trace}).drop("__plan", "__plan_error", "__plan_status", "__draft", "__draft_error", "__draft_status", "__reflect", "__reflect_error", "__text")


def repeat(df: DataFrame, n: int, kind: str = "gen") -> DataFrame:
    """Each row n times with ids of its own."""
    return fan_out(df, n, "generation", "{id}#" + kind + "{i}").drop("id").withColumnRenamed("request_id", "id")
