"""Loaders: from rows with alias columns to the inputs of jobs, as projections and filters.

Each takes a frame (see ``jsonl.read_jsonl``) and gives one with ``_pos``.
A column that is missing and one that is null count alike; empty strings,
empty arrays and nulls are not values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import POS, coalesce_columns, existing, first_truthy, pystrip, rest_as_json, truthy, with_pos
from ..functions.text import parts_text


def _id(df: DataFrame) -> Column:
    """The row's id as text, else its number."""
    return F.coalesce(*existing(df, "id"), F.col(POS).cast("string"))


def _text_of(df: DataFrame, name: str) -> Column:
    """A column's text; content parts are flattened."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[name].dataType
    return parts_text(F.col(name)) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else F.col(name).cast("string")


def _first(df: DataFrame, *names: str) -> Column:
    return first_truthy(*(_text_of(df, n) for n in names)) if names else F.lit(None).cast("string")


def last_message(df: DataFrame, role: str) -> Column:
    """The last message's content of that role, if there are messages."""
    if "messages" not in df.columns:
        return F.lit(None).cast("string")
    return F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1))["content"]


def images_of(df: DataFrame, key: str = "images") -> Column:
    """Image references as an array: the column (one string counts as one image), else ``metadata``'s."""
    found: list[Column] = []
    if key in df.columns:
        many = isinstance(df.schema[key].dataType, T.ArrayType)
        found.append(F.when(truthy(F.col(key), df.schema[key].dataType), F.col(key) if many else F.array(F.col(key).cast("string"))))
    if "metadata" in df.columns and isinstance(df.schema["metadata"].dataType, T.StructType) and (m := df.schema["metadata"].dataType):
        for k in dict.fromkeys((key, "images")):
            if k in m.names and isinstance(m[k].dataType, T.ArrayType):
                found.append(F.when(F.size(F.col("metadata")[k]) > 0, F.col("metadata")[k]))
    return F.coalesce(*found, F.array().cast("array<string>"))


def requests(df: DataFrame, instruction_key: str = "instruction", system_prompt: str | None = None) -> DataFrame:
    """id, instruction, system and metadata (JSON of the other columns) of the rows with an instruction."""
    df = with_pos(df, dense=True)
    used = {"id", instruction_key, "system"}
    return df.where(truthy(_text_of(df, instruction_key))).select(
        POS, _id(df).alias("id"), _text_of(df, instruction_key).alias("instruction"), F.coalesce(_first(df, "system"), F.lit(system_prompt)).alias("system"), rest_as_json(df, used).alias("metadata")
    )


def strings(df: DataFrame, key: str = "instruction") -> DataFrame:
    """One text column, ``text``, of the rows that have it."""
    df = with_pos(df)
    return df.select(POS, _text_of(df, key).alias("text")).where(truthy(F.col("text")))


def seeds(df: DataFrame, key: str = "instruction") -> DataFrame:
    """id and instruction."""
    df = with_pos(df, dense=True)
    return df.select(POS, _id(df).alias("id"), _text_of(df, key).alias("instruction")).where(truthy(F.col("instruction")))


def instruction_rows(df: DataFrame, key: str = "instruction") -> DataFrame:
    """All columns, the key's renamed to instruction, ids filled in."""
    df = with_pos(df, dense=True)
    out = df.withColumn("instruction", _text_of(df, key)).withColumn("id", _id(df))
    return (out.drop(key) if key != "instruction" else out).where(truthy(F.col("instruction")))


def problems(df: DataFrame, key: str = "problem") -> DataFrame:
    df = with_pos(df, dense=True)
    return df.select(POS, _id(df).alias("id"), _first(df, key, "instruction").alias("problem")).where(truthy(F.col("problem")))


def problem_answer_pairs(df: DataFrame, problem_key: str = "problem", answer_key: str = "answer", multimodal: bool = False) -> DataFrame:
    """problem and answer, each the first value of three aliases; rows that lack one are dropped.

    ``multimodal`` also looks into messages and carries images.
    """
    df = with_pos(df, dense=True)
    p, a = _first(df, problem_key, "problem", "instruction"), _first(df, answer_key, "answer", "output")
    if multimodal:
        p, a = F.coalesce(p, F.nullif(last_message(df, "user"), F.lit(""))), F.coalesce(a, F.nullif(last_message(df, "assistant"), F.lit("")))
    out = df.select(POS, _id(df).alias("id"), p.alias("problem"), a.alias("answer"), *([images_of(df).alias("images")] if multimodal else []))
    return out.where("problem is not null and answer is not null")


def eval_samples(df: DataFrame, instruction_key: str = "instruction", response_key: str = "output", multimodal: bool = False) -> DataFrame:
    """id, instruction and output to judge; without an instruction the last user and assistant messages."""
    df = with_pos(df, dense=True)
    p, a = _first(df, instruction_key, "instruction", "input", "problem"), _first(df, response_key, "output", "response", "answer")
    alone = p.isNull()
    p = F.when(alone, F.nullif(last_message(df, "user"), F.lit(""))).otherwise(p)
    a = F.when(alone & a.isNull(), F.nullif(last_message(df, "assistant"), F.lit(""))).otherwise(a)
    images = [images_of(df).alias("images")] if multimodal or "images" in df.columns else []
    return df.select(POS, _id(df).alias("id"), p.alias("instruction"), a.alias("output"), *images).where("instruction is not null and output is not null")


def multimodal_inputs(df: DataFrame, instruction_key: str = "instruction", image_key: str = "images") -> DataFrame:
    """id, instruction, images and metadata."""
    df = with_pos(df, dense=True)
    out = df.select(POS, _id(df).alias("id"), _text_of(df, instruction_key).alias("instruction"), images_of(df, image_key).alias("images"), rest_as_json(df, {"id", instruction_key, image_key}).alias("metadata"))
    return out.where(truthy(F.col("instruction")))


def image_seeds(df: DataFrame, prompt_key: str = "prompt") -> DataFrame:
    """id, prompt and metadata of text-to-image seeds."""
    df = with_pos(df, dense=True)
    return df.select(POS, _id(df).alias("id"), _first(df, prompt_key, "instruction").alias("prompt"), rest_as_json(df, {"id", prompt_key}).alias("metadata")).where(truthy(F.col("prompt")))


def video_seeds(df: DataFrame, prompt_key: str = "prompt", frame_key: str = "first_frame_image") -> DataFrame:
    """Like :func:`image_seeds`, with first frame, resolution and ratio."""
    df = with_pos(df, dense=True)
    opt = lambda n: F.nullif(_text_of(df, n), F.lit(""))
    out = df.select(POS, _id(df).alias("id"), _first(df, prompt_key, "instruction").alias("prompt"), opt(frame_key).alias("first_frame_image"), opt("resolution").alias("resolution"), opt("ratio").alias("ratio"))
    return out.where(truthy(F.col("prompt")))


QUESTION_KEYS = ("question", "query", "problem", "instruction", "prompt")
ANSWER_KEYS = ("answer", "answers", "final_answer", "gold_answer", "target", "output")


def search_seeds(df: DataFrame) -> DataFrame:
    """id, question, answer and answer_aliases from their alias columns; a list's first non-blank value is the answer.

    The first answer column that holds anything decides, even if all it holds is blank; such rows are dropped.
    """
    df = with_pos(df, dense=True)
    lists = []
    for k in ANSWER_KEYS:
        if k in df.columns:
            many = isinstance(df.schema[k].dataType, T.ArrayType)
            values = F.transform(F.col(k), lambda x: x.cast("string")) if many else F.array(F.col(k).cast("string"))
            lists.append(F.when(truthy(F.col(k), df.schema[k].dataType), values))
    found = F.coalesce(*lists, F.array().cast("array<string>"))
    clean = F.filter(F.transform(found, pystrip), lambda x: F.coalesce(x, F.lit("")) != "")
    question = F.nullif(pystrip(coalesce_columns(df, *QUESTION_KEYS)), F.lit(""))
    ident = F.coalesce(*(F.nullif(c, F.lit("")) for c in existing(df, "id", "example_id")), F.concat(F.lit("seed_"), F.col(POS).cast("string")))
    out = df.select(POS, ident.alias("id"), question.alias("question"), F.try_element_at(clean, F.lit(1)).alias("answer"), F.slice(clean, 2, 1 << 30).alias("answer_aliases"))
    return out.where("question is not null and answer is not null")


def dimension_pool(tree: DataFrame) -> DataFrame:
    """l1, l2, l3 and criteria of a dimension tree (dimensions > l2_groups > items); nameless items are skipped.

    Of an l3 that stands below several l1 the last one counts.
    """
    from pyspark.sql import Window

    l1 = tree.select(F.posexplode("dimensions").alias("p1", "d"))
    l2 = l1.select("p1", F.col("d.name").alias("l1"), F.posexplode("d.l2_groups").alias("p2", "g"))
    rows = l2.select("p1", "p2", "l1", F.col("g.name").alias("l2"), F.posexplode("g.items").alias("p3", "i")).select("p1", "p2", "p3", "l1", "l2", F.col("i.name").alias("l3"), F.col("i.criteria").alias("criteria"))
    w = Window.partitionBy("l3").orderBy(F.desc("p1"), F.desc("p2"), F.desc("p3"))
    return rows.where(truthy(F.col("l3"))).withColumn("n", F.row_number().over(w)).where("n = 1").select("l1", "l2", "l3", "criteria")
