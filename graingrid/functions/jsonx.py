"""JSON out of model answers.

What parses as a whole, or inside a code fence, is read by the engine's own
functions. Only the search for a balanced object inside prose isn't regular
and runs in Python, over Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.functions import pandas_udf

from .rows import pystrip


def unfenced(text: Column) -> Column:
    """What stands in the first code fence, or the whole, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:[a-zA-Z]*)\s*\n?(.*?)```", 1)
    return pystrip(F.when(text.contains("```") & (inner != ""), inner).otherwise(text))


def balanced_object(text: str | None, parse: bool = False) -> str | None:
    """The first balanced {...} of the text; with ``parse`` the first that is a JSON object."""
    if not text:
        return None
    at = text.find("{")
    while at >= 0:
        depth, inside, escaped = 0, False, False
        for k in range(at, len(text)):
            c = text[k]
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = not inside
            elif not inside:
                depth += (c == "{") - (c == "}")
                if c == "}" and not depth:
                    found = text[at : k + 1]
                    if not parse:
                        return found
                    try:
                        if isinstance(json.loads(found), dict):
                            return found
                    except ValueError:
                        pass
                    break
        else:
            if not parse:
                return None
        at = text.find("{", at + 1)
    return None


@pandas_udf(StringType())
def balanced(text: pd.Series) -> pd.Series:
    """First balanced object of each text."""
    return text.map(balanced_object)


@pandas_udf(StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    """First balanced object of each text that parses."""
    return text.map(lambda t: balanced_object(t, True))


def _object(text: Column) -> Column:
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def sliced_object(text: Column) -> Column:
    """A JSON object: the unfenced text, or its slice from the first brace to the last; null if neither parses."""
    bare = unfenced(text)
    return F.coalesce(_object(bare), _object(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))))


def strict_object(text: Column) -> Column:
    """A JSON object: whole, fenced, or the first balanced one in prose (in Python, and only where the others fail)."""
    plain = F.coalesce(_object(text), _object(unfenced(text)))
    return F.coalesce(plain, balanced_json(F.when(plain.isNull(), text)))


def block_object(text: Column) -> Column:
    """The first balanced object, without code fences around it, if that is JSON; later ones aren't looked for."""
    bare = unfenced(text)
    plain = _object(bare)
    return F.coalesce(plain, _object(balanced(F.when(plain.isNull(), bare))))


def string_field(text: Column, key: str) -> Column:
    """A string value of a perhaps cut-off object, unescaped."""
    raw = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*"((?:\\.|[^"\\])*)', 1)
    for a, b in (("\\\\n", "\n"), ("\\\\t", "\t"), ('\\\\"', '"'), ("\\\\/", "/"), ("\\\\\\\\", "\\\\")):
        raw = F.regexp_replace(raw, a, b)
    return F.when(text.rlike(rf'"{key}"\s*:\s*"'), raw)


def field(obj: Column, key: str, kind: str = "string") -> Column:
    """A field of a JSON text; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(obj), f"$.{key}", kind)


def judged_int(text: Column, obj: Column, key: str, top: int = 9) -> Column:
    """An integer score by key from the object, else salvaged from the text; null if outside 0 to top."""
    v = F.coalesce(field(obj, key, "int"), F.regexp_extract(text, rf'"{key}"\s*:\s*"?(\d+)', 1).try_cast("int"))
    return F.when(v.between(0, top), v)


def judged_bool(text: Column, obj: Column, key: str) -> Column:
    """A truth value by key: true, false, 1, 0 or those as text."""
    raw = F.lower(F.coalesce(field(obj, key), F.nullif(F.regexp_extract(text, rf'(?i)"{key}"\s*:\s*"?(true|false|1|0)', 1), F.lit(""))))
    return F.when(raw.isin("true", "1"), True).when(raw.isin("false", "0"), False)


def expansion_items(text: Column) -> Column:
    """The array of (topic, prompt) in an answer; a cut-off array up to its last item; prompts that are blank dropped."""
    bare = unfenced(text)
    start = F.regexp_extract(bare, r"(?s)(\[.*)", 1)
    closed = F.regexp_extract(start, r"(?s)(\[.*\])", 1)
    cut = F.concat(F.regexp_extract(start, r"(?s)(\[.*\})", 1), F.lit("]"))
    kind = "array<struct<topic:string,prompt:string>>"
    parsed = F.coalesce(F.from_json(closed, kind), F.from_json(cut, kind))
    plain = F.transform(F.coalesce(F.from_json(closed, "array<string>"), F.array().cast("array<string>")), lambda s: F.struct(F.lit("").alias("topic"), s.alias("prompt")))
    objects = F.filter(F.coalesce(parsed, F.array().cast(kind)), lambda x: F.coalesce(F.length(pystrip(x["prompt"])), F.lit(0)) > 0)
    strings = F.filter(plain, lambda x: (F.coalesce(F.length(pystrip(x["prompt"])), F.lit(0)) > 0) & ~x["prompt"].startswith("{"))
    clean = lambda x: F.struct(F.coalesce(pystrip(x["topic"]), F.lit("")).alias("topic"), pystrip(x["prompt"]).alias("prompt"))
    return F.transform(F.when(F.size(objects) > 0, objects).otherwise(strings), clean)


def tool_call(obj: Column) -> tuple[Column, Column]:
    """Name and arguments (JSON text) of a tool call object."""
    return field(obj, "name"), F.coalesce(F.get_json_object(obj, "$.arguments"), F.lit("{}"))


def judgment_columns(payload: Column, metrics: list[str]) -> dict[str, Column]:
    """Wide columns (score, confidence, reason) from an array of judgments; of a dimension named twice the last counts."""
    rows = F.from_json(payload, "array<struct<dimension:string,applicable:boolean,score:double,confidence:double,reason:string>>")
    out = {}
    named = lambda m: F.filter(rows, lambda x: x["dimension"] == m)
    for m in metrics:
        one = F.try_element_at(named(m), F.lit(-1))
        scored = F.when(F.coalesce(one["applicable"], F.lit(True)), clamp(one["score"]))
        out |= {m: scored, f"{m}_confidence": F.when(scored.isNotNull(), one["confidence"]), f"{m}_reason": F.when(scored.isNotNull(), one["reason"])}
    return out


def clamp(v: Column, top: int = 4) -> Column:
    """Rounded half to even and held to 0..top; null stays null."""
    x = F.bround(v.try_cast("double"), 0)
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(top), x.cast("int"))))
