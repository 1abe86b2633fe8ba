"""Reading and writing JSON lines, configuration and small JSON files."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import POS, pinned, with_pos

_BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of a JSON lines file with ``_pos``; blank lines vanish, broken ones are dropped, or raise if strict.

    Give a schema at scale: without one the file is read once more to infer it.
    """
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if schema:
        if not strict:
            rows = reader.option("columnNameOfCorruptRecord", _BAD).schema(f"{schema}, {_BAD} string").json(path)
            return with_pos(rows, files=True).where(F.col(_BAD).isNull() & pinned(rows)).drop(_BAD)
        return with_pos(reader.schema(schema).json(path), files=True)
    df = with_pos(reader.option("columnNameOfCorruptRecord", _BAD).json(path), files=True)
    if _BAD not in df.columns:
        return df
    if df.columns == [_BAD, POS]:
        return df.where(F.lit(False)).drop(_BAD)
    kept = [c for c in df.columns if c != _BAD]
    # a frame that is only asked for its corrupt column can't be read; the others pin the parse
    return df.where(F.col(_BAD).isNull() & pinned(df.select(kept).drop(POS))).select(kept)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def read_json(path: str) -> Any:
    """A whole small JSON file, on the driver."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """Rows as JSON lines without helper columns, a folder of files; ``single`` makes one file in row order."""
    out = df
    if POS in df.columns:
        out = (df.coalesce(1).sortWithinPartitions(POS) if single else df).drop(POS)
    elif single:
        out = df.coalesce(1)
    out.write.mode(mode).json(path)


def alpaca(df: DataFrame, include_system: bool = True) -> DataFrame:
    """instruction and output of message rows: the last system, user and assistant texts."""
    last = lambda role: F.coalesce(F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))
    system, user = last("system"), last("user")
    instruction = F.when(system != "", F.concat(system, F.lit("\n\n"), user)).otherwise(user) if include_system else user
    return df.select(*([POS] if POS in df.columns else []), instruction.alias("instruction"), last("assistant").alias("output"))


_VAR = re.compile(r"\$(?:\{(\w+)\}|(\w+))")


def expand_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """Strings with ${NAME} and $NAME replaced, through lists and dicts; a name that isn't set raises."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            name = m[1] or m[2]
            if name not in env:
                raise ValueError(f"environment variable {name} is not set")
            return env[name]

        return _VAR.sub(one, value)
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    return [expand_env(v, env) for v in value] if isinstance(value, list) else value


def load_config(path: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """A job's settings from JSON, or from YAML where that library is there, variables expanded, nulls dropped."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs the yaml library; JSON always works") from e
        raw = yaml.safe_load(text)
    elif path.endswith(".json"):
        raw = json.loads(text)
    else:
        raise ValueError(f"{path}: settings are .json, .yaml or .yml")
    if not isinstance(raw, dict):
        raise ValueError(f"{path}: settings must be a mapping")
    clean = lambda v: {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v
    return clean(expand_env(raw, env))


def check_paths(config: dict[str, Any]) -> None:
    """Inputs must exist, outputs must not be files' folders."""
    data = config.get("dataset", {})
    if (p := data.get("input_path")) and not Path(p).exists():
        raise ValueError(f"input {p} does not exist")


def resolve_prompt(inline: str | None = None, file: str | None = None, default: str | None = None, default_file: str | None = None) -> str | None:
    """A prompt: its file, else inline, else the default's file, else the default; one closing newline dropped."""
    if file:
        return Path(file).read_text(encoding="utf-8").removesuffix("\n")
    if inline:
        return inline.removesuffix("\n")
    if default_file:
        return Path(default_file).read_text(encoding="utf-8").removesuffix("\n")
    return default.removesuffix("\n") if default else default


def absolute_path(path: Column, base: str) -> Column:
    """Relative paths below ``base``; absolute ones and URLs as they are."""
    return F.when(path.rlike(r"^(https?://|data:|/)"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


