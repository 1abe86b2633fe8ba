"""A catalogue of models and datasets as rows, and its text reports."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_CJK_GAP = re.compile(r"(?<=[㐀-鿿]) (?=[㐀-鿿])")


def catalog(spark: SparkSession, entries: list[dict[str, Any]], kind: str | None = None, family: str | None = None) -> DataFrame:
    """name, family, kind (model or dataset), size, url, zh and en notes of those of a kind or family, sorted by family and name."""
    keys = ("family", "name", "kind", "size", "url", "note_en", "note_zh")
    wanted = [e for e in entries if e.get("name") and kind in (None, e.get("kind")) and family in (None, e.get("family"))]
    rows = [tuple(None if e.get(k) is None else str(e[k]) for k in keys) for e in wanted]
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys)).orderBy("family", "name")


def table_text(df: DataFrame, columns: list[str]) -> str:
    """The rows as an aligned text table."""
    rows = [columns] + [["" if v is None else str(v) for v in r] for r in df.select(columns).collect()]
    width = [max(len(r[k]) for r in rows) for k in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])


def markdown(df: DataFrame, language: str = "en") -> str:
    """The rows by family as Markdown tables, with notes in that language."""
    note, out, family = f"note_{language}", [], None
    for r in df.collect():
        if r["family"] != family:
            family = r["family"]
            out += ["", f"## {family or ''}", "", "| name | size | note |", "| --- | --- | --- |"]
        out.append(f"| {r['name']} | {r['size'] or ''} | {_CJK_GAP.sub('', r[note] or '')} |")
    return "\n".join(out).strip() + "\n"
