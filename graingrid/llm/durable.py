"""Joins by checked size, beside the engine's ways to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import BROADCAST_BYTES, checkpointed, discard, small, written

__all__ = ["BROADCAST_BYTES", "checkpointed", "discard", "small", "unused", "without_ids", "written"]


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` whose key isn't among ``ids`` (a checkpointed frame with that one column).

    Below ``limit`` the ids are broadcast and the texts don't move; above, both sides are shuffled.
    """
    ids = ids.select(key)
    return docs.join(F.broadcast(ids) if small(ids, 16, limit) else ids, key, "left_anti")
