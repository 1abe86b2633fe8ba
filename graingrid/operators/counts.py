"""Counts taken while a plan runs: rows kept and dropped, and an alarm where too many are skipped. They cost no pass of their own."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("graingrid")


class Counted:
    """Rows that went in and those that a test let through; known once an action has run."""

    def __init__(self, name: str):
        self.name = name
        self._seen = Observation(f"{name}-{id(self)}")

    def keep(self, df: DataFrame, test: Column) -> DataFrame:
        """The rows that pass, all rows counted."""
        ok = F.coalesce(test, F.lit(False))
        return df.observe(self._seen, F.count("*").alias("rows"), F.count_if(ok).alias("kept")).where(ok)

    @property
    def rows(self) -> int:
        return self._seen.get["rows"]

    @property
    def kept(self) -> int:
        return self._seen.get["kept"]

    @property
    def skipped(self) -> int:
        return self.rows - self.kept

    def report(self, alarm: float = 0.5) -> int:
        """The log level of what it tells: nothing for no skipped row, a warning, or an error if over the share ``alarm`` of rows was skipped."""
        if not self.skipped:
            return logging.NOTSET
        level = logging.ERROR if self.skipped > alarm * self.rows else logging.WARNING
        log.log(level, "%s skipped %d of %d rows (%.1f %%)", self.name, self.skipped, self.rows, 100 * self.skipped / self.rows)
        return level


def duplicates(before: int, after: int, name: str = "deduplication") -> int:
    """Tells how many rows went and stayed."""
    log.info("%s removed %d rows and kept %d", name, before - after, after)
    return before - after
