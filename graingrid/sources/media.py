"""Images and videos: references stay in rows; bytes are read only where a call needs them."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from ..functions.text import is_image_reference, mime_type


def data_urls(df: DataFrame, path_col: str, out: str, max_bytes: int | None = None) -> DataFrame:
    """The frame with base64 data URLs of the files in ``path_col``; URLs and data URLs stay; too large or missing files give null.

    Each file is read by the task that has its row, from a folder that all executors see.
    """
    c = F.col(path_col)
    limit = F.lit(max_bytes).cast("long")
    inline = F.concat(F.lit("data:"), mime_type(c), F.lit(";base64,"), F.base64(_content(c, limit)))
    return df.withColumn(out, F.when(is_image_reference(c), c).otherwise(inline))


@pandas_udf(BinaryType())
def _content(paths: pd.Series, limit: pd.Series) -> pd.Series:
    def one(path: str | None, most: float) -> bytes | None:
        try:
            p = Path(path.removeprefix("file://")) if path else None
            return p.read_bytes() if p and p.is_file() and (pd.isna(most) or p.stat().st_size <= most) else None
        except (OSError, ValueError):
            return None

    return pd.Series([one(p, m) for p, m in zip(paths, limit)], dtype=object)


def frame_indices(total: Column, count: int = 8) -> Column:
    """Evenly spread frame numbers, first and last included, each once."""
    n = F.least(total, F.lit(count))
    spread = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (total - 1) / (n - 1), 0).cast("int"))))
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(0))).otherwise(spread)
