"""Row positions, truthiness and trimming.

Order matters to many operators (ties go to the earlier row, default ids are
row numbers), so frames carry an explicit ``_pos`` and windows end with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def with_pos(df: DataFrame, dense: bool = False, files: bool = False) -> DataFrame:
    """The frame with ``_pos``, in scan order.

    ``files`` is for frames just read from files: rows are numbered from 0 without gaps, by the files' names and their
    place in them, however they are split over tasks. ``dense`` numbers rows of any origin without gaps, in scan order.
    Either counts the rows of each split once more; it is part of the plan, and no row is moved or sent to the driver.
    """
    if POS in df.columns:
        return df
    if not dense and not files:
        return df.withColumn(POS, F.monotonically_increasing_id())
    if files:  # a split of a file is read by one task from end to end
        split = [F.col("_metadata.file_path").alias("__a"), F.col("_metadata.file_block_start").alias("__b")]
    else:
        split = [F.lit("").alias("__a"), F.shiftright(F.monotonically_increasing_id(), 33).alias("__b")]
    raw = df.select("*", *split, F.monotonically_increasing_id().alias("__raw"))
    # read as the rows themselves are, not as bare lines
    seen = raw.where(pinned(df)) if files else raw
    sizes = seen.groupBy("__a", "__b").agg(F.min("__raw").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__a", "__b")) - F.col("__n")
    # 16 bytes a split, of which a hundred terabytes have some hundred thousand
    key = F.xxhash64("__a", "__b").alias("__k")
    starts = sizes.select(key, (before - F.col("__first")).alias("__shift"))
    return raw.withColumn("__k", key).join(F.broadcast(starts), "__k").select(*df.columns, (F.col("__raw") + F.col("__shift")).alias(POS))


def pinned(df: DataFrame, but: str = "_corrupt_record") -> Column:
    """A test that all rows pass, and that makes a reader parse them."""
    some = next((c for c in df.columns if c != but), None)
    return F.lit(True) if some is None else F.hash(F.col(some)) >= F.lit(-(1 << 31))


def pystrip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, _EDGE, "")


def truthy(c: Column, kind: T.DataType | None = None) -> Column:
    """Not null, empty, zero or false, for a column of that type (string if not said). Never null."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    elif isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, (T.StructType, T.VariantType)):
        test = c.isNotNull()
    else:
        test = c != ""
    return F.coalesce(test, F.lit(False))


def first_truthy(*cols: Column) -> Column:
    """The first string that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def existing(df: DataFrame, *names: str) -> list[Column]:
    """The columns of these names that the frame has, as strings."""
    return [F.col(n).cast("string") for n in names if n in df.columns]


def coalesce_columns(df: DataFrame, *names: str) -> Column:
    """First truthy of the columns that exist; null if none does."""
    have = existing(df, *names)
    return first_truthy(*have) if have else F.lit(None).cast("string")


def number(c: Column) -> Column:
    """The value as a double, booleans as 1 and 0; null for what is no number."""
    return F.coalesce(c.try_cast("double"), c.try_cast("boolean").try_cast("int").cast("double"))


def typed_number(df: DataFrame, name: str) -> Column:
    """Like :func:`number`, chosen by the column's type: text never counts as a number, as in a judged row."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return F.col(name).cast("string").try_cast("double")


def rest_as_json(df: DataFrame, but: set[str]) -> Column:
    """All other columns as one JSON object; nulls left out."""
    rest = [c for c in df.columns if c not in but and c != POS]
    return F.to_json(F.struct(*rest)) if rest else F.lit("{}")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
