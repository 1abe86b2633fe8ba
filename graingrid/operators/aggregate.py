"""Aggregates over judged rows and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import POS, typed_number


def metric_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: each metric's mean over the rows that have it."""
    return df.agg(*(F.avg(typed_number(df, m)).alias(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in metrics))


def group_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows by group; null and empty are 'unknown'."""
    return df.groupBy(F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown")).alias(group)).agg(F.count("*").alias("n"))


def rollout_stats(col: str = "trajectories") -> tuple[Column, Column]:
    """Accuracy and mean turns of a row's rollouts; 0 without any."""
    n = F.nullif(F.size(col), F.lit(0))
    right = F.size(F.filter(col, lambda t: F.coalesce(t["is_correct"], F.lit(False))))
    turns = F.aggregate(col, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(t["turns"], F.lit(0)))
    return F.coalesce(right / n, F.lit(0.0)), F.coalesce(turns / n, F.lit(0.0))


def verify_summary(runs: DataFrame, by: str = "task_id") -> DataFrame:
    """Per task: the median steps cut to an integer, correct runs, and the first correct answer, else the first."""
    return runs.groupBy(by).agg(
        F.percentile("steps", 0.5).cast("int").alias("median_steps"),
        F.count_if("is_correct").alias("n_correct"),
        F.coalesce(F.expr(f"min_by(answer, {POS}) filter (where is_correct)"), F.min_by("answer", POS)).alias("answer"),
    )


def first_per_task(rows: DataFrame, by: str = "id", k: int = 3) -> DataFrame:
    """Each task's first k rollouts, in order, as one array; rows without an id are one task, 'unknown'."""
    task = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("unknown"))
    rest = [c for c in rows.columns if c not in (POS, by)]
    # the engine cuts each map task's share of a task to k rows before they are shuffled
    first = F.row_number().over(Window.partitionBy("task_id").orderBy(POS))
    few = rows.withColumn("task_id", task).withColumn("__n", first).where(F.col("__n") <= k)
    return few.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct(POS, *rest))).alias("solutions"))
