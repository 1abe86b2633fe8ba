"""Votes of several judges: conflicts, weighted majority, overall scores and training bins.

Votes are a long table: case_id, dimension, l1, teacher, applicable, score (0-4), confidence, reason and ``_vpos``, the
vote's place in its case. Everything is a group-by or a window on the case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import truthy

CASE = ["case_id", "dimension"]


def conflicts(votes: DataFrame, threshold: int = 2, max_dims: int = 6) -> DataFrame:
    """Dimensions whose scores spread by the threshold, of two scores at least: the widest of each case, ties by name."""
    scored = votes.where("score is not null and coalesce(applicable, true)")
    spread = scored.groupBy(*CASE).agg((F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("n_votes")).where((F.col("n_votes") >= 2) & (F.col("spread") >= threshold))
    w = Window.partitionBy("case_id").orderBy(F.desc("spread"), "dimension")
    return spread.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= max_dims)


def majority(votes: DataFrame) -> DataFrame:
    """case_id, dimension, applicable, score, confidence, reason: the score with the most confidence behind it.

    A vote without confidence weighs 0.5; ties go to the score that was given first; the confidence is its supporters'
    mean. Where no vote scores, the dimension isn't applicable, with the first such vote's reason.
    """
    v = votes.withColumn("weight", F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.5)))
    scored = v.where("score is not null and coalesce(applicable, true)")
    by_score = scored.groupBy(*CASE, "score").agg(
        F.sum("weight").alias("w"), F.min("_vpos").alias("p"), F.bround(F.avg("weight"), 3).alias("confidence"), F.min_by("reason", "_vpos").alias("reason")
    )
    rank = F.row_number().over(Window.partitionBy(*CASE).orderBy(F.desc(F.bround("w", 9)), "p", "score"))
    best = by_score.withColumn("n", rank).where("n = 1").select(*CASE, "score", "confidence", "reason")
    every = v.groupBy(*CASE).agg(F.expr("min_by(reason, _vpos) filter (where not coalesce(applicable, true))").alias("na_reason"))
    out = every.join(best, CASE, "left")
    return out.select(*CASE, F.col("score").isNotNull().alias("applicable"), "score", "confidence", F.coalesce("reason", F.when(F.col("score").isNull(), F.col("na_reason")), F.lit("")).alias("reason"))


def final_labels(major: DataFrame, debated: DataFrame) -> DataFrame:
    """Majority labels, with a debate's outcome (case_id, dimension, score, confidence, reason, steps) put in its place."""
    d = debated.select(*CASE, F.col("score").alias("__s"), F.col("confidence").alias("__c"), F.col("reason").alias("__r"), F.col("steps").alias("__t"))
    out = major.join(d, CASE, "left").withColumn("debated", F.col("__t").isNotNull()).withColumn("majority_score", F.col("score"))
    pick = lambda a, b: F.when(F.col("debated") & F.col("__s").isNotNull(), F.col(a)).otherwise(F.col(b))
    out = out.withColumns({"confidence": pick("__c", "confidence"), "reason": pick("__r", "reason"), "score": pick("__s", "score"), "steps": F.col("__t")})
    return out.withColumn("applicable", F.col("score").isNotNull()).drop("__s", "__c", "__r", "__t")


def overall(labels: DataFrame, excludes: list[str] | None = None, veto: str | None = "Safety Compliance") -> DataFrame:
    """Each case's mean of its scores (0-4 as 0-100), over dimensions whose top group isn't excluded; a 0 in the veto dimension makes it 0.

    With counts of dimensions scored (and not excluded), not applicable and unscored. For edited images give no excludes and no veto.
    """
    counted = ~F.coalesce(F.col("l1").isin(excludes or []), F.lit(False))
    points = F.when(F.col("score").isNotNull(), F.col("score") * 25.0)
    out = labels.groupBy("case_id").agg(
        F.avg(F.when(counted, points)).alias("mean"),
        F.count_if(counted & F.col("score").isNotNull()).alias("n_scored"),
        F.count_if(F.col("score").isNull() & ~F.coalesce("applicable", F.lit(True))).alias("n_na"),
        F.count_if(F.col("score").isNull() & F.coalesce("applicable", F.lit(True))).alias("n_unscored"),
        F.coalesce(F.bool_or((F.col("dimension") == F.lit(veto)) & (F.col("score") == 0)), F.lit(False)).alias("vetoed"),
    )
    return out.withColumn("overall", F.when(F.col("vetoed"), F.lit(0.0)).otherwise(F.bround("mean", 2))).drop("mean")


def group_scores(labels: DataFrame) -> DataFrame:
    """case_id, l1 and the mean of its scores; groups without any are left out."""
    return labels.where("score is not null").groupBy("case_id", "l1").agg(F.bround(F.avg(F.col("score") * 25.0), 2).alias("score"))


def summary(cases: DataFrame) -> DataFrame:
    """One row: cases, failed ones, mean, least and greatest overall score, and debates."""
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(F.col("error").isNotNull()).alias("cases_failed"), F.bround(F.avg("overall"), 2).alias("mean"),
        F.min("overall").alias("min"), F.max("overall").alias("max"), F.coalesce(F.sum("n_debated"), F.lit(0)).alias("n_debated"),
    )


def training_bins(labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """A row for each label and bin it goes to: sft or uncertain, and dpo if a debate with steps overturned the majority."""
    sure = F.coalesce(F.col("applicable") & F.col("score").isNotNull() & (F.col("confidence") >= threshold), F.lit(False))
    dpo = F.coalesce(F.col("debated") & truthy(F.col("steps").cast("string")) & (F.col("majority_score") != F.col("score")), F.lit(False))
    bins = F.array_compact(F.array(F.when(sure, "sft").otherwise("uncertain"), F.when(dpo, "dpo")))
    return labels.withColumn("bin", F.explode(bins))


def artifacts(votes: DataFrame, spread: DataFrame, labels: DataFrame, cases: DataFrame, folder: str) -> None:
    """The evaluation's tables as JSON lines below a folder; failed cases only in final labels."""
    good = cases.where("error is null").select("case_id")
    per_case = good.join(spread.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "dimension"))), lambda x: x["dimension"]).alias("conflict_dims")), "case_id", "left")
    per_case = per_case.withColumn("conflict_dims", F.coalesce("conflict_dims", F.array().cast("array<string>")))
    talks = labels.where("debated").groupBy("case_id").agg(F.count("*").alias("n_debated"), F.sort_array(F.collect_list(F.struct("dimension", "score", "steps"))).alias("dimensions"))
    debated = per_case.select("case_id", F.size("conflict_dims").alias("n_conflict_dims")).join(talks, "case_id", "left").withColumn("n_debated", F.coalesce("n_debated", F.lit(0)))
    for name, df in {"teacher_outputs": votes, "conflict_report": per_case, "debate_results": debated, "final_judgments": labels}.items():
        df.join(good, "case_id", "left_semi").write.mode("overwrite").json(f"{folder}/{name}")
    cases.write.mode("overwrite").json(f"{folder}/final_labels")
    summary(cases).write.mode("overwrite").json(f"{folder}/summary")
