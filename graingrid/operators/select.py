"""Filters, ranking, sampling, balancing, mixing, pairing and deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import checkpointed, small
from ..functions.rows import POS, all_of, pystrip, truthy, typed_number, with_pos

Threshold = float | int | bool


def mean_score(df: DataFrame, metrics: list[str]) -> Column:
    """The mean of a row's metrics that are numbers (booleans count as 1 and 0); null if none is."""
    have = [typed_number(df, m) for m in metrics if m in df.columns]
    if not have:
        return F.lit(None).cast("double")
    total = sum((F.coalesce(c, F.lit(0.0)) for c in have[1:]), F.coalesce(have[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in have[1:]), have[0].isNotNull().cast("int"))
    return total / F.nullif(count, F.lit(0))


def passes(df: DataFrame, thresholds: dict[str, Threshold], require_all: bool = True) -> Column:
    """Whether a row meets all thresholds.

    A number must not be below its threshold; where either side is no number, their truth must agree. A metric that is
    missing or null fails, or is passed over unless ``require_all``.
    """
    tests = []
    for m, t in thresholds.items():
        if m not in df.columns:
            tests.append(F.lit(not require_all))
            continue
        c, kind = F.col(m), df.schema[m].dataType
        value = typed_number(df, m)
        if isinstance(kind, (T.NumericType, T.BooleanType)):
            ok = ~(value < float(t))
        else:
            ok = F.when(value.isNotNull(), ~(value < float(t))).otherwise(truthy(c, kind) == F.lit(bool(t)))
        tests.append(F.when(c.isNull(), F.lit(not require_all)).otherwise(ok))
    return all_of(tests)


def quality_filter(df: DataFrame, thresholds: dict[str, Threshold], require_all: bool = True) -> DataFrame:
    return df.where(passes(df, thresholds, require_all))


def top_k(df: DataFrame, metrics: list[str], k: int | None = None, fraction: float | None = None) -> DataFrame:
    """The rows with the best mean score, best first, ties by position; k, or the rounded-down fraction of the scored rows.

    The k rows are a limit over a sort, of which each task keeps k rows; for a fraction the last row wanted is found
    first, and only what isn't after it is sorted, over all tasks.
    """
    df = with_pos(df).withColumn("_avg", mean_score(df, metrics)).where("_avg is not null")
    if k is not None:
        return df.orderBy(F.desc("_avg"), POS).limit(k)
    if fraction is not None:
        df = first_of_each(df.withColumn("__all", F.lit(0)), "__all", [(-F.col("_avg")), F.col(POS)], lambda n: F.floor(n * F.lit(fraction))).drop("__all")
    return df.orderBy(F.desc("_avg"), POS)


def cuts(df: DataFrame, group: str, order: list[Column], quota: Callable[[Column], Column]) -> DataFrame:
    """Of each group its quota (of its number of rows), and the quota-th row's order values, ``__cut``; null if there are fewer.

    ``order`` must tell all rows of a group apart. Only group and order are sorted, by range over all tasks, so a group may
    be spread over many of them; a row's number follows from the numbers of rows of its group in each.
    """
    names = [f"__o{k}" for k in range(len(order))]
    by = ["__g", *names]
    narrow = df.select(F.col(group).alias("__g"), *(o.alias(n) for o, n in zip(order, names)))
    ranked = checkpointed(narrow.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    here = F.shiftright("__at", 33).alias("__p")
    # a row for each group and task
    parts = ranked.groupBy("__g", here).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy("__g")
    parts = parts.withColumn("__before", F.sum("__n").over(w.orderBy("__p")) - F.col("__n")).withColumn("__quota", quota(F.sum("__n").over(w)).cast("bigint"))
    place = F.col("__first") + F.col("__quota") - F.col("__before") - 1
    hit = parts.where("__quota > __before and __quota <= __before + __n").select(F.col("__g").alias("__h"), place.alias("__at"))
    cut = ranked.join(F.broadcast(hit), "__at").select("__g", F.struct(*names).alias("__cut"))
    quotas = parts.groupBy("__g").agg(F.max("__quota").alias("__quota"))
    return quotas.join(cut, "__g", "left")


def first_of_each(df: DataFrame, group: str, order: list[Column], quota: Callable[[Column], Column]) -> DataFrame:
    """The first rows of each group in the order, as many as the quota makes of its number of rows. No row is moved: each is held against its group's last."""
    found = checkpointed(cuts(df, group, order, quota))
    key = F.struct(*(o.alias(f"__o{k}") for k, o in enumerate(order)))
    rows = df.join(F.broadcast(found) if small(found, 100) else found, df[group] == F.col("__g"))
    return rows.where((F.col("__quota") > 0) & (F.col("__cut").isNull() | (key <= F.col("__cut")))).drop("__g", "__cut", "__quota")


def per_group_top(df: DataFrame, group: str, metrics: list[str], k: int | None = None, fraction: float | None = None, order: str | None = None) -> DataFrame:
    """Each group's best rows: k, or the rounded-up fraction of its scored rows but one at least. Null and empty groups are 'unknown'.

    ``order`` tells rows of equal score apart, and must differ between all of a group.
    """
    order = order or POS
    df = with_pos(df) if order == POS else df
    g = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown"))
    df = df.withColumn("_group", g).withColumn("_avg", mean_score(df, metrics)).where("_avg is not null")
    if k is not None:
        # up to a thousand, the engine cuts each task's share of a group to k rows before they are shuffled
        rank = F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("_avg"), order))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_group", "_rank")
    if fraction is not None:
        df = first_of_each(df, "_group", [-F.col("_avg"), F.col(order)], lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))))
    return df.drop("_group")


REWRITE_THRESHOLDS: dict[str, Threshold] = {
    "intent_fidelity": 7, "text_rendering_completeness": 7, "usability": 7, "detail_enrichment": 6, "visual_concreteness": 6, "compositional_coverage": 5, "scene_alignment": 5,
    "language_consistency": True, "no_conflict": True,
}


def rewrite_filter(df: DataFrame, thresholds: dict[str, Threshold] | None = None, k: int | None = None, fraction: float | None = None, per_scene: bool = True, group: str = "scene") -> DataFrame:
    """Rewritten prompts that pass all gates (the default ones if none are given); of these, if k or a fraction is given, the best of each scene, or of all.

    Scores are the integer metrics' means. Rows without any metric pass a later ranking only if none is asked for.
    """
    df = quality_filter(df, REWRITE_THRESHOLDS if thresholds is None else thresholds)
    if k is None and fraction is None:
        return df
    metrics = [m for m, t in REWRITE_THRESHOLDS.items() if not isinstance(t, bool)]
    df = with_pos(df)
    best = per_group_top(df if group in df.columns else df.withColumn(group, F.lit(None).cast("string")), group, metrics, k, fraction) if per_scene else top_k(df, metrics, k, fraction)
    return best.select(df.columns)


def mixer_bin(cd: Column, edges: list[float]) -> Column:
    """The number of the difficulty bin: edges at or below the value, less one; null outside, or for what is no number.

    A value equal to the last edge falls in one more bin after the last.
    """
    v = cd.try_cast("double")
    n = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= v)) - 1
    return F.when(v.isNotNull() & ~F.isnan(v) & (v >= edges[0]) & (v <= edges[-1]), n)


def mixer_target(bin_: Column, target: str | float, bins: int) -> Column:
    """The verbosity wanted in a bin: a number, low, medium, high, or matched to the bin's difficulty."""
    fixed = {"low": 2.0, "medium": 5.0, "high": 8.0}
    if target == "matched":
        return F.lit(5.0) if bins == 1 else F.bround(F.lit(2.0) + bin_ * F.lit(8.0) / F.lit(float(bins - 1)), 2)
    return F.lit(float(fixed.get(target, target)))


def mix_by_difficulty(
    df: DataFrame, edges: list[float] | None = None, target: str | float = "matched", per_bin: int | None = None, min_correct: int = 1,
    cd: str = "cognitive_difficulty", rv: str = "reasoning_verbosity", correct: str = "logical_correctness", order: str | None = None,
) -> DataFrame:
    """Correct rows by difficulty bin, nearest to the bin's verbosity target first, at most ``per_bin`` each; adds cd_bin and rv_target."""
    edges = edges or [0, 3, 6, 10]
    order = order or POS
    df = with_pos(df) if order == POS else df
    gate = F.col(correct).cast("int") if isinstance(df.schema[correct].dataType, (T.NumericType, T.BooleanType)) else F.col(correct).try_cast("int")
    df = df.where(gate >= min_correct).withColumn("cd_bin", mixer_bin(F.col(cd), edges)).where("cd_bin is not null")
    df = df.withColumn("rv_target", mixer_target(F.col("cd_bin"), target, len(edges) - 1))
    far = F.coalesce(F.abs(F.col(rv).try_cast("double") - F.col("rv_target")), F.lit(float("inf")))
    if per_bin is not None:
        df = df.withColumn("_near", F.row_number().over(Window.partitionBy("cd_bin").orderBy(far, order))).where(F.col("_near") <= per_bin).drop("_near")
    return df


def category_quotas(counts: DataFrame, distribution: dict[str, float], total: int) -> DataFrame:
    """category, n and quota by largest remainders, for the categories that are present and wanted.

    Shares are of all wanted categories. What floors leave over goes to the largest remainders, one each at most, ties
    by the distribution's order; so the quotas' sum can fall short of the total.
    """
    spark = counts.sparkSession
    s = sum(distribution.values())
    scale = s if s and abs(s - 1) > 1e-6 else 1.0
    want = spark.createDataFrame([(c, float(r) / scale, k) for k, (c, r) in enumerate(distribution.items())], "category string, ratio double, place int")
    few = counts.join(F.broadcast(want), "category")
    w = Window.partitionBy(F.lit(1))  # a row a category: the table is as small as the distribution
    few = few.withColumn("target", F.col("ratio") * total).withColumn("base", F.floor("target"))
    few = few.withColumn("left", F.lit(total) - F.sum("base").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.col("target") - F.col("base")), "place")))
    return few.select("category", "n", (F.col("base") + (F.col("r") <= F.col("left")).cast("bigint")).alias("quota"))


def balance(df: DataFrame, distribution: dict[str, float], category: str = "category", key: str = "id", seed: int = 42, total: int | None = None) -> DataFrame:
    """Rows resampled to the distribution: a category's rows in the order of md5(seed|key), repeated as often as its quota asks.

    Adds ``_copy``, from 1. Rows of other categories are dropped.
    """
    counts = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    size = F.broadcast(category_quotas(counts, distribution, df.count() if total is None else total))
    size = size.withColumnsRenamed({"category": "__category", "n": "__n"})
    rows = df.join(size, df[category] == F.col("__category"))
    draw = [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]
    # rows up to the (quota modulo n)-th of their category get a copy more than the others
    more = cuts(rows.withColumn("__draw", F.struct("__category", (F.col("quota") % F.col("__n")).alias("more"))), "__draw", draw, lambda _: F.col("__g.more"))
    more = more.select(F.col("__g.__category").alias("__h"), F.col("__cut"), F.col("__quota").alias("__more"))
    rows = rows.join(F.broadcast(more), rows["__category"] == F.col("__h"))
    extra = F.when(F.col("__more") > 0, F.coalesce(F.struct(*(o.alias(f"__o{k}") for k, o in enumerate(draw))) <= F.col("__cut"), F.lit(True))).otherwise(F.lit(False))
    copies = F.floor(F.col("quota") / F.col("__n")) + extra.cast("bigint")
    rows = rows.withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).drop("__category", "__n", "quota", "__copies", "__h", "__cut", "__more")


def numbered(df: DataFrame, order: list[Column], out: str = "__i") -> DataFrame:
    """The frame with rows numbered from 0 in that order, sorted by range over all tasks."""
    ranked = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # a row for each task
    parts = ranked.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    shift = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n") - F.col("__first")
    starts = parts.select("__p", shift.alias("__shift"))
    return ranked.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__p")).withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__p", "__shift")


def in_context_examples(requests: DataFrame, pool: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Each request with k different examples of the pool.

    The pool, in order of position, is cut into k even stretches, and each gives one row, drawn by md5(seed + request, stretch);
    the draws' own order is theirs in the result. A request needs k rows of the pool by their numbers, so both sides may be
    large: they are joined by number.
    """
    rows = numbered(pool.select(POS, "text"), [F.col(POS)])
    if (have := rows.count()) < k:
        raise ValueError(f"{k} examples asked of a pool of {have}")
    h = lambda j: F.md5(F.concat((F.lit(seed) + F.col(POS)).cast("string"), F.lit("-"), j.cast("string")))
    low = lambda j: F.floor(j * have / k)
    drawn = lambda j: F.struct(h(j).alias("h"), (low(j) + F.conv(F.substring(h(j), 1, 12), 16, 10).cast("bigint") % (low(j + 1) - low(j))).alias("i"))
    asked = requests.select(POS, F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), drawn)).alias("d")).select(F.col(POS).alias("__request"), "d.h", F.col("d.i").alias("__i"))
    found = asked.join(rows.select("__i", "text"), "__i").groupBy("__request").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "text"))), lambda x: x["text"]).alias("examples"))
    return requests.join(found, F.col(POS) == F.col("__request")).drop("__request")


def preference_pairs(
    df: DataFrame, min_margin: float = 0.0, max_pairs: int = 1, require_correct: bool = False, candidates: str = "candidates", scores: str = "candidate_scores", correct: str = "candidate_correctness"
) -> DataFrame:
    """chosen and rejected with their scores, from arrays of candidates and scores, within the row.

    Candidates are ranked by score, ties by place. The best (of the correct ones, if asked and a mask is there) are
    chosen; rejected is the lowest ranked other one; pairs below the margin are dropped, as are rows of fewer than two
    candidates, or with another number of scores.
    """
    idx = F.sequence(F.lit(0), F.size(candidates) - 1)
    items = F.transform(idx, lambda i: F.struct((-F.get(F.col(scores), i).cast("double")).alias("neg"), i.alias("i"), F.get(F.col(candidates), i).alias("text")))
    ok = df.where((F.size(candidates) >= 2) & (F.size(candidates) == F.size(scores))).withColumn("__ranked", F.array_sort(items))
    pool: Column = F.col("__ranked")
    if require_correct and correct in df.columns:
        right = F.filter("__ranked", lambda x: F.coalesce(F.get(F.col(correct), x["i"]), F.lit(False)))
        pool = F.when(F.coalesce(F.size(correct), F.lit(0)) > 0, right).otherwise(F.col("__ranked"))
    ok = ok.withColumn("__chosen", F.explode(F.slice(pool, 1, max_pairs)))
    lowest = F.try_element_at(F.filter("__ranked", lambda x: x["i"] != F.col("__chosen.i")), F.lit(-1))
    ok = ok.withColumn("__rejected", lowest).where(F.col("__rejected.neg") - F.col("__chosen.neg") >= min_margin)
    out = ok.select(
        *[c for c in df.columns if c not in (candidates, scores, correct, "candidate_results", "chosen", "rejected", "chosen_score", "rejected_score")],
        F.col("__chosen.text").alias("chosen"), F.col("__rejected.text").alias("rejected"), (-F.col("__chosen.neg")).alias("chosen_score"), (-F.col("__rejected.neg")).alias("rejected_score"),
    )
    return out


def judge_filter(df: DataFrame, strategy: str = "correct_shortest", require_correct: bool = True, min_turns: int = 0, col: str = "trajectories") -> DataFrame:
    """Rows with their array of rollouts cut to the selected ones; rows without any are dropped."""
    kept = F.filter(col, lambda t: (F.coalesce(t["is_correct"], F.lit(False)) | F.lit(not require_correct)) & (F.coalesce(t["turns"], F.lit(0)) >= min_turns))
    if strategy == "all_correct":
        picked = kept
    elif strategy in ("correct_shortest", "correct_longest"):
        sign = 1 if strategy == "correct_shortest" else -1
        turns = F.array_sort(F.transform(kept, lambda t, i: F.struct((F.coalesce(t["turns"], F.lit(0)) * sign).alias("turns"), i.alias("i"))))
        picked = F.slice(kept, F.coalesce(F.try_element_at(turns, F.lit(1))["i"], F.lit(0)) + 1, 1)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return df.withColumn(col, picked).where(F.size(col) > 0)


def best_trajectory(df: DataFrame, best_id: str = "best_solution_id", col: str = "trajectories", use_rubrics: bool = False) -> Column:
    """The rollout named best; without such a one the first; without a name the first too, or none if rubrics were to name it."""
    found = F.try_element_at(F.filter(col, lambda t: t["solution_id"] == F.col(best_id)), F.lit(1))
    first = F.try_element_at(col, F.lit(1))
    return F.when(truthy(F.col(best_id)), F.coalesce(found, first)).otherwise(F.lit(None) if use_rubrics else first)


def keep_first(df: DataFrame, keys: list[Column], order: list[Column | str] | None = None) -> DataFrame:
    """The first row of each key, by ``order`` (position if not said). Unlike dropDuplicates, always the same one."""
    df = df if order else with_pos(df)
    named = {f"__k{n}": k for n, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*(order or [POS]))
    return df.withColumns(named).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", *named)


def keep_last(df: DataFrame, keys: list[Column]) -> DataFrame:
    return keep_first(with_pos(df), keys, [F.desc(POS)])


def topics_once(df: DataFrame, seed: str = "source_seed_id", topic: str = "topic", order: list[str] | None = None) -> DataFrame:
    """Rows whose topic the seed hasn't had in an earlier round; empty topics are all kept."""
    w = Window.partitionBy(seed, topic).orderBy(*(order or ["round", POS]))
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | (F.coalesce(F.col(topic), F.lit("")) == "")).drop("__n")


def valid_length(text: Column, low: int = 0, high: int | None = None, skip_empty: bool = True) -> Column:
    """Whether the trimmed text's length is in bounds."""
    n = F.coalesce(F.length(pystrip(text)), F.lit(0))
    ok = n >= low
    if high is not None:
        ok = ok & (n <= high)
    return ok & (n > 0) if skip_empty else ok


def ordered_entities(*arrays: Column) -> Column:
    """The arrays' trimmed, non-blank values, each where it first occurs."""
    trimmed = F.transform(F.concat(*arrays), pystrip)
    return F.array_distinct(F.filter(trimmed, lambda x: F.coalesce(x, F.lit("")) != ""))
