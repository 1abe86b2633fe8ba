"""Joins of stage results back to their rows, fan-outs, resume splits and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import checkpointed
from ..functions.rows import POS, any_of, first_truthy, with_pos
from .select import keep_first, keep_last


def merge_scores(rows: DataFrame, scores: DataFrame, key: str = "id", metrics: list[str] | None = None) -> DataFrame:
    """Rows with their scores: left, by the key as text, of repeated keys the last score, old metric columns replaced.

    Scores need ``_pos`` for what is last.
    """
    metrics = metrics or [c for c in scores.columns if c not in (key, POS)]
    right = keep_last(scores, [F.col(key).cast("string")]).select(F.col(key).cast("string").alias("__key"), *(F.col(m).alias(m) for m in metrics))
    left = rows.drop(*metrics)
    return left.join(right, left[key].cast("string") == F.col("__key"), "left").drop("__key")


def update_scores(rows: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Like :func:`merge_scores`, but a missing score leaves the row's old value."""
    metrics = [c for c in scores.columns if c not in (key, POS)]
    right = keep_last(scores, [F.col(key).cast("string")]).select(F.col(key).cast("string").alias("__key"), *(F.col(m).alias(f"__{m}") for m in metrics))
    out = rows.join(right, rows[key].cast("string") == F.col("__key"), "left")
    for m in metrics:
        out = out.withColumn(m, F.coalesce(F.col(f"__{m}"), F.col(m)) if m in rows.columns else F.col(f"__{m}"))
    return out.drop("__key", *(f"__{m}" for m in metrics))


def carry_companions(rows: DataFrame, scores: DataFrame, key: str = "id", identity: tuple[str, ...] = ("prompt", "instruction", "video_urls", "image_urls")) -> DataFrame:
    """Scores and also those of their companion columns that rows don't have, identity columns apart."""
    wanted = [c for c in scores.columns if c not in (key, POS, *identity)]
    fresh = [c for c in wanted if c not in rows.columns]
    return merge_scores(rows, scores.select(key, POS, *fresh), key, fresh) if fresh else rows


def fan_out(rows: DataFrame, n: int, index: str = "candidate_idx", id_format: str | None = None) -> DataFrame:
    """Each row n times, numbered from 0; ``id_format`` makes ids of {id} and {i} (from 0) or {n} (from 1)."""
    out = rows.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if id_format:
        from ..functions.text import fill

        out = out.withColumn("request_id", fill(id_format, id=F.col("id"), i=F.col(index), n=F.col(index) + 1))
    return out


def gather(rows: DataFrame, results: DataFrame, by: str = POS, order: str = "candidate_idx", value: str = "response", out: str = "candidates") -> DataFrame:
    """Results collected into an array for each row, in request order; rows without any get an empty one."""
    nested = results.where(F.col(value).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("__all"))
    texts = F.transform("__all", lambda x: x[value])
    return rows.join(nested, by, "left").withColumn(out, F.coalesce(texts, F.array().cast("array<string>"))).drop("__all")


def fan_metrics(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each sample and metric."""
    return samples.withColumn("metric", F.explode(F.array(*(F.lit(m) for m in metrics))))


def pivot_metrics(judged: DataFrame, metrics: list[str], by: list[str], value: str = "score") -> DataFrame:
    """Long scores back to a column a metric; naming the metrics keeps the schema fixed and saves a pass."""
    return judged.groupBy(*by).pivot("metric", metrics).agg(F.last(value))


def configured(df: DataFrame, rows: int) -> DataFrame:
    """A table that is written by hand, and sent to all tasks; raises if it has more rows than such a table can have."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"a configured table has more than {rows} rows")
    return df


def cases_by_teacher(cases: DataFrame, teachers: DataFrame, groups: DataFrame) -> DataFrame:
    """Every case with every judge and dimension group. Both are a handful of configured rows; thousands raise."""
    teachers, groups = configured(teachers, 1000), configured(groups, 1000)
    return cases.crossJoin(F.broadcast(teachers)).crossJoin(F.broadcast(groups))


def with_l1(votes: DataFrame, pool: DataFrame) -> DataFrame:
    """Votes with their dimension's top group, 'unknown' for a dimension that isn't in the pool (a configured table; a huge one raises)."""
    dim = configured(pool.select(F.col("l3").alias("dimension"), F.col("l1").alias("__l1")).distinct(), 100_000)
    return votes.join(F.broadcast(dim), "dimension", "left").withColumn("l1", F.coalesce("__l1", F.lit("unknown"))).drop("__l1")


def by_language(language: Column, prompts: dict[str, str], default: str | None = None) -> Column:
    """A prompt by the row's language, case folded."""
    pairs = [F.lit(x) for kv in prompts.items() for x in (kv[0].lower(), kv[1])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(language)), F.lit(default)) if pairs else F.lit(default)


def by_scene(scene: Column, language: Column, prompts: dict[str, str]) -> Column:
    """A prompt by ``scene_language``, else by ``general_language``."""
    table = F.create_map(*(F.lit(x) for kv in prompts.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.concat_ws("_", scene, language)), F.try_element_at(table, F.concat_ws("_", F.lit("general"), language)))


def url_context(url: Column, seen: Column) -> Column:
    """What is known of a URL from earlier search results (an array of url, snippet, query), the latest first."""
    hits = F.filter(seen, lambda s: s["url"] == url)
    last = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(F.nullif(last["snippet"], F.lit("")), last["query"], F.lit(""))


def resume_key(ident: Column, prompt: Column, frame: Column | None = None) -> Column:
    """What a finished row is known by: its id, else a hash of prompt and first frame."""
    text = F.concat(F.coalesce(prompt, F.lit("")), F.lit("\x1f"), F.coalesce(frame, F.lit("")) if frame is not None else F.lit(""))
    return F.when(F.coalesce(ident.cast("string"), F.lit("")) != "", F.concat(F.lit("id:"), ident.cast("string"))).otherwise(F.concat(F.lit("sha1:"), F.sha1(text)))


def complete(df: DataFrame, kind: str) -> Column:
    """Whether a row of an earlier output is finished: optimize, generate or eval."""
    if kind == "optimize":
        return F.coalesce(first_truthy(*(F.col(c).cast("string") for c in ("optimized_prompt", "prompt") if c in df.columns)) != "", F.lit(False))
    if kind == "generate":
        return F.coalesce(F.size("video_urls") > 0, F.lit(False)) if "video_urls" in df.columns else F.lit(False)
    if kind == "eval":
        return any_of([F.col(c).isNotNull() for c in df.columns if c.endswith("_confidence") or (c.startswith("vbench_") and c != "vbench_skipped_reason")])
    raise ValueError(f"unknown kind {kind}")


def split_done(rows: DataFrame, done: DataFrame, key: str = "_key") -> tuple[DataFrame, DataFrame]:
    """Rows that are finished already, and rows that aren't."""
    keys = done.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def merge_done(rows: DataFrame, cached: DataFrame, fresh: DataFrame, key: str = "_key") -> DataFrame:
    """For each row, in input order, its cached result, else its fresh one; rows with neither are dropped.

    Cached and fresh must have the same columns besides the key.
    """
    cols = [c for c in cached.columns if c not in (key, POS)]
    one = lambda df, name: keep_last(df, [F.col(key)]).select(key, F.struct(*cols).alias(name))
    out = rows.select(key, POS).join(one(cached, "c"), key, "left").join(one(fresh, "f"), key, "left").withColumn("r", F.coalesce("c", "f"))
    return out.where("r is not null").select(key, POS, "r.*")


def finished(df: DataFrame, kind: str, key: str = "_key") -> DataFrame:
    """The last complete row of each key of an earlier output."""
    return keep_last(with_pos(df).where(complete(df, kind)), [F.col(key)])


def through_cache(requests: DataFrame, cache: DataFrame, compute, key: str = "key"):
    """Results by key: from the cache where it has them (the last by position, if it has positions), else computed; and what was computed, to append to the cache.

    A key is computed once however many requests have it, and what is computed is stored at once, so that using both frames
    computes nothing twice.
    """
    known = keep_last(cache, [F.col(key)]).drop(POS) if POS in cache.columns else keep_first(cache, [F.col(key)], [F.to_json(F.struct(*cache.columns))])
    missing = requests.join(known.select(key), key, "left_anti")
    fresh = checkpointed(compute(keep_first(missing, [F.col(key)], [F.to_json(F.struct(*missing.columns))])))
    asked = requests.select(key)
    return asked.join(known, key).select(fresh.columns).unionByName(asked.join(fresh, key).select(fresh.columns)), fresh


def seed_of(ident: Column) -> Column:
    """The seed an output id comes from."""
    return F.regexp_replace(F.substring_index(ident, "#gen", 1), "-evolved$", "")


def not_yet(seeds: DataFrame, earlier: DataFrame) -> DataFrame:
    """Seeds that no row of an earlier output comes from."""
    done = earlier.select(seed_of(F.coalesce(*(F.col(c).cast("string") for c in ("seed_id", "id") if c in earlier.columns))).alias("id")).distinct()
    return seeds.join(done, "id", "left_anti")


def all_null(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    """The frame with those columns, null where they are new."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


