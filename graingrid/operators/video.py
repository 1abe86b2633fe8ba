"""Checks of generated videos: a chain of checkers, each with metric columns of its own; and the gate on first frames.

A checker that fails as a whole leaves its columns null and the others run on. Benchmark scores are joined by the file
names of the videos; judges answer with one JSON object for all their dimensions.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import jsonx, text
from ..functions.rows import POS, truthy, with_pos
from ..sources.media import data_urls
from .imageeval import call_json
from .model import Factory

BENCH = ["motion_smoothness", "dynamic_degree", "imaging_quality", "temporal_flickering"]
FRAMES = ["prompt_consistency", "visual_quality", "subject_consistency"]
WHOLE = ["motion_quality", "temporal_execution", "camera_accuracy"]
SKIPPED = "vbench_skipped_reason"


def stem(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def bench_scores(spark: SparkSession, folder: str) -> DataFrame:
    """dimension, stem and score out of a benchmark's result files, in either layout; of repeated ones the later file's.

    ``{dimension: [mean, [{video_path, video_results}]]}`` or ``{dimension: {"results": {path: score}}}``; what parses as
    neither is passed over.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder)
    dims = files.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    dims = dims.select("file", F.explode(F.from_json(F.col("v").cast("string"), "map<string,string>")).alias("dimension", "raw"))
    listed = F.from_json(F.get_json_object("raw", "$[1]"), "array<string>")
    named = F.from_json(F.get_json_object("raw", "$.results"), "map<string,string>")
    one = dims.where("raw like '[%'").select("file", "dimension", F.posexplode(listed).alias("n", "x")).select("file", "dimension", "n", F.get_json_object("x", "$.video_path").alias("path"), F.get_json_object("x", "$.video_results").alias("r"))
    two = dims.where("raw like '{%'").select("file", "dimension", F.posexplode(F.map_entries(named)).alias("n", "x")).select("file", "dimension", "n", F.col("x.key").alias("path"), F.col("x.value").alias("r")).where("path not in ('mean', 'average')")
    score = F.coalesce(F.col("r").try_cast("double"), F.when(F.col("r") == "true", 1.0).when(F.col("r") == "false", 0.0))
    every = one.unionByName(two).select("dimension", stem(F.col("path")).alias("stem"), score.alias("score"), F.struct("file", "n").alias("at")).where("score is not null and stem <> ''")
    return every.groupBy("dimension", "stem").agg(F.max_by("score", "at").alias("score"))


def local_path(df: DataFrame) -> Column:
    """The first video if it is a local file, without its scheme."""
    first = F.try_element_at(F.col("video_urls"), F.lit(1))
    return F.when(~first.rlike("^https?://"), F.regexp_replace(first, "^file://", ""))


def with_bench(df: DataFrame, scores: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Rows with ``vbench_*`` columns, by the file name of their first local video; null where the benchmark has none."""
    dimensions = BENCH if dimensions is None else dimensions
    wide = scores.where(F.col("dimension").isin(dimensions)).groupBy(F.col("stem").alias("__stem")).pivot("dimension", dimensions).agg(F.first("score"))
    wide = wide.select("__stem", *(F.col(d).alias(f"vbench_{d}") for d in dimensions))
    rows = df.drop(SKIPPED, *(f"vbench_{d}" for d in dimensions)).withColumn("__s", stem(local_path(df)))
    return rows.join(wide, F.col("__s") == F.col("__stem"), "left").drop("__s", "__stem").withColumn(SKIPPED, F.lit(None).cast("string"))


@dataclass
class Checker:
    """Metrics and the function that adds them; ``blank`` gives what a failure leaves."""

    name: str
    metrics: list[str]
    check: Callable[[DataFrame], DataFrame]
    texts: list[str] = field(default_factory=list)

    def blank(self, df: DataFrame, why: str) -> DataFrame:
        new = {m: F.lit(None).cast("string" if m in self.texts else "double") for m in self.metrics if m not in df.columns}
        return df.withColumns(new | ({SKIPPED: F.lit(why)} if self.name == "vbench" else {}))


def bench_checker(folder: str, dimensions: list[str] | None = None) -> Checker:
    """Scores that a benchmark run left in a folder; without any, rows say why they were skipped."""
    dims = BENCH if dimensions is None else dimensions

    def check(df: DataFrame) -> DataFrame:
        scores = bench_scores(df.sparkSession, folder)
        if scores.isEmpty():
            raise ValueError(f"{folder} has no scores of videos")
        return with_bench(df, scores, dims)

    return Checker("vbench", [f"vbench_{d}" for d in dims], check)


def _judge(name: str, make: Factory, metrics: list[str], asked: Callable[[DataFrame], tuple[DataFrame, Column, Column]], **call: Any) -> Checker:
    def check(df: DataFrame) -> DataFrame:
        rows, words, media = asked(with_pos(df))
        got = call_json(rows.where(F.size(media) > 0).select(POS, words.alias("__words"), media.alias("__media")), make, F.col("__words"), F.concat_ws("::", F.lit(name), F.col(POS).cast("string")), F.col("__media"), **call)
        cols = jsonx.judgment_columns(F.get_json_object("json", "$.dimension_judgments"), metrics)
        told = got.where("json is not null").select(POS, *(c.alias(n) for n, c in cols.items()))
        old = [n for n in cols if n in df.columns]
        kept = told.select(POS, F.struct(*cols).alias("__new"))
        out = with_pos(df).join(kept, POS, "left")
        # a row that wasn't judged keeps what it had
        return out.withColumns({n: F.when(F.col("__new").isNotNull(), F.col(f"__new.{n}")).otherwise(F.col(n)) if n in old else F.col(f"__new.{n}") for n in cols}).drop("__new")

    texts = [f"{m}_reason" for m in metrics]
    return Checker(name, [c for m in metrics for c in (m, f"{m}_confidence", f"{m}_reason")], check, texts)


_ASK = "Judge the video for the prompt on {dims}. Answer with a JSON object of dimension_judgments: an array of dimension, applicable, score (0 to 4), confidence and reason.\n{note}\n\nPrompt: {prompt}"


def _prompt(df: DataFrame) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("optimized_prompt", "prompt") if c in df.columns))


def frame_checker(make: Factory, metrics: list[str] | None = None, **call: Any) -> Checker:
    """A judge that sees sampled frames (``frame_urls``), after the conditioning first frame if there is one."""
    metrics = FRAMES if metrics is None else metrics

    def asked(df: DataFrame) -> tuple[DataFrame, Column, Column]:
        frames = F.coalesce("frame_urls", F.array().cast("array<string>")) if "frame_urls" in df.columns else F.coalesce("video_urls", F.array().cast("array<string>"))
        first = truthy(F.col("first_frame_image")) if "first_frame_image" in df.columns else F.lit(False)
        media = F.when(first, F.concat(F.array(F.col("first_frame_image")), frames)).otherwise(frames) if "first_frame_image" in df.columns else frames
        note = F.when(first, "The first image is the frame that the video was to begin with.").otherwise("The images are frames in order; what concerns a given first frame isn't applicable.")
        return df, text.fill(_ASK, dims=F.lit(", ".join(metrics)), note=note, prompt=_prompt(df)), media

    return _judge("vlm", make, metrics, asked, **call)


def whole_checker(make: Factory, metrics: list[str] | None = None, transport: str = "auto", max_bytes: int = 100 << 20, **call: Any) -> Checker:
    """A judge that sees the whole video: by URL, as bytes of the local file, or (auto) by URL where there is one."""
    metrics = WHOLE if metrics is None else metrics
    if transport not in ("auto", "url", "base64"):
        raise ValueError(f"transport {transport} is none of auto, url, base64")

    def asked(df: DataFrame) -> tuple[DataFrame, Column, Column]:
        web = F.try_element_at(F.filter("video_urls", lambda u: u.rlike("^https?://")), F.lit(1))
        if "video_remote_urls" in df.columns:
            web = F.coalesce(F.try_element_at("video_remote_urls", F.lit(1)), web)
        ref = web
        if transport != "url":
            df = data_urls(df.withColumn("__local", local_path(df)), "__local", "__bytes", max_bytes)
            ref = F.col("__bytes") if transport == "base64" else F.coalesce(web, F.col("__bytes"))
        media = F.when(ref.isNotNull(), F.array(ref)).otherwise(F.array().cast("array<string>"))
        return df, text.fill(_ASK, dims=F.lit(", ".join(metrics)), note=F.lit("The whole video is given."), prompt=_prompt(df)), media

    return _judge("omni", make, metrics, asked, **call)


def metric_union(checkers: list[Checker]) -> list[str]:
    """All checkers' metrics in order, each once."""
    return list(dict.fromkeys(m for c in checkers for m in c.metrics))


def check_videos(df: DataFrame, checkers: list[Checker]) -> DataFrame:
    """Rows through all checkers in order; one that raises leaves its columns null."""
    if not checkers:
        raise ValueError("there is no checker")
    df = with_pos(df, dense=True)
    if "id" not in df.columns:
        df = df.withColumn("id", F.col(POS).cast("string"))
    for c in checkers:
        try:
            df = c.check(df)
        except Exception as e:
            df = c.blank(df, f"{type(e).__name__}: {e}")
    return df


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height in the header of a PNG, GIF, BMP, WebP or JPEG image; None for other bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return tuple(v & 0x3FFF for v in struct.unpack("<HH", data[26:30]))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None


@pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _sizes(refs: pd.Series) -> pd.DataFrame:
    def one(ref: str | None) -> tuple[int | None, int | None]:
        try:
            if not ref or ref.startswith(("http://", "https://")):
                return None, None
            data = base64.b64decode(ref.split(",", 1)[1]) if ref.startswith("data:") else Path(ref.removeprefix("file://")).read_bytes()
            return image_size(data) or (None, None)
        except (OSError, ValueError, IndexError):
            return None, None

    return pd.DataFrame([one(r) for r in refs], columns=["width", "height"], dtype="Int32")


def frame_fits(width: Column, height: Column, min_edge: int = 256, max_aspect: float = 3.0) -> Column:
    """Whether a frame's short edge and shape are in bounds; unknown sizes pass."""
    short, long = F.least(width, height), F.greatest(width, height)
    return F.coalesce((short >= min_edge) & ((short == 0) | (long / F.nullif(short, F.lit(0)) <= max_aspect)), F.lit(True))


def check_first_frames(df: DataFrame, policy: str = "off", min_edge: int = 256, max_aspect: float = 3.0, frame: str = "first_frame_image") -> DataFrame:
    """Rows whose first frame is too small or too narrow: kept (off), marked in ``frame_warning`` (warn), dropped (skip), or raised (raise)."""
    if policy not in ("off", "warn", "skip", "raise"):
        raise ValueError(f"policy {policy} is none of off, warn, skip, raise")
    if policy == "off" or frame not in df.columns:
        return df
    sized = df.withColumn("__size", _sizes(F.col(frame)))
    fits = frame_fits(F.col("__size.width"), F.col("__size.height"), min_edge, max_aspect)
    if policy == "skip":
        return sized.where(fits).drop("__size")
    told = F.when(~fits, F.concat(F.col("__size.width").cast("string"), F.lit("x"), F.col("__size.height").cast("string")))
    if policy == "raise":
        told = F.when(~fits, F.raise_error(F.concat(F.lit("first frame is out of bounds: "), told)).cast("string"))
    return sized.withColumn("frame_warning", told).drop("__size")
