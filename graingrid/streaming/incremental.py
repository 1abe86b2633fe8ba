"""Incremental jobs: a folder of JSON lines read as a stream, each new file's rows worked on once, results appended.

The stream's checkpoint says which files are done, so a job that was cut off
goes on where it stopped; a batch that was cut off itself is written again
under its own number, which replaces what it had left. Nothing is kept in
memory between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import POS, with_pos
from ..operators.joins import finished, resume_key, split_done
from ..sources.jsonl import read_jsonl, write_jsonl


def process_new_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> int:
    """Works on the files that came since the last call; gives the number of batches. Each batch is a folder ``batch=N`` of Parquet below ``sink``."""
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def resumed(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, kind: str) -> DataFrame:
    """Rows of a stage whose output, JSON lines at ``path``, may be there in part from a run that was cut off.

    Rows that it has complete are taken from it, the last of each key; only the others are worked on, and their results
    appended at once, so that no finished call is made again. Rows are known by id, else by prompt and first frame.
    """
    spark = df.sparkSession
    frame = lambda d: F.col("first_frame_image") if "first_frame_image" in d.columns else None
    name = lambda d: F.coalesce(*(F.col(c) for c in ("raw_prompt", "original_prompt", "prompt") if c in d.columns), F.lit(""))
    keyed = lambda d: d.withColumn("_key", resume_key(F.col("id") if "id" in d.columns else F.lit(None), name(d), frame(d)))
    rows = keyed(with_pos(df, dense=True))

    def earlier() -> DataFrame | None:
        try:
            old = read_jsonl(spark, path)
        except AnalysisException:
            return None
        return None if old.columns == [POS] or old.isEmpty() else finished(keyed(old), kind)

    old = earlier()
    left = rows if old is None else split_done(rows, old)[1]
    if not left.isEmpty():
        write_jsonl(work(left.drop("_key")), path, mode="append")
    all_of_it = earlier()
    if all_of_it is None:
        return work(left.drop("_key").where("false"))
    order = rows.select("_key", F.col(POS).alias("__at"))
    return all_of_it.drop(POS).join(order, "_key").drop("_key").withColumnRenamed("__at", POS)


def completed(spark: SparkSession, sink: str, kind: str, key: str = "_key") -> DataFrame:
    """The last complete row of each key of all batches written so far."""
    rows = spark.read.parquet(sink)
    return finished(rows.withColumn("_pos", F.col("batch").cast("bigint") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)).drop("batch"), kind, key)
