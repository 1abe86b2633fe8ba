"""Cutting lineage where a lost executor can't take the data with it, and joins by checked size."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame

#: Rows times bytes a row below which the smaller side of a join is sent to every executor.
BROADCAST_BYTES = 64 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the reliable checkpoint folder of the session.

    The folder is the one in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a temporary folder; a cluster must name a shared one.
    """
    _folder(df)
    return df.checkpoint(eager=True)


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="graingrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet beside the session's checkpoints and read back."""
    path = f"{_folder(df)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    _TABLES[id(out)] = (weakref.ref(out), path)
    return out


_TABLES: dict[int, tuple[weakref.ref, str]] = {}


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that :func:`written` gave and nothing reads any more; other frames are left alone."""
    held, path = _TABLES.pop(id(df), (None, ""))
    if held is None or held() is not df:
        return
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the frame, best a checkpointed one, has at most ``limit`` bytes."""
    return df.count() * row_bytes <= limit
