"""Session with the settings that the engine's plans assume."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, at most; it is counted first.
BROADCAST_ROWS = 200_000


def session(master: str | None = None, partitions: int | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName("zoneweave").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A temporary one serves in local mode only: elsewhere executors cannot read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="zoneweave-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, for tables that are written once and read back."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df through a table in the shared folder: made once, where a checkpoint makes its last stage twice."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int:
    """Tasks for rows of few bytes and much work, which sizes in bytes would leave in one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few rows, as counted; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
