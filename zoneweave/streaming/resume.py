"""Resumable work by district: a manifest of finished keys, and file ingestion that remembers what it read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not in the manifest: an anti join."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def manifest(spark: SparkSession, path: str, key: str = "district") -> DataFrame:
    """Finished keys with status and time; empty where the manifest does not exist yet."""
    try:
        return spark.read.schema(f"{key} string, status string, at timestamp").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{key} string, status string, at timestamp")
        raise


def mark(spark: SparkSession, path: str, key: str, value: str, status: str = "done") -> None:
    row = spark.range(1).select(F.lit(value).alias(key), F.lit(status).alias("status"), F.current_timestamp().alias("at"))
    row.write.mode("append").json(path)


def log_line(spark: SparkSession, path: str, line: str) -> None:
    """One line of the run log, on disk when this returns: a run that dies keeps its log."""
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(line).alias("line")).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("at timestamp, line string").json(path).orderBy("at")


def run_districts(spark: SparkSession, districts: list[str], step: Callable[[str], None], path: str, log: str | None = None) -> dict[str, str]:
    """Each district that is not done, in order; a failure is recorded and does not stop the others.

    The list of districts is a plan of a few dozen names, not data. log: a folder for the run log, if one is wanted.
    """
    done = {r.district for r in manifest(spark, path).where("status = 'done'").select("district").collect()}
    out = {}
    for d in districts:
        if d in done:
            out[d] = "skipped"
            continue
        try:
            step(d)
            out[d] = "done"
        except Exception as e:
            out[d] = f"failed: {type(e).__name__}: {e}"
        mark(spark, path, "district", d, "done" if out[d] == "done" else "failed")
        if log:
            log_line(spark, log, f"{d}: {out[d]}")
    return out


def ingest_new_files(spark: SparkSession, path: str, schema: str, target: str, checkpoint: str, kind: str = "parquet") -> None:
    """Append rows of files not read before to a Parquet table, then stop: the checkpoint is the manifest."""
    q = (
        spark.readStream.format(kind).schema(schema).load(path).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
