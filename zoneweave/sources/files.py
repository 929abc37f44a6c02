"""Readers and writers of texts, questions, logs and result tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

QUERY_SCHEMA = "id string, question string, required_items array<string>, required_attachments array<string>, gold_ready boolean, gold_missing_items array<string>"
FLOOR_COLUMNS = ("pnu", "jimok", "landuse_code", "landuse", "lot_area_m2", "lot_area_inward_1m_m2", "floor", "height_m", "base_segment_count", "allowed_area_m2")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(source, text) of all matching files below a folder; source is the path relative to it."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    root = re.sub(r"^[a-z]+:/*(?=/)", "", path.rstrip("/")) + "/"
    full = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring_index(full, root, -1).alias("source"), F.col("value").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON array; fields that are missing read as empty lists and ready."""
    q = spark.read.json(path, schema=QUERY_SCHEMA, multiLine=True)
    empty = F.array().cast("array<string>")
    return q.select("id", "question", *[F.coalesce(c, empty).alias(c) for c in ("required_items", "required_attachments")], F.coalesce("gold_ready", F.lit(True)).alias("gold_ready"), F.coalesce("gold_missing_items", empty).alias("gold_missing_items"))


def write_floors(rows: DataFrame, path: str) -> None:
    """Floor rows as Parquet, one folder a scenario label."""
    rows.select("label", *FLOOR_COLUMNS).write.mode("overwrite").partitionBy("label").parquet(path)


def write_csv(rows: DataFrame, path: str, *by: str) -> None:
    """UTF-8 CSV with a header; by: partition folders."""
    w = rows.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_summaries(summary: DataFrame, comparison: DataFrame | None, path: str) -> None:
    """Summary table, and the comparison where the base scenario took part."""
    write_csv(summary, f"{path}/summary", "label")
    if comparison is not None:
        write_csv(comparison, f"{path}/comparison")


def write_qa(warnings: DataFrame, road: DataFrame, centerline: DataFrame, path: str) -> None:
    for name, df in (("warnings", warnings), ("road20m", road), ("centerline", centerline)):
        write_csv(df, f"{path}/{name}")


def qa_log(answers: DataFrame, contexts: DataFrame, mode: str, alpha: float | None, top: int, provider: str, model: str) -> DataFrame:
    """Nested log records of answered questions with their ranked contexts and a slug to name them by."""
    ctx = contexts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("contexts"))
    a = answers.join(ctx, "item_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<struct<rank:int,source:string,text:string>>")))
    retrieval = F.struct(F.lit(mode).alias("mode"), F.lit(alpha).cast("double").alias("alpha"), F.lit(top).alias("top_k"), F.size("contexts").alias("retrieved_count"), "contexts")
    return a.select("item_id", slug(F.col("question")).alias("slug"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("timestamp"), "question", "answer", retrieval.alias("retrieval"), F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model")).alias("llm"))


def write_logs(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").json(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule documents by label, and all of them together."""
    rules.write.mode("overwrite").partitionBy("label").json(f"{path}/by_label")
    rules.write.mode("overwrite").json(f"{path}/all")
