"""Runs of equal floors: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.constants import FLOOR_HEIGHT


def merge_floors(rows: DataFrame, key: Column, dedup: bool = True, by: tuple[str, ...] = ("pnu", "scenario")) -> DataFrame:
    """One record per run of adjacent floors with an equal ring key; a null key has no record and ends a run.

    area and segment count come from the run's first floor. dedup=False: one record a floor. Windows are
    partitioned by parcel and scenario, a group of at most seven rows.
    """
    w = W.partitionBy(*by).orderBy("floor")
    keyed = rows.withColumn("_key", key).where(F.col("_key").isNotNull())
    new = F.lag("_key").over(w).isNull() | (F.lag("_key").over(w) != F.col("_key")) | (F.lag("floor").over(w) != F.col("floor") - 1) | F.lit(not dedup)
    runs = keyed.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "_run").agg(
        F.min("floor").alias("floor_from"), F.max("floor").alias("floor_to"), F.min_by("allowed_area_m2", "floor").alias("area_m2"), F.min_by("base_segment_count", "floor").alias("seg_cnt"),
    )
    return out.drop("_run").withColumns({"h_base_m": (F.col("floor_from") - 1) * FLOOR_HEIGHT, "h_top_m": F.col("floor_to") * FLOOR_HEIGHT})


def merge_totals(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Raw rows, records and the share saved, in percent."""
    return rows.agg(F.count("*").alias("raw")).crossJoin(merged.agg(F.count("*").alias("records"))).withColumn("saved_pct", F.round((1 - F.col("records") / F.greatest(F.col("raw"), F.lit(1))) * 100, 4))
