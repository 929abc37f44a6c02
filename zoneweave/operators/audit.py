"""Output audit: rules as counted violations in one aggregate, plus histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.constants import EXTENT, FLOOR_HEIGHT, FLOORS

FIELDS = ("pnu", "floor_from", "floor_to", "type", "h_base_m", "h_top_m", "zone_cd", "area_m2", "seg_cnt")


def missing_fields(df: DataFrame) -> list[str]:
    return [c for c in FIELDS if c not in df.columns]


def audit(records: DataFrame) -> DataFrame:
    """Records and the number that break each rule: floor order and range, heights, ring and extent (with a ring column)."""
    f, t = F.col("floor_from"), F.col("floor_to")
    checks = {
        "bad_floors": ~((f >= 1) & (f <= t) & (t <= FLOORS)),
        "bad_base": F.abs(F.col("h_base_m") - (f - 1) * FLOOR_HEIGHT) > 0.01,
        "bad_top": F.abs(F.col("h_top_m") - t * FLOOR_HEIGHT) > 0.01,
        "bad_area": F.col("area_m2") < 0,
    }
    if "ring" in records.columns:
        r = F.col("ring")
        x0, x1, y0, y1 = EXTENT
        checks["bad_ring"] = (F.size(r) < 4) | (F.element_at(r, 1) != F.element_at(r, -1))
        checks["out_of_extent"] = ~F.forall(r, lambda p: (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1))
    return records.agg(F.count("*").alias("records"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])


def span_histogram(records: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent floor spans, as the report shows them."""
    return records.groupBy("floor_from", "floor_to").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "floor_from", "floor_to").limit(top)


def type_histogram(records: DataFrame, by: str = "scenario") -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("records"), F.round(F.avg(F.col("floor_to") - F.col("floor_from") + 1), 4).alias("mean_floors"))


def area_stats(records: DataFrame, area: str = "area_m2") -> DataFrame:
    """Least, largest and upper median (element n div 2 of the sorted areas) of positive areas.

    percentile_disc() takes element ceil(p*n), the lower median; the upper one is its mirror image.
    """
    a = records.where(F.col(area) > 0)
    return a.agg(F.min(area).alias("min_area"), F.max(area).alias("max_area"), F.expr(f"-percentile_disc(0.5) within group (order by -{area})").alias("upper_median"))


def zone_check(records: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return records.groupBy("zone_cd").agg(F.count("*").alias("records")).withColumn("known", F.col("zone_cd").isin(*allowed))
