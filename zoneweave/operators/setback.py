"""Setback rules, floor areas on rectangular lots, and the statistics built on floor rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.constants import BATCH_DISTANCE, INWARD, ROAD_EXCLUSION, SCENARIOS, TOL, floors, scenarios
from .parcels import is_regulated, is_residential_apartment, is_target


def setback(height: Column) -> Column:
    """Depth at a height under a joined scenario row; both thresholds belong to the lower rule."""
    return (
        F.when(height <= F.col("low_threshold"), F.col("low_setback"))
        .when(F.col("mid_threshold").isNotNull() & (height <= F.col("mid_threshold")), F.col("mid_setback"))
        .otherwise(height * F.col("slope_ratio"))
    )


def setback_table(spark: SparkSession, n_floors: int = 7) -> DataFrame:
    """Depth for each scenario and floor: 42 rows but only nine distinct depths."""
    return scenarios(spark).crossJoin(floors(spark, n_floors)).select("scenario", "label", "floor", "height_m", setback(F.col("height_m")).alias("setback_m"))


def scenario_valid(scenario: Column) -> Column:
    """Whether a scenario number is known."""
    return F.coalesce(scenario.isin(*[s[0] for s in SCENARIOS]), F.lit(False))


def check_scenario(spark: SparkSession, scenario: int) -> int:
    """The scenario number, or an error unless it is known."""
    if not scenarios(spark).where(F.col("scenario") == scenario).take(1):
        raise ValueError(f"unknown scenario {scenario}")
    return scenario


#: Rows of the grid that may hold a lot within reach of a lot's northern edge: pitch 20 m, lots at most as deep.
NEXT_ROWS = 3


def base_lines(parcels: DataFrame) -> DataFrame:
    """Residential lots of the rectangular grid with the lot that sets their northern base line.

    The nearest lot to the north in the column owns the line; roads are skipped. A target meets the cells (column, row) of the next
    rows by an equi-join, so groups stay as small as a cell whatever the table's size. Adds owner_pnu, gap_m (of a lot in the
    next NEXT_ROWS rows), base (is there a line), effective_gap_m (half to an apartment lot), and two QA flags.
    """
    lots = parcels.where("kind = 'lot'")
    own = lots.where(is_target(F.col("landuse_code")))
    ahead = own.select("pnu", "col", F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEXT_ROWS)), lambda i: F.col("row") + i)).alias("row"))
    there = lots.select("col", "row", F.struct("pnu", "y0", "landuse_code", "apt_yn").alias("lot"))
    nearest = ahead.join(there, ["col", "row"]).groupBy("pnu").agg(F.min_by("lot", "row").alias("north"))
    north = own.join(nearest, "pnu", "left")
    gap = F.col("north.y0") - (F.col("y0") + F.col("depth"))
    out = north.withColumn("gap_m", gap)
    reach = F.col("north").isNotNull() & (F.col("gap_m") < BATCH_DISTANCE)
    regulated = is_regulated(F.col("north.landuse_code"))
    apartment = is_residential_apartment(F.col("north.apt_yn") == "Y", F.col("north.landuse_code")) & (F.col("gap_m") > TOL)
    base = F.coalesce(reach & regulated, F.lit(False))
    return out.withColumns(
        {
            "base": base, "owner_pnu": F.when(reach, F.col("north.pnu")),
            "effective_gap_m": F.when(base, F.when(apartment, F.col("gap_m") / 2).otherwise(F.col("gap_m"))),
            "qa_road20m": F.coalesce(reach & ~regulated & (F.col("gap_m") >= ROAD_EXCLUSION - TOL), F.lit(False)),
            "qa_centerline": F.coalesce(base & apartment, F.lit(False)),
        }
    ).drop("north")


def floor_rows(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """One row per scenario, target and floor with the buildable area of a rectangular lot.

    Areas are computed once for each distinct depth and joined to the 42 scenario floors, both tables of
    fixed size, so the fact rows are made without a shuffle.
    """
    table = setback_table(spark)
    depths = table.select("setback_m").distinct()
    inner_w, low = F.col("width") - 2 * INWARD, F.lit(INWARD)
    top = F.least(F.col("depth") - INWARD, F.coalesce(F.col("depth") + F.col("effective_gap_m") - F.col("setback_m"), F.col("depth") - INWARD))
    area = inner_w * F.greatest(F.lit(0.0), top - low)
    areas = targets.crossJoin(F.broadcast(depths)).withColumns({"top_m": top, "allowed_area_m2": F.round(area, 4)})
    return areas.join(F.broadcast(table), "setback_m").select(
        "scenario", "label", "pnu", "jimok", "landuse_code", "landuse", F.round(F.col("width") * F.col("depth"), 4).alias("lot_area_m2"),
        F.round(inner_w * (F.col("depth") - 2 * INWARD), 4).alias("lot_area_inward_1m_m2"), "floor", "height_m", "setback_m",
        F.col("base").cast("int").alias("base_segment_count"), "allowed_area_m2", "x0", "y0", "width", "top_m",
    )


def zero_fill(rows: DataFrame, failed: str = "failed", area: str = "allowed_area_m2") -> DataFrame:
    """From a parcel's first failing floor on, all areas of that scenario are 0."""
    bad = F.min(F.when(F.col(failed), F.col("floor"))).over(W.partitionBy("scenario", "pnu"))
    return rows.withColumn("_bad", bad).withColumn(area, F.when(F.col("floor") >= F.col("_bad"), 0.0).otherwise(F.col(area))).drop("_bad")


def floor_summary(rows: DataFrame) -> DataFrame:
    """Per scenario, zone and floor: mean, population deviation and median, and the zone's distinct parcels.

    Floor 0 (no inward ring) is left out, zero-filled floors are not. Both aggregates combine partially.
    """
    rows = rows.where("floor > 0")
    stats = rows.groupBy("scenario", "label", "landuse", "floor").agg(
        F.round(F.avg("allowed_area_m2"), 4).alias("mean_area"), F.round(F.stddev_pop("allowed_area_m2"), 4).alias("std_area"), F.round(F.median("allowed_area_m2"), 4).alias("median_area"),
    )
    parcels = rows.groupBy("scenario", "landuse").agg(F.count_distinct("pnu").alias("parcel_count"))
    return stats.join(parcels, ["scenario", "landuse"]).select("scenario", "label", "landuse", "parcel_count", "floor", "mean_area", "std_area", "median_area")


def scenario_comparison(summary: DataFrame, base: int = 1) -> DataFrame:
    """Each other scenario's mean against the base at the same zone and floor; a missing base counts as 0."""
    a = summary.where(F.col("scenario") == base).select("landuse", "floor", F.col("mean_area").alias("base_mean"))
    out = summary.where(F.col("scenario") != base).join(a, ["landuse", "floor"], "left").withColumn("base_mean", F.coalesce("base_mean", F.lit(0.0)))
    diff = F.col("mean_area") - F.col("base_mean")
    pct = F.when(F.col("base_mean") > 0, diff / F.col("base_mean") * 100).otherwise(0.0)
    return out.select("scenario", "label", "landuse", "floor", "base_mean", "mean_area", F.round(pct, 4).alias("change_pct"), F.round(diff, 4).alias("change_abs"))


def volume_by_scenario(summary: DataFrame, base: int = 1) -> DataFrame:
    """Sum over floors of mean areas by scenario and zone, and the change against the base in percent."""
    v = summary.groupBy("scenario", "label", "landuse").agg(F.sum("mean_area").alias("volume"))
    a = v.where(F.col("scenario") == base).select("landuse", F.col("volume").alias("base_volume"))
    return v.join(a, "landuse", "left").select("scenario", "label", "landuse", F.round("volume", 4).alias("volume"), (F.round((F.col("volume") / F.col("base_volume") - 1) * 100, 4) + F.lit(0.0)).alias("change_pct"))


def weighted_change(summary: DataFrame, base: int = 1) -> DataFrame:
    """Change by floor, zones weighted by their parcels."""
    a = summary.where(F.col("scenario") == base).select("landuse", "floor", F.col("mean_area").alias("base_mean"))
    j = summary.where(F.col("scenario") != base).join(a, ["landuse", "floor"])
    n = F.col("parcel_count")
    return j.groupBy("scenario", "label", "floor").agg(F.round((F.sum(n * F.col("mean_area")) / F.sum(n * F.col("base_mean")) - 1) * 100, 4).alias("change_pct"))


def parcel_change(rows: DataFrame, before: int = 1, after: int = 2, at: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Per parcel: area on the given floors under two scenarios and the change in percent of the inward area (0 without one)."""
    r = rows.where(F.col("floor").isin(*at) & F.col("scenario").isin(before, after))
    out = r.groupBy("pnu", "landuse", "lot_area_inward_1m_m2").agg(
        F.sum(F.when(F.col("scenario") == before, F.col("allowed_area_m2"))).alias("area_before"), F.sum(F.when(F.col("scenario") == after, F.col("allowed_area_m2"))).alias("area_after"),
    )
    inward = F.col("lot_area_inward_1m_m2")
    rate = F.when(inward > 0, (F.col("area_after") - F.col("area_before")) / inward * 100).otherwise(0.0)
    return out.dropna(subset=["area_before", "area_after"]).select("pnu", "landuse", F.round("area_before", 4).alias("area_before"), F.round("area_after", 4).alias("area_after"), F.round(rate, 4).alias("change_rate"))


def map_rows(lots: DataFrame, changes: DataFrame) -> DataFrame:
    """All lots of a map with their change rate; lots without one keep null."""
    return lots.join(changes.select("pnu", "change_rate"), "pnu", "left")


def change_bins(changes: DataFrame, low: float = 0.0, high: float = 30.0, step: float = 2.0) -> DataFrame:
    """Histogram of change rates clipped to [low, high], bins of `step`."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("change_rate")))
    bin_ = F.least(F.floor((clipped - low) / step), F.lit(int((high - low) / step) - 1))
    return changes.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("parcels"), F.min("change_rate").alias("min_rate"), F.max("change_rate").alias("max_rate"))


def change_stats(changes: DataFrame) -> DataFrame:
    return changes.agg(F.min("change_rate").alias("min_rate"), F.max("change_rate").alias("max_rate"), F.round(F.median("change_rate"), 4).alias("median_rate"), F.count("*").alias("parcels"))


def cutter_surfaces(rows: DataFrame, top: float = 27.0) -> DataFrame:
    """Vertical, step, middle and slope quads of a base segment (x0, y0, x1, y1) of a scenario row, up to `top`."""
    at = lambda d, z: (F.struct(F.col("x0").alias("x"), (F.col("y0") - d).alias("y"), z.alias("z")), F.struct(F.col("x1").alias("x"), (F.col("y1") - d).alias("y"), z.alias("z")))

    def quad(name, d0, z0, d1, z1):
        a, b = at(d0, z0)
        c, d = at(d1, z1)
        return F.struct(F.lit(name).alias("part"), F.array(a, b, d, c).alias("quad"))

    z = lambda v: F.lit(float(v))
    low, lt, mid, mt, s = (F.col(c) for c in ("low_setback", "low_threshold", "mid_setback", "mid_threshold", "slope_ratio"))
    has = mt.isNotNull()
    start_d, start_z = F.coalesce(mid, low), F.coalesce(mt, lt)
    parts = F.array(
        quad("vertical", low, z(0), low, lt),
        F.when(has, quad("step", low, lt, mid, lt)), F.when(has, quad("middle", mid, lt, mid, mt)),
        F.when(start_z * s != start_d, quad("slope_step", start_d, start_z, start_z * s, start_z)),
        quad("slope", start_z * s, start_z, z(top) * s, z(top)),
    )
    return rows.withColumn("surface", F.explode(F.filter(parts, lambda p: p.isNotNull()))).select(*rows.columns, "surface.part", "surface.quad")
