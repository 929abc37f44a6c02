"""Fixed values of the regulation domain, as plain tables and as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scenario type, label, low threshold, low setback, mid threshold, mid setback, slope ratio.
SCENARIOS = (
    (1, "A", 10.0, 1.5, None, None, 0.5),
    (2, "B", 10.0, 1.5, 17.0, 5.0, 0.5),
    (3, "C", 10.0, 1.5, 14.0, 5.0, 0.5),
    (4, "D", 10.0, 1.5, 20.0, 5.0, 0.5),
    (5, "E", 10.0, 2.0, 17.0, 5.0, 0.5),
    (6, "F", 10.0, 1.5, 17.0, 5.0, 0.4),
)
SCENARIO_SCHEMA = "scenario int, label string, low_threshold double, low_setback double, mid_threshold double, mid_setback double, slope_ratio double"

# Zone code and name.
ZONES = {
    "0": "지정되지않음", "11": "제1종전용주거지역", "12": "제2종전용주거지역", "13": "제1종일반주거지역", "14": "제2종일반주거지역",
    "15": "제3종일반주거지역", "16": "준주거지역", "17": "일반주거지역", "21": "중심상업지역", "22": "일반상업지역", "23": "근린상업지역",
    "24": "유통상업지역", "31": "전용공업지역", "32": "일반공업지역", "33": "준공업지역", "41": "보전녹지지역", "42": "생산녹지지역",
    "43": "자연녹지지역", "44": "개발제한구역", "51": "용도미지정지역", "61": "관리지역", "62": "보전관리지역", "63": "생산관리지역",
    "64": "계획관리지역", "71": "농림지역", "81": "자연환경보전지역",
}
ZONE_UNKNOWN = "미확인"

# Zone sets, distances in metres, tolerances, floors, extents.
RESIDENTIAL = ("13", "14", "15", "17")
REGULATED = ("11", "12", "13", "14", "15", "17")
ROAD = "도로"
APARTMENT_USE = "02000"
TOL, SNAP = 0.001, 0.1
ROAD_EXCLUSION, INWARD, SIMPLIFY, MIN_RUN = 20.0, 1.0, 0.3, 0.5
BATCH_DISTANCE, PREFILTER_DISTANCE, SURFACE_TOP = 21.0, 300.0, 27.0
FLOOR_HEIGHT, FLOORS = 3.0, 7
EXTENT = (185000.0, 220000.0, 535000.0, 575000.0)
DISTRICTS_CODE_PART = 3


def scenarios(spark: SparkSession) -> DataFrame:
    """Six rows; null mid values mean that there is no middle step."""
    row = lambda s: ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v) for v in s)
    names = [c.split()[0] for c in SCENARIO_SCHEMA.split(", ")]
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({row(s)})" for s in SCENARIOS) + f" AS t({', '.join(names)})")
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCENARIO_SCHEMA.split(", ")])


def floors(spark: SparkSession, n: int = FLOORS) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("floor"), (F.col("id") * FLOOR_HEIGHT).alias("height_m"))


def zone_name(code: Column) -> Column:
    """Name of a zone code, the default for unknown ones; a map literal, so no join is needed."""
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.coalesce(F.element_at(names, code), F.lit(ZONE_UNKNOWN))
