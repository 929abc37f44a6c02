"""Setback rule, zero fill, ranges and invariants of the scenarios."""

from pyspark.sql import functions as F

from zoneweave.operators import audit, ranges, setback
from zoneweave.plans.catalog import summary
from zoneweave.plans.constants import scenarios

from conftest import SF

# Derived by hand from the rule: depths at floors 1..7.
DEPTHS = {
    "A": [1.5, 1.5, 1.5, 6, 7.5, 9, 10.5], "B": [1.5, 1.5, 1.5, 5, 5, 9, 10.5], "C": [1.5, 1.5, 1.5, 5, 7.5, 9, 10.5],
    "D": [1.5, 1.5, 1.5, 5, 5, 5, 10.5], "E": [2, 2, 2, 5, 5, 9, 10.5], "F": [1.5, 1.5, 1.5, 5, 5, 7.2, 8.4],
}


def test_depths(spark):
    got = {}
    for r in setback.setback_table(spark).orderBy("floor").collect():
        got.setdefault(r.label, []).append(round(r.setback_m, 9))
    assert got == DEPTHS
    assert setback.setback_table(spark).select("setback_m").distinct().count() == 9


def test_boundaries_belong_to_the_lower_rule(spark):
    s = scenarios(spark).crossJoin(spark.sql("SELECT explode(array(10D, 14D, 17D, 20D, 10.01D)) AS h"))
    got = {(r.label, r.h): r.s for r in s.select("label", "h", setback.setback(F.col("h")).alias("s")).collect()}
    assert got["A", 10.0] == 1.5 and abs(got["A", 10.01] - 5.005) < 1e-9
    assert got["B", 17.0] == 5.0 and got["C", 14.0] == 5.0 and got["D", 20.0] == 5.0 and got["C", 17.0] == 8.5


def test_invariants(spark):
    m = {(r.label, r.landuse, r.floor): r.mean_area for r in summary(spark, SF).collect()}
    for z in {k[1] for k in m}:
        assert m["B", z, 4] == m["B", z, 5] and m["D", z, 6] == m["D", z, 4]
        assert m["C", z, 5] <= m["B", z, 5] and m["E", z, 1] <= m["F", z, 1] and m["F", z, 6] >= m["E", z, 6]
        assert m["B", z, 7] == m["C", z, 7] == m["D", z, 7] and m["E", z, 4] == m["F", z, 4]


def test_zero_fill(spark):
    rows = spark.sql("SELECT 1 AS scenario, 'p' AS pnu, id AS floor, id = 4 AS failed, 9D AS allowed_area_m2 FROM range(1, 8)")
    got = [r.allowed_area_m2 for r in setback.zero_fill(rows).orderBy("floor").collect()]
    assert got == [9, 9, 9, 0, 0, 0, 0]


def test_merge(spark):
    rows = spark.sql("SELECT 'p' AS pnu, 1 AS scenario, * FROM VALUES (1, 'a', 5D, 1), (2, 'a', 5D, 1), (3, NULL, 0D, 0), (4, 'a', 5D, 1), (6, 'a', 4D, 2), (7, 'b', 3D, 1) AS t(floor, k, allowed_area_m2, base_segment_count)")
    got = sorted((r.floor_from, r.floor_to, r.area_m2, r.seg_cnt, r.h_base_m, r.h_top_m) for r in ranges.merge_floors(rows, F.col("k")).collect())
    assert got == [(1, 2, 5, 1, 0, 6), (4, 4, 5, 1, 9, 12), (6, 6, 4, 2, 15, 18), (7, 7, 3, 1, 18, 21)]
    assert ranges.merge_floors(rows, F.col("k"), dedup=False).count() == 5


def test_audit_counts_what_is_wrong(spark):
    r = spark.sql("SELECT * FROM VALUES (1, 2, 0D, 6D, 1D), (3, 2, 6D, 6D, 1D), (1, 8, 0D, 24D, -1D) AS t(floor_from, floor_to, h_base_m, h_top_m, area_m2)")
    got = audit.audit(r).first()
    assert (got.records, got.bad_floors, got.bad_base, got.bad_top, got.bad_area) == (3, 2, 0, 0, 1)
    a = spark.sql("SELECT explode(array(4D, 1D, 3D, 2D, 0D)) AS area_m2")
    assert audit.area_stats(a).first().upper_median == 3


def test_cutter_surfaces(spark):
    rows = scenarios(spark).selectExpr("*", "0D AS x0", "0D AS y0", "5D AS x1", "0D AS y1")
    parts = {(r.label, r.part) for r in setback.cutter_surfaces(rows).select("label", "part").collect()}
    assert ("A", "middle") not in parts and ("B", "middle") in parts and ("A", "slope") in parts
