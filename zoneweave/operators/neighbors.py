"""Box-distance neighbours by a grid join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.constants import BATCH_DISTANCE, TOL

#: Side of a grid cell in metres.
CELL = 50.0


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))


def box_neighbors(targets: DataFrame, others: DataFrame, radius: float = BATCH_DISTANCE, cell: float = CELL, key: str = "pnu") -> DataFrame:
    """Pairs (target, other) whose boxes, the target's grown by the radius, overlap or touch; not with itself.

    Each box goes to the grid cells that it meets and cells join by equality, so no nested-loop join is
    planned. A pair is emitted only in the cell that holds the lower-left corner of the common box, hence
    once, without a distinct. Columns bx0, by0, bx1, by1 on both sides.
    """
    r = max(radius, TOL)
    grow = lambda df, d, p: df.select(F.col(key).alias(p + "key"), *[(F.col(c) + s * d).alias(p + c) for c, s in (("bx0", -1), ("by0", -1), ("bx1", 1), ("by1", 1))])

    def on_grid(df, p):
        df = df.withColumn("cx", F.explode(_cells(F.col(p + "bx0"), F.col(p + "bx1"), cell)))
        return df.withColumn("cy", F.explode(_cells(F.col(p + "by0"), F.col(p + "by1"), cell)))

    t, o = on_grid(grow(targets, r, "t_"), "t_"), on_grid(grow(others, 0.0, "o_"), "o_")
    j = t.join(o, ["cx", "cy"])
    touch = (F.col("t_bx0") <= F.col("o_bx1")) & (F.col("o_bx0") <= F.col("t_bx1")) & (F.col("t_by0") <= F.col("o_by1")) & (F.col("o_by0") <= F.col("t_by1"))
    corner = (F.floor(F.greatest("t_bx0", "o_bx0") / cell) == F.col("cx")) & (F.floor(F.greatest("t_by0", "o_by0") / cell) == F.col("cy"))
    return j.where(touch & corner & (F.col("t_key") != F.col("o_key"))).select(F.col("t_key").alias("target_" + key), F.col("o_key").alias("owner_" + key))


def qa_rows(targets: DataFrame, flag: str, owner: str = "owner_pnu") -> DataFrame:
    """One row per flagged target and distinct owner, sorted; a blank owner where the flag has none."""
    owners = targets.where(F.col(flag)).groupBy("pnu").agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    return owners.select(F.col("pnu").alias("target_pnu"), F.explode_outer("owners").alias("owner_pnu")).withColumn("owner_pnu", F.coalesce("owner_pnu", F.lit("")))
