"""Parcels, buildings, chunks and questions derived from the generic tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import ROAD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parcel a part: a grid of 40 columns, pitch 30 m by 20 m. landuse_raw carries '.0' on odd keys."""
    k = F.col("p_partkey")
    col, row = F.pmod(k, F.lit(40)), F.floor(k / 40)
    zones = F.array(*[F.lit(z) for z in ("11", "13", "14", "15", "17", "21")])
    zone = F.get(zones, F.pmod(k, F.lit(6)).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.lpad(k.cast("string"), 10, "0")).alias("pnu"), k.alias("part_key"), col.alias("col"), row.alias("row"),
        (col * 30).cast("double").alias("x0"), (row * 20).cast("double").alias("y0"), (12 + F.pmod(col, F.lit(9))).cast("double").alias("width"),
        (14 + F.pmod(F.col("p_size"), F.lit(7))).cast("double").alias("depth"),
        F.when(F.pmod(k, F.lit(11)) == 0, ROAD).when(F.pmod(k, F.lit(37)) == 0, "").otherwise("대").alias("jimok"),
        F.when(F.pmod(k, F.lit(2)) == 1, F.concat(F.lit(" "), zone, F.lit(".0"))).otherwise(zone).alias("landuse_raw"),
    )


#: Columns that order line items as a file would; unique in all scale factors.
ORDINAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One building a line item: parcel key, use code and file position."""
    use = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50), "02000").otherwise("01000")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), use.alias("use_code"), F.struct(*ORDINAL).alias("ordinal"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.coalesce("text", F.lit("")).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; their sentences of 40 and more characters are what an answer must hold."""
    pieces = F.filter(F.transform(F.split(F.col("text"), r"[.\n]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 40)
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), pieces.alias("required_items"), (F.pmod(F.col("item_id"), F.lit(3)) != 0).alias("gold_ready"))
