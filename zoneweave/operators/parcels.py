"""Parcel classification and the building-use join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.constants import APARTMENT_USE, REGULATED, RESIDENTIAL, ROAD, zone_name


def landuse_code(raw: Column) -> Column:
    """Null is empty; blanks and one trailing '.0' go."""
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[.]0$", "")


def kind(jimok: Column) -> Column:
    """'road' for the road category or none at all, else 'lot'."""
    return F.when(F.coalesce(jimok, F.lit("")).isin(ROAD, ""), "road").otherwise("lot")


def is_apartment(flag: Column) -> Column:
    return F.upper(F.trim(F.coalesce(flag, F.lit("")))) == "Y"


def field(df: DataFrame, name: str, default) -> Column:
    """A column, or the default where the table lacks it or the value is null."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def is_target(code: Column) -> Column:
    return code.isin(*RESIDENTIAL)


def is_regulated(code: Column) -> Column:
    return code.isin(*REGULATED)


def is_residential_apartment(apartment: Column, code: Column) -> Column:
    return apartment & is_target(code)


def classify(raw: DataFrame) -> DataFrame:
    """Adds landuse_code, landuse (zone name) and kind."""
    code = landuse_code(F.col("landuse_raw"))
    return raw.withColumn("landuse_code", code).withColumn("landuse", zone_name(code)).withColumn("kind", kind(F.col("jimok")))


def building_summary(buildings: DataFrame, key: str = "part_key") -> DataFrame:
    """Per parcel: number of buildings, use of the first in file order, Y if any is an apartment."""
    return buildings.groupBy(key).agg(
        F.count("*").alias("build_cnt"), F.min_by("use_code", "ordinal").alias("build_use"),
        F.when(F.bool_or(F.col("use_code") == APARTMENT_USE), "Y").otherwise("N").alias("apt_yn"),
    )


def add_buildings(parcels: DataFrame, buildings: DataFrame, key: str = "part_key") -> DataFrame:
    """Left join of the summary; parcels without a building get 0, '' and N."""
    out = parcels.join(building_summary(buildings, key), key, "left")
    return out.withColumns({"build_cnt": F.coalesce("build_cnt", F.lit(0)), "build_use": F.coalesce("build_use", F.lit("")), "apt_yn": F.coalesce("apt_yn", F.lit("N"))})


def apartment_counts(parcels: DataFrame) -> DataFrame:
    """Parcels, Y and N counts and the share of Y, by zone and over all (zone null)."""
    return parcels.rollup("landuse_code").agg(
        F.count("*").alias("parcels"), F.count_if(F.col("apt_yn") == "Y").alias("apt_y"), F.count_if(F.col("apt_yn") == "N").alias("apt_n"),
        F.round(F.count_if(F.col("apt_yn") == "Y") / F.count("*") * 100, 4).alias("apt_share"),
    )


def zone_histogram(parcels: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent zones among lots; the report shows ten."""
    return parcels.where("kind = 'lot'").groupBy("landuse_code").agg(F.count("*").alias("lots")).orderBy(F.desc("lots"), "landuse_code").limit(top)


def first_targets(parcels: DataFrame, limit: int | None, ordinal: str = "part_key") -> DataFrame:
    """Residential lots, the first `limit` in file order where it is positive."""
    out = parcels.where((F.col("kind") == "lot") & is_target(F.col("landuse_code")))
    return out.orderBy(ordinal).limit(limit) if limit and limit > 0 else out


def by_pnu(parcels: DataFrame, pnu: str, ordinal: str = "part_key") -> DataFrame:
    """First parcel with this number; none if absent."""
    return parcels.where(F.col("pnu") == pnu).orderBy(ordinal).limit(1)


def by_pnus(parcels: DataFrame, pnus: list[str], ordinal: str = "part_key") -> DataFrame:
    """The first parcel of each number, in the numbers' order; a number that is absent raises."""
    found = parcels.where(F.col("pnu").isin(*pnus)).groupBy("pnu").agg(F.min(ordinal).alias(ordinal))
    out = parcels.join(F.broadcast(found), ["pnu", ordinal]).dropDuplicates(["pnu"])  # as many rows as numbers asked for
    if missing := set(pnus) - {r.pnu for r in found.collect()}:
        raise ValueError(f"no parcel {sorted(missing)}")
    return out


def kept_columns(parcels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Those of the named columns that the table has, in this order."""
    return parcels.select(*[c for c in names if c in parcels.columns])


#: Codes and names of the city's districts.
DISTRICTS = {
    "11110": "종로구", "11140": "중구", "11170": "용산구", "11200": "성동구", "11215": "광진구", "11230": "동대문구", "11260": "중랑구", "11290": "성북구", "11305": "강북구",
    "11320": "도봉구", "11350": "노원구", "11380": "은평구", "11410": "서대문구", "11440": "마포구", "11470": "양천구", "11500": "강서구", "11530": "구로구", "11545": "금천구",
    "11560": "영등포구", "11590": "동작구", "11620": "관악구", "11650": "서초구", "11680": "강남구", "11710": "송파구", "11740": "강동구",
}


def district_name(code: Column) -> Column:
    """Name of a district code; the code itself where it is unknown."""
    names = F.create_map(*[F.lit(x) for kv in DISTRICTS.items() for x in kv])
    return F.coalesce(F.element_at(names, code), code)


def pair_files(parcel_files: DataFrame, building_files: DataFrame) -> DataFrame:
    """Parcel and building files with one district code; paired is false where a side is missing."""
    from ..functions.text import file_code

    p = parcel_files.select(F.col("name").alias("parcel_file"), file_code(F.col("name")).alias("code"))
    b = building_files.select(F.col("name").alias("building_file"), file_code(F.col("name")).alias("code"))
    return p.join(b, "code", "full").withColumn("paired", F.col("parcel_file").isNotNull() & F.col("building_file").isNotNull())


def union_visible(targets: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Targets and their neighbours, each parcel once, targets first."""
    both = targets.withColumn("_side", F.lit(0)).unionByName(neighbors.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    first = both.groupBy("pnu").agg(F.min("_side").alias("_side"))
    return both.join(first, ["pnu", "_side"]).dropDuplicates(["pnu"]).withColumn("is_target", F.col("_side") == 0).drop("_side")
