"""Shapefile source and sink: polygons with dBase attributes, in pure Python."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "cp949")


def read_dbf(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[list[str], list[dict]]:
    """Field names and rows; text in the first encoding that decodes the whole table, else an error."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    raw = []
    for i in range(n):
        row, pos = data[head + i * size : head + (i + 1) * size], 1
        cells = []
        for _, _, width in fields:
            cells.append(row[pos : pos + width])
            pos += width
        raw.append(cells)
    for enc in encodings:
        try:
            rows = [{f[0]: c.decode(enc).strip() for f, c in zip(fields, cells, strict=True)} for cells in raw]
            return [f[0] for f in fields], rows
        except UnicodeDecodeError:
            continue
    raise ValueError(f"attributes are in none of {encodings}")


def read_shp(data: bytes) -> Iterator[tuple[list[int], list[tuple[float, float]]] | None]:
    """Part offsets and points of each record; null shapes give None."""
    at = 100
    while at + 8 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (3, 5, 13, 15, 23, 25):
            n, m = struct.unpack_from("<ii", data, at + 44)
            parts = list(struct.unpack_from(f"<{n}i", data, at + 52))
            flat = struct.unpack_from(f"<{2 * m}d", data, at + 52 + 4 * n)
            yield parts, list(zip(flat[::2], flat[1::2], strict=True))
        else:
            yield None
        at += 8 + length


RECORD = "district string, ordinal long, attributes map<string,string>, parts array<int>, points array<struct<x:double,y:double>>"


def _read(pairs, encodings):
    for row in pairs:
        if row.shp is None or row.dbf is None:
            raise ValueError(f"{row.path}: .{'shp' if row.shp is None else 'dbf'} is missing")
        _, rows = read_dbf(bytes(row.dbf), encodings)
        shapes = list(read_shp(bytes(row.shp)))
        if len(shapes) != len(rows):
            raise ValueError(f"{row.path}: {len(shapes)} shapes for {len(rows)} rows of attributes")
        for i, (shape, attrs) in enumerate(zip(shapes, rows, strict=True)):
            yield row.district, i, attrs, shape[0] if shape else None, shape[1] if shape else None


def decode_shapefiles(files: DataFrame, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Shapes of (path, district, shp, dbf) rows; a row without one of the two, or with unequal counts, is an error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = list(_read(pdf.itertuples(index=False), encodings))
            points = [None if r[4] is None else [{"x": x, "y": y} for x, y in r[4]] for r in rows]
            yield pd.DataFrame({"district": [r[0] for r in rows], "ordinal": [r[1] for r in rows], "attributes": [r[2] for r in rows], "parts": [r[3] for r in rows], "points": points})

    return files.select("path", "district", "shp", "dbf").mapInPandas(run, RECORD)


def companions(spark: SparkSession, path: str) -> DataFrame:
    """One row a .shp or .dbf of a folder: path without extension, district (its last part), and the contents of shp, dbf, shx, prj."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    stem, ext = F.regexp_extract("path", r"^(.*)\.([^./]+)$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.withColumn("stem", stem).withColumn("ext", ext).where("ext in ('shp', 'dbf', 'shx', 'prj')")
    content = [F.max(F.when(F.col("ext") == e, F.col("content"))).alias(e) for e in ("shp", "dbf", "shx", "prj")]
    by = files.groupBy(F.col("stem").alias("path")).agg(*content).where("shp is not null or dbf is not null")
    return by.select("path", F.element_at(F.split("path", "/"), -1).alias("district"), "shp", "dbf", "shx", "prj")


def read_shapefiles(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """All shapes of the .shp files of a folder (or of one path): district, ordinal, attributes, parts, points.

    Files come through binaryFile, so any store that Spark reads will do; files that share a whole path but for the
    extension belong together, and one task reads one of them. A missing or mismatched companion is an error.
    """
    return decode_shapefiles(companions(spark, path), encodings)


def parcels_from_shapes(shapes: DataFrame) -> DataFrame:
    """Typed parcels of raw shapes: pnu, jimok, landuse_raw, apt_flag, ring and holes; shapes without an outer ring go."""
    from ..functions.geometry import hole_rings, outer_ring, split_parts

    a = lambda k, d: F.coalesce(F.element_at("attributes", k), F.lit(d))
    rings = split_parts(F.col("points"), F.col("parts"))
    out = shapes.where("points is not null").withColumn("_rings", rings)
    out = out.select("district", "ordinal", a("A1", "Unknown").alias("pnu"), a("A11", "Unknown").alias("jimok"), a("A13", "").alias("landuse_raw"), a("APT_YN", "N").alias("apt_flag"), outer_ring(F.col("_rings")).alias("ring"), hole_rings(F.col("_rings")).alias("holes"))
    return out.where("ring is not null")


#: Fields of an exported range feature (name, type, width, decimals).
FEATURE_FIELDS = (("pnu", "C", 20, 0), ("floor_from", "N", 2, 0), ("floor_to", "N", 2, 0), ("type", "N", 1, 0), ("h_base_m", "N", 6, 2), ("h_top_m", "N", 6, 2), ("zone_cd", "C", 3, 0), ("area_m2", "N", 12, 4), ("seg_cnt", "N", 3, 0))
PRJ = 'PROJCS["KGD2002_Central_Belt_2010"]'


def pack_features(rows: list[dict], fields=FEATURE_FIELDS, encoding: str = "utf-8") -> tuple[bytes, bytes, bytes]:
    """.shp, .shx and .dbf bytes of rows with a 'ring' and the fields; text fields are cut to their width in bytes, at a whole character."""
    shp, shx, at, box = [], [], 50, [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for i, r in enumerate(rows):
        pts = [(p["x"], p["y"]) if isinstance(p, dict) else tuple(p) for p in r["ring"]]
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        box = [min(box[0], *xs), min(box[1], *ys), max(box[2], *xs), max(box[3], *ys)]
        body = struct.pack("<i4d3i", 5, min(xs), min(ys), max(xs), max(ys), 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        shp.append(struct.pack(">2i", i + 1, len(body) // 2) + body)
        shx.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    box = box if rows else [0.0] * 4
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)
    width = 1 + sum(f[2] for f in fields)
    dbf = [struct.pack("<B3BIHH20x", 3, 26, 1, 1, len(rows), 33 + 32 * len(fields), width)]
    dbf += [struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in fields] + [b"\r"]
    for r in rows:
        dbf.append(b" ")
        for n, t, w, d in fields:
            v = r.get(n)
            text = "" if v is None or v != v else str(v) if t == "C" else f"{float(v):.{d}f}"
            raw = text.encode(encoding)[:w].decode(encoding, "ignore").encode(encoding)
            dbf.append(raw.ljust(w) if t == "C" else raw.rjust(w))
    shp, shx = b"".join(shp), b"".join(shx)
    return head(len(shp)) + shp, head(len(shx)) + shx, b"".join(dbf) + b"\x1a"


#: Features of one exported file, about: a district with more gets several files, so that no group is unbounded.
FILE_FEATURES = 100_000


def export_features(records: DataFrame, by: tuple[str, ...] = ("district", "type"), fields=FEATURE_FIELDS, order: tuple[str, ...] = ("pnu", "floor_from"), encoding: str = "utf-8") -> DataFrame:
    """One row a file, (by.., part), with its bytes (shp, shx, dbf, prj), for any sink that writes binaries.

    A group of more than FILE_FEATURES records is dealt to several parts by a hash of the order columns. Within a file rows stand in
    this order. encoding: of text fields, utf-8 or cp949.
    """
    kept = [*by, *[f[0] for f in fields if f[0] not in by], "ring"]
    sizes = records.groupBy(*by).agg(F.ceil(F.count("*") / FILE_FEATURES).cast("int").alias("parts"))
    dealt = records.select(*dict.fromkeys([*kept, *order])).join(sizes, list(by)).withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts")).cast("int")).drop("parts")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*by).schema.fields)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(list(order), kind="stable")
        shp, shx, dbf = pack_features(pdf.to_dict("records"), fields, encoding)
        return pd.DataFrame([(*[pdf[c].iloc[0] for c in by], int(pdf["part"].iloc[0]), shp, shx, dbf, PRJ)], columns=[*by, "part", "shp", "shx", "dbf", "prj"])

    return dealt.groupBy(*by, "part").applyInPandas(run, f"{types}, part int, shp binary, shx binary, dbf binary, prj string")


def verify(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """Checks of (path, shp, shx, dbf, prj) rows: companions there, a Korean grid in the prj, missing fields, features, rings
    that are open or have under four points, and ok, which only a missing .shp or no feature makes false."""
    names = [f[0] for f in FEATURE_FIELDS]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shapes = [] if r.shp is None else list(read_shp(bytes(r.shp)))
                fields = [] if r.dbf is None else read_dbf(bytes(r.dbf), (encoding,))[0]
                prj = r.prj if isinstance(r.prj, str) else bytes(r.prj).decode("utf-8", "replace") if r.prj is not None else ""
                bad = sum(s is None or len(s[1]) < 4 or s[1][0] != s[1][-1] for s in shapes)
                out.append((r.path, r.shx is not None, r.dbf is not None, any(w in prj for w in KOREA), [n for n in names if n not in fields], len(shapes), bad, bool(shapes)))
            yield pd.DataFrame(out, columns=["path", "has_shx", "has_dbf", "korean_grid", "missing", "features", "bad_rings", "ok"])

    return files.select("path", "shp", "shx", "dbf", "prj").mapInPandas(run, "path string, has_shx boolean, has_dbf boolean, korean_grid boolean, missing array<string>, features long, bad_rings long, ok boolean")


#: Words of a Korean grid in a projection file.
KOREA = ("Korea_2000", "Central_Belt", "127.0")


def first_shapefile(spark: SparkSession, path: str) -> str:
    """The path itself, or the first .shp by name in a folder of any store that Spark reads."""
    if path.lower().endswith(".shp"):
        return path
    names = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".shp")).agg(F.min("path")).first()[0]
    if not names:
        raise FileNotFoundError(f"no shapefile in {path}")
    return names
