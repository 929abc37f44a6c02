"""Further registered queries: sources and sinks, small operators, regulation texts and kernel shapes with known areas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.text import file_code, slug
from ..operators import audit as au
from ..operators import chunks as ch
from ..operators import evaluate as ev
from ..operators import kernel as kn
from ..operators import parcels as pc
from ..operators import ranges as rg
from ..operators import retrieval as rt
from ..operators import rings
from ..operators import rules as ru
from ..operators import setback as sb
from ..session import cut, shared_path, small
from ..sources import files as fs
from ..sources import shapefile as shp
from . import catalog as ct
from .views import chunks, questions, raw_parcels, table

# ---- sources and sinks, written to the shared folder and read back

#: Fields of a parcel file.
PARCEL_FIELDS = (("A1", "C", 19, 0), ("A11", "C", 8, 0), ("A13", "C", 6, 0), ("APT_YN", "C", 3, 0))


def parcel_files(spark, sf_dir) -> DataFrame:
    """Parcels as shapefiles in cp949, one district for each remainder of the column by 4."""
    p = raw_parcels(spark, sf_dir)
    flag = F.when(F.pmod("part_key", F.lit(3)) == 0, " y").when(F.pmod("part_key", F.lit(3)) == 1, "N").otherwise("Y")
    rows = p.select(F.concat(F.lit("d"), F.pmod("col", F.lit(4)).cast("string")).alias("district"), F.col("pnu").alias("A1"), F.col("jimok").alias("A11"), F.col("landuse_raw").alias("A13"), flag.alias("APT_YN"), ct.ring().alias("ring"))
    out = shp.export_features(rows, ("district",), PARCEL_FIELDS, ("A1",), "cp949")
    return out.withColumn("path", F.concat_ws("/", F.lit("files"), "district", F.col("part").cast("string")))


def shapefile_parcels(spark, sf_dir) -> DataFrame:
    """Parcels written as shapefiles and read back, typed and classified."""
    read = shp.parcels_from_shapes(shp.decode_shapefiles(parcel_files(spark, sf_dir), ("utf-8", "cp949")))
    out = pc.classify(read)
    return out.select("pnu", "district", "jimok", "landuse_code", "landuse", "kind", pc.is_apartment(F.col("apt_flag")).alias("apartment"), g.parcel_area(F.col("ring"), F.col("holes")).alias("area"))


def shapefile_checks(spark, sf_dir) -> DataFrame:
    """Range features written as shapefiles and verified: companions, grid, fields, features and rings."""
    records = ring_ranges(spark, sf_dir).withColumns({"district": F.lit("d"), "type": F.col("scenario"), "zone_cd": F.lit("13")})
    files = shp.export_features(records, ("district", "type")).withColumn("path", F.concat_ws("/", "district", F.col("type").cast("string")))
    return shp.verify(files).select("path", "has_shx", "has_dbf", "korean_grid", F.size("missing").alias("missing"), "features", "bad_rings", "ok")


def floor_files(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "floors")
    fs.write_floors(ct.floors(spark, sf_dir), path)
    return spark.read.parquet(path).select("label", *fs.FLOOR_COLUMNS)


def summary_files(spark, sf_dir) -> DataFrame:
    """Summary and comparison tables as CSV, read back and put together."""
    path, s = shared_path(spark, "summaries"), ct.summary(spark, sf_dir)
    fs.write_summaries(s, sb.scenario_comparison(s), path)
    read = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{path}/{name}")
    a = read("summary", "scenario int, landuse string, parcel_count long, floor int, mean_area double, std_area double, median_area double, label string")
    b = read("comparison", "scenario int, label string, landuse string, floor int, base_mean double, mean_area double, change_pct double, change_abs double")
    return a.join(b.select("scenario", "landuse", "floor", "change_pct", "change_abs"), ["scenario", "landuse", "floor"], "left").select("scenario", "label", "landuse", "floor", "parcel_count", "mean_area", "std_area", "median_area", "change_pct", "change_abs")


def qa_files(spark, sf_dir) -> DataFrame:
    path, rows = shared_path(spark, "qa"), ct.qa_rows(spark, sf_dir)
    part = lambda kind: rows.where(F.col("kind") == kind).drop("kind")
    fs.write_qa(ct.targets(spark, sf_dir).where("gap_m is null").select("pnu"), part("road20m"), part("centerline"), path)
    read = lambda kind: spark.read.schema("target_pnu string, owner_pnu string").option("header", True).csv(f"{path}/{kind}").select(F.lit(kind).alias("kind"), "target_pnu", "owner_pnu")
    w = spark.read.schema("pnu string").option("header", True).csv(f"{path}/warnings").select(F.lit("warnings").alias("kind"), F.col("pnu").alias("target_pnu"), F.lit(None).cast("string").alias("owner_pnu"))
    return read("road20m").unionByName(read("centerline")).unionByName(w)


def stored_index_topk(spark, sf_dir) -> DataFrame:
    """BM25 over an index that was saved under a key of its corpus and loaded again."""
    index = rt.Index.stored(chunks(spark, sf_dir), shared_path(spark, "indexes"))
    return rt.top_k(rt.lexical_scores(index, questions(spark, sf_dir), ("bm25",)), "bm25", 5)


def answer_logs(spark, sf_dir) -> DataFrame:
    """Questions with their three best contexts, answered by the offline client and logged as JSON."""
    q = questions(spark, sf_dir)
    top = cut(small(cut(ct.ranked(spark, sf_dir, [("bm25",)], 3).drop("candidate"))).join(chunks(spark, sf_dir), "chunk_id"))  # read for prompts and logs
    context = ru.context_text(top, "item_id", 3)
    prompts = q.join(context, "item_id", "left").select("item_id", "question", ru.prompt("Answer.", F.col("question"), F.coalesce("context", F.lit(""))).alias("prompt"))
    answers = ru.ask(prompts, "item_id").join(q.select("item_id", "question"), "item_id")
    path = shared_path(spark, "logs")
    fs.write_logs(fs.qa_log(answers, top, "bm25", None, 3, "offline", "stub"), path)
    read = spark.read.json(path)
    return read.select("item_id", "slug", F.col("retrieval.mode").alias("mode"), F.col("retrieval.top_k").alias("top_k"), F.col("retrieval.retrieved_count").alias("retrieved_count"), F.get("retrieval.contexts", F.lit(0))["rank"].alias("first_rank"), F.col("llm.provider").alias("provider"))


def rule_files(spark, sf_dir) -> DataFrame:
    """Rules of all questions but the finished ones (ids divisible by 4) under their output labels, as JSON by label."""
    q = questions(spark, sf_dir).select(F.col("item_id").cast("string").alias("label"), F.col("question").alias("prompt"))
    done = q.where("cast(label as long) % 4 = 0")
    rules = ru.structure(q, "label", done)
    known = F.when(F.col("label") == "1", "Q0_포괄질의").otherwise(F.col("label"))
    path = shared_path(spark, "rules")
    fs.write_rules(rules.withColumn("label", ru.output_label(known)), path)
    read = spark.read.json(f"{path}/by_label")
    valid = ru.validate(read.withColumn("label", F.col("label").cast("string")), "label")
    keys = ru.missing_keys(F.json_object_keys(F.get_json_object("json", "$[0]")), list(ru.REQUIRED))
    return read.select(F.col("label").cast("string").alias("label"), "attempts", F.size(keys).alias("missing_keys")).join(valid.select("label", "article_id"), "label")


# ---- small operators


def file_pairs(spark, sf_dir) -> DataFrame:
    """Parcel and building files paired by the district code in their names."""
    n = table(spark, sf_dir, "nation").withColumn("code", F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))
    a = n.where("n_nationkey % 3 <> 0").select(F.concat_ws("_", F.lit("LSMD"), F.lit("P"), "code", F.lit("a.shp")).alias("name"))
    b = n.where("n_nationkey % 2 = 0").select(F.concat_ws("_", F.lit("AL"), F.lit("B"), "code", F.lit("b.shp")).alias("name"))
    return pc.pair_files(a, b).select("code", "parcel_file", "building_file", "paired")


def first_targets(spark, sf_dir) -> DataFrame:
    """The report of the first 25 residential lots in file order."""
    return pc.first_targets(pc.classify(raw_parcels(spark, sf_dir)), 25).select("pnu", "landuse_code")


def parcel_pair(spark, sf_dir) -> DataFrame:
    """Two parcels by number, as the single-lot entry asks for them; an absent one is an error."""
    return pc.by_pnus(pc.classify(raw_parcels(spark, sf_dir)), ["P0000000007", "P0000000011"]).select("pnu", "landuse", "kind")


def parcel_columns(spark, sf_dir) -> DataFrame:
    """What the join keeps of a parcel: six attributes and the ring (its points and box), whatever else the table has."""
    p = ct.parcels(spark, sf_dir).withColumns({"ring": ct.ring(), "A13": F.col("landuse_raw")})
    keep = pc.kept_columns(p, ("pnu", "jimok", "A13", "apt_yn", "build_cnt", "build_use", "missing", "ring"))
    box = g.bbox(F.col("ring"))
    return keep.select(*[c for c in keep.columns if c != "ring"], F.size("ring").alias("points"), box["x1"].alias("bx1"))


def scenario_checks(spark, sf_dir) -> DataFrame:
    """Which of the scenario numbers that customers' keys stand for are known."""
    return table(spark, sf_dir, "customer").select("c_custkey", sb.scenario_valid(F.pmod("c_custkey", F.lit(9)).cast("int")).alias("known"))


def zero_filled(spark, sf_dir) -> DataFrame:
    """Floors where each parcel of a key divisible by 7 fails from floor 5 on, in scenario 2 from floor 3 on."""
    f = ct.floors(spark, sf_dir).withColumn("key", F.substring("pnu", 2, 10).cast("long"))
    failed = (F.pmod("key", F.lit(7)) == 0) & (F.col("floor") == F.when(F.col("scenario") == 2, 3).otherwise(5))
    return sb.zero_fill(f.withColumn("failed", failed)).select("scenario", "pnu", "floor", "allowed_area_m2")


def single_floors(spark, sf_dir) -> DataFrame:
    """Range records without merging: one a floor."""
    return rg.merge_floors(ct.floors(spark, sf_dir), F.when(F.col("top_m") > 1, F.round("top_m", 3)), dedup=False)


def floor_ring():
    """Ring of a floor's buildable rectangle inside the lot, in the extent of the city."""
    x, y = F.col("x0") + 190000, F.col("y0") + 540000
    return F.when(F.col("top_m") > 1, g.rectangle(x + 1, y + 1, x + F.col("width") - 1, y + F.col("top_m")))


def ring_ranges(spark, sf_dir) -> DataFrame:
    """Floors merged where their rings are equal to the millimetre; numbers and zones cut to their widths."""
    f = ct.floors(spark, sf_dir).withColumn("ring", floor_ring())
    out = rg.merge_floors(f, g.ring_key(F.col("ring")))
    first = f.select("pnu", "scenario", F.col("floor").alias("floor_from"), "ring", F.substring("landuse_code", 1, 3).alias("zone"))
    return out.join(first, ["pnu", "scenario", "floor_from"]).withColumn("pnu", F.substring("pnu", 1, 20))


def ring_range_records(spark, sf_dir) -> DataFrame:
    r = ring_ranges(spark, sf_dir)
    return r.select("pnu", "scenario", "floor_from", "floor_to", "area_m2", "seg_cnt", "zone", F.round(g.area(F.col("ring")), 2).alias("ring_area"))


def ring_audit(spark, sf_dir) -> DataFrame:
    """All audit rules, rings and extent included; every 50th parcel is moved out of the city, every 70th ring opened."""
    key = F.substring("pnu", 2, 10).cast("long")
    r = ring_ranges(spark, sf_dir).withColumn("ring", F.when(F.pmod(key, F.lit(50)) == 0, g.translate(F.col("ring"), F.lit(99999.0), F.lit(0.0))).when(F.pmod(key, F.lit(70)) == 0, F.slice("ring", 1, 4)).otherwise(F.col("ring")))
    return au.audit(r)


def parcel_map(spark, sf_dir) -> DataFrame:
    """All lots for the map, with the change rate of those that have one."""
    lots = ct.parcels(spark, sf_dir).where("kind = 'lot'").select("pnu", "landuse")
    return sb.map_rows(lots, sb.parcel_change(ct.floors(spark, sf_dir)))


def parcel_rings(spark, sf_dir) -> DataFrame:
    """Rings of parcels as parts of a shape: an open single part, one with a hole, one open part of two; moved, lifted, keyed."""
    p = raw_parcels(spark, sf_dir)
    x0, y0, w, d = (F.col(c) for c in ("x0", "y0", "width", "depth"))
    outer, hole, case = ct.ring(), g.rectangle(x0 + 2, y0 + 2, x0 + 5, y0 + 4), F.pmod("part_key", F.lit(4))
    points = F.when(case == 0, F.slice(outer, 1, 4)).when(case == 1, F.concat(outer, hole)).when(case == 2, F.concat(F.slice(outer, 1, 4), hole)).otherwise(outer)
    parts = F.when(case == 1, F.array(F.lit(0), F.lit(5))).when(case == 2, F.array(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0)))
    r = p.select("pnu", g.split_parts(points, parts).alias("parts"))
    r = r.select("pnu", g.outer_ring(F.col("parts")).alias("ring"), g.hole_rings(F.col("parts")).alias("holes"))
    moved, up = g.bbox(g.translate(F.col("ring"), F.lit(10.0), F.lit(-5.0))), g.lift(F.col("ring"), F.lit(9.0))
    key = g.ring_key(g.translate(F.col("ring"), F.lit(0.0004), F.lit(0.0)))
    return r.select("pnu", F.when(F.col("ring").isNotNull(), g.parcel_area(F.col("ring"), F.col("holes"))).alias("area"), F.size("holes").alias("holes"), moved["x0"].alias("moved_x0"), moved["y1"].alias("moved_y1"), F.get(up, F.lit(0))["z"].alias("z"), (key == g.ring_key(F.col("ring"))).cast("double").alias("same_key"))


def district_names(spark, sf_dir) -> DataFrame:
    """Names of the district codes in file names."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("_", F.lit("A"), F.lit("B"), (F.lit(11000) + F.pmod("c_custkey", F.lit(80)) * 10).cast("int").cast("string"), F.lit("x.shp")).alias("name"))
    return names.select("c_custkey", file_code(F.col("name")).alias("code"), pc.district_name(file_code(F.col("name"))).alias("district"))


# ---- regulation texts made of part keys


def laws(spark, sf_dir) -> DataFrame:
    """A regulation a part: preface, a titled article, a deleted one, a contents stub, an article with a sub-number, page footer,
    addendum, an article behind it; every fifth is an appendix by its name, every seventh has no heading."""
    k = F.col("p_partkey")
    s = k.cast("string")
    body = F.concat(
        F.lit("서문 "), s, F.lit("\n제1조(목적) 이 법은 "), s, F.lit("호 대지의 높이를 정함을 목적으로 한다.\n제2조 삭제 <1999>\n제3조(차례)\n# 제4조의2(높이) ① 높이는 "), s,
        F.lit("미터 이하로 하며 그 밖의 경우는 따로 정한다.\n\n법제처 3 국가법령정보센터\n\n\n\n부칙 <2001>\n이 법은 공포한 날부터 시행한다.\n■ 건축법 [별표 "), s, F.lit("] 일조 높이제한 표\n내용 "), s, F.lit("\n제5조(기타) 1. 그 밖에 필요한 사항은 조례로 정하고 공고한다."),
    )
    named = F.pmod(k, F.lit(5)) == 0
    source = F.when(named, F.concat(F.lit("법 별표 "), s, F.lit(".md"))).otherwise(F.concat(F.lit("law"), s, F.lit(".md")))
    text = F.when(named, F.concat(F.lit(" 표 "), s, F.lit("\n\n\n\n\n끝 "))).when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("본문 "), s)).otherwise(body)
    return table(spark, sf_dir, "part").select(source.alias("source"), text.alias("text"))


def law_articles(spark, sf_dir) -> DataFrame:
    return ch.article_chunks(laws(spark, sf_dir)).select("source", "article_id", "article_title", "section_type", "text", "char_count")


def law_rollup(spark, sf_dir) -> DataFrame:
    return ch.article_rollup(ch.article_chunks(laws(spark, sf_dir)).where("section_type = 'article'"))


def law_chunk_stats(spark, sf_dir) -> DataFrame:
    return ch.chunk_stats(ch.article_chunks(laws(spark, sf_dir)))


def law_chunks(spark, sf_dir) -> DataFrame:
    k = F.regexp_extract("source", r"(\d+)\.md$", 1).cast("long")
    c = ch.article_chunks(laws(spark, sf_dir)).where("section_type <> 'unknown'")
    return c.select((k * 10 + F.least("pos", F.lit(9))).alias("chunk_id"), "source", "text")


def law_questions(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    q = F.concat(F.lit("제 "), F.pmod(n, F.lit(6)).cast("string"), F.lit(" 조의 "), F.when(F.pmod(n, F.lit(2)) == 0, "일조 기준과 높이제한은?").otherwise("높이 제한은?"))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("item_id"), q.alias("question"), F.array(F.concat(F.lit("별표 "), (n * 8).cast("string"))).alias("required_attachments"), F.array(F.lit("높 이")).alias("required_items"), (F.pmod(n, F.lit(2)) == 0).alias("gold_ready"))


def law_boosts(spark, sf_dir) -> DataFrame:
    """Boosts of the signals that questions name: article numbers and fixed words, in text or source, spaces or not."""
    return rt.boosts(rt.Index(law_chunks(spark, sf_dir)), law_questions(spark, sf_dir))


def law_readiness(spark, sf_dir) -> DataFrame:
    """Readiness with attachments: what no chunk that mentions an attachment names is missing."""
    c = law_chunks(spark, sf_dir).withColumn("text", F.concat(F.when(F.pmod("chunk_id", F.lit(20)) == 5, "별첨 ").otherwise(""), "text"))
    q = law_questions(spark, sf_dir)
    missing = ev.missing_attachments(q, c)
    results = c.where("chunk_id = 10").crossJoin(q.select("item_id")).withColumn("rank", F.lit(1))
    return ev.question_metrics(q, results, missing).join(missing, "item_id", "left").select("item_id", "recall", "precision", "mrr", "ready", "right", F.coalesce("missing_attachments", F.lit(0)).alias("missing_attachments"))


def retrieve_default(spark, sf_dir) -> DataFrame:
    """The whole retrieval with its default mode, boosts included (these questions name none)."""
    return rt.retrieve(rt.Index(chunks(spark, sf_dir)), questions(spark, sf_dir), 5, "hybrid").select("item_id", "chunk_id", "score", "rank")


ANSWERS = ('[{{"article_id": "{k}", "R": 1, "S": 2}}]', 'text ```json\n{{"c": {k}}}\n``` end [9', "so [1, {k}] it is", 'yes {{"d": {{"e": {k}}}}} no', "[1, {k}", "plain {k}", '{{"x": [], "y": [{{"article_id": "{k}", "R": 1, "S": {{}}}}, {{"R": 1}}]}}')


def answer_forms(spark, sf_dir) -> DataFrame:
    """Salvaged JSON of answers that are whole, fenced, bracketed, braced, cut off and plain; and their valid articles."""
    k = F.col("c_custkey")
    form = F.get(F.array(*[F.lit(a.replace("{{", "{").replace("}}", "}")) for a in ANSWERS]), F.pmod(k, F.lit(len(ANSWERS))).cast("int"))
    df = table(spark, sf_dir, "customer").select("c_custkey", F.replace(form, F.lit("{k}"), k.cast("string")).alias("answer"))
    j = df.select("c_custkey", ru.salvage(F.col("answer")).alias("json"))
    n = ru.validate(j, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("articles"))
    return j.join(n, "c_custkey", "left").select("c_custkey", "json", F.coalesce("articles", F.lit(0)).alias("articles"))


def slugs(spark, sf_dir) -> DataFrame:
    return questions(spark, sf_dir).select("item_id", slug(F.concat(F.lit("  질문 "), "question")).alias("slug"))


# ---- kernel shapes with areas in closed form

DEPTHS = (0.0, 1.5, 5.0, 9.0)


def _pts(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def _areas(rows_of):
    """Kernel areas of a lot with its northern neighbours, made from a row, for all depths."""

    def make(r):
        own, lots = rows_of(r)
        own = kn.clean([*own, own[0]])
        base, _, _ = kn.base_segments(own, [{"pnu": f"N{i}", "ring": kn.clean([*p, p[0]]), "zone": "14", "apartment": False} for i, p in enumerate(lots)])
        inner = kn.offset_inward(own)
        out = []
        for d in DEPTHS:
            area, ring = kn.buildable(own, inner, base, d)
            same = ring is None if area == 0 else ring is not None and abs(kn.signed_area(np.array(ring)) - area) < 1e-5
            out.append((float(area), bool(same)))
        return len(base), [round(a, 4) + 0.0 for a, _ in out], all(s for _, s in out)

    return make


def _kernel_study(spark, sf_dir, columns, rows_of) -> DataFrame:
    p = raw_parcels(spark, sf_dir).withColumn("rise", (F.pmod("part_key", F.lit(5)) - 2) * 0.5)
    out = rings.apply_rings(p, "pnu", columns, _areas(rows_of), "segments int, areas array<double>, rings_match boolean")
    return out.select("pnu", "segments", "rings_match", F.posexplode("areas").alias("i", "area")).select("pnu", "segments", "rings_match", F.get(F.array(*[F.lit(d) for d in DEPTHS]), F.col("i")).alias("distance"), "area")


def kernel_sloped(spark, sf_dir) -> DataFrame:
    """Lots with a sloped northern edge that a neighbour touches along its whole length."""

    def rows_of(r):
        w, d, s = r.width, r.depth, r.rise
        return [(0, 0), (w, 0), (w, d + s), (0, d)], [[(0, d), (w, d + s), (w, d + 40), (0, d + 40)]]

    return _kernel_study(spark, sf_dir, ["width", "depth", "rise"], rows_of)


def kernel_concave(spark, sf_dir) -> DataFrame:
    """L-shaped lots, with a neighbour in the notch and another north of the long arm."""

    def rows_of(r):
        w, h = r.width, 2 * r.depth
        return [(0, 0), (w, 0), (w, h), (w / 2, h), (w / 2, h / 2), (0, h / 2)], [[(0, h / 2), (w / 2, h / 2), (w / 2, h), (0, h)], [(w / 2, h), (w, h), (w, h + 20), (w / 2, h + 20)]]

    return _kernel_study(spark, sf_dir, ["width", "depth"], rows_of)


HEIGHTS = (0.0, 3.0, 6.0, 9.0, 12.0, 15.0, 18.0)


def visual_heights(spark, sf_dir) -> DataFrame:
    """The visual batch of all targets: buildable rings of seven heights under scenario 1, simplified by opening and lifted."""
    p = ct.targets(spark, sf_dir)
    depth_of = {h: 1.5 if h <= 10 else h * 0.5 for h in HEIGHTS}

    def make(r):
        out = []
        gap = None if r.effective_gap_m is None or math.isnan(r.effective_gap_m) else r.effective_gap_m
        own = kn.clean([(0, 0), (r.width, 0), (r.width, r.depth), (0, r.depth), (0, 0)])
        inner, y = kn.offset_inward(own), r.depth
        base = [] if gap is None else [(0.0, y + gap, r.width, y + gap)]
        for h in HEIGHTS:
            _, ring = kn.buildable(own, inner, base, depth_of[h])
            ring = None if ring is None else rings.opening(kn.clean(ring), 0.3)
            out.append(None if ring is None else [{"x": x, "y": v, "z": h} for x, v in ring.tolist()])
        return (out,)

    # rings start at the lot's own corner, on which neither areas nor heights depend, so that lots of one shape are one
    rows = rings.apply_rings(p, "pnu", ["width", "depth", "effective_gap_m"], make, "levels array<array<struct<x:double,y:double,z:double>>>")
    flat = rows.select("pnu", F.posexplode("levels").alias("level", "ring"))
    return flat.select("pnu", "level", F.col("ring").isNull().alias("empty"), F.get("ring", F.lit(0))["z"].alias("z"), F.when(F.col("ring").isNotNull(), F.round(g.area(F.col("ring")), 4)).alias("area"))


def surface_quads(spark, sf_dir) -> DataFrame:
    """Cutter surfaces of all scenarios over a base segment of each target."""
    t = ct.targets(spark, sf_dir).where("base").select("pnu", "x0", (F.col("y0") + F.col("depth")).alias("y0"), (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("depth")).alias("y1"))
    s = sb.cutter_surfaces(t.crossJoin(F.broadcast(sb.scenarios(spark))))
    q = F.col("quad")
    corner = lambda i, c: F.get(q, F.lit(i))[c].alias(f"{c}{i}")
    return s.select("pnu", "scenario", "part", F.round(F.col("y0") - F.get(q, F.lit(0))["y"], 6).alias("d_low"), corner(0, "z"), F.round(F.col("y0") - F.get(q, F.lit(3))["y"], 6).alias("d_high"), corner(3, "z"))


def ring_operators(spark, sf_dir) -> DataFrame:
    """Each parcel's rectangle with one moved by (3, 4): set operations, offsets, opening, containment, rays and preprocessing."""
    p = raw_parcels(spark, sf_dir)

    def make(r):
        a = kn.clean([(0, 0), (r.width, 0), (r.width, r.depth), (0, r.depth), (0, 0)])
        b = a + np.array([3.0, 4.0])
        sets = [round(rings.area([a], [b], op), 4) for op in ("union", "intersection", "difference", "xor")]
        grown, shut = kn.signed_area(rings.offset_outward(a, 1.0)), kn.signed_area(rings.opening(a, 0.3))
        where = [rings.containment(a, *q) for q in ((1, 1), (0, 1), (-1, 1))]
        noisy = [(0, 0), (r.width / 2, 0.05), (r.width, 0), (r.width, r.depth), (r.width / 2, r.depth + 0.5), (0, r.depth), (0, 0)]
        kept = rings.preprocess(noisy)
        bow = rings.preprocess([(0, 0), (r.width, r.depth), (r.width, 0), (0, r.depth), (0, 0)])
        return (*sets, round(grown, 4), round(shut, 4), where, rings.kth_hit(5.0, 1.0, [a, b], 0), rings.kth_hit(5.0, 1.0, [a, b], 2), len(kept) - 1, bow is None, len(rings.split_at(a, np.array([[1.0, 0.0], [2.0, 0.0]]))))

    schema = "union_area double, intersection_area double, difference_area double, xor_area double, outward double, opened double, inside array<int>, nearest double, third double, corners int, bow_tie_dropped boolean, pieces int"
    return rings.apply_rings(p, "pnu", ["width", "depth"], make, schema).withColumn("inside", F.array_join(F.transform("inside", lambda x: x.cast("string")), ","))


QUERIES = {
    "shapefile_parcels": shapefile_parcels, "shapefile_checks": shapefile_checks, "floor_files": floor_files, "summary_files": summary_files, "qa_files": qa_files,
    "stored_index_topk": stored_index_topk, "answer_logs": answer_logs, "rule_files": rule_files, "file_pairs": file_pairs, "first_targets": first_targets, "parcel_pair": parcel_pair,
    "parcel_columns": parcel_columns, "scenario_checks": scenario_checks, "zero_filled": zero_filled, "single_floors": single_floors, "ring_range_records": ring_range_records,
    "ring_audit": ring_audit, "parcel_map": parcel_map, "parcel_rings": parcel_rings, "district_names": district_names, "law_articles": law_articles, "law_rollup": law_rollup,
    "law_chunk_stats": law_chunk_stats, "law_boosts": law_boosts, "law_readiness": law_readiness, "retrieve_default": retrieve_default, "answer_forms": answer_forms, "slugs": slugs,
    "kernel_sloped": kernel_sloped, "kernel_concave": kernel_concave, "visual_heights": visual_heights, "surface_quads": surface_quads, "ring_operators": ring_operators,
}
