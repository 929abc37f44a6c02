"""Registered queries over the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import area, bbox, north_edges, rectangle
from ..operators import audit as au
from ..operators import chunks as ch
from ..operators import evaluate as ev
from ..operators import kernel as kn
from ..operators import neighbors as nb
from ..operators import parcels as pc
from ..operators import ranges as rg
from ..operators import retrieval as rt
from ..operators import rules as ru
from ..operators import setback as sb
from ..operators.needles import find_needles
from ..session import cut, small
from ..streaming.resume import pending
from .constants import RESIDENTIAL
from .views import buildings, chunks, questions, raw_parcels, table


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.add_buildings(pc.classify(raw_parcels(spark, sf_dir)), buildings(spark, sf_dir))


def targets(spark, sf_dir) -> DataFrame:
    return sb.base_lines(parcels(spark, sf_dir))


def floors(spark, sf_dir) -> DataFrame:
    return sb.floor_rows(spark, targets(spark, sf_dir))


def summary(spark, sf_dir) -> DataFrame:
    return sb.floor_summary(floors(spark, sf_dir))


def ranges(spark, sf_dir) -> DataFrame:
    return rg.merge_floors(floors(spark, sf_dir), F.when(F.col("top_m") > 1, F.round("top_m", 3)))


def boxed(df: DataFrame) -> DataFrame:
    return df.select("pnu", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), (F.col("x0") + F.col("width")).alias("bx1"), (F.col("y0") + F.col("depth")).alias("by1"))


def ring():
    return rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("width"), F.col("y0") + F.col("depth"))


def neighbor_pairs(spark, sf_dir) -> DataFrame:
    p = parcels(spark, sf_dir)
    return nb.box_neighbors(boxed(pc.first_targets(p, None)), boxed(p.where("kind = 'lot'")))


def visible_parcels(spark, sf_dir) -> DataFrame:
    """Targets and the lots in their reach, each once."""
    p = parcels(spark, sf_dir)
    near = p.join(neighbor_pairs(spark, sf_dir).select(F.col("owner_pnu").alias("pnu")).distinct(), "pnu", "left_semi")
    return pc.union_visible(pc.first_targets(p, None), near).select("pnu", "is_target")


def zone_check(spark, sf_dir) -> DataFrame:
    zones = pc.classify(raw_parcels(spark, sf_dir)).select(F.col("landuse_code").alias("zone_cd"))
    return au.zone_check(zones, tuple(RESIDENTIAL))


def qa_rows(spark, sf_dir) -> DataFrame:
    t = targets(spark, sf_dir)
    return nb.qa_rows(t, "qa_road20m").withColumn("kind", F.lit("road20m")).unionByName(nb.qa_rows(t, "qa_centerline").withColumn("kind", F.lit("centerline"))).select("kind", "target_pnu", "owner_pnu")


def ring_area(spark, sf_dir) -> DataFrame:
    p = raw_parcels(spark, sf_dir).select("pnu", ring().alias("ring"))
    b = bbox(F.col("ring"))
    return p.select("pnu", area(F.col("ring")).alias("area"), b["x0"].alias("bx0"), b["y0"].alias("by0"), b["x1"].alias("bx1"), b["y1"].alias("by1"), F.size(north_edges(F.col("ring"))).alias("north_edges"))


def kernel_rows(spark, sf_dir) -> DataFrame:
    """Kernel areas for all distinct depths; pairs give each target at least itself."""
    p = parcels(spark, sf_dir)
    lots = p.where("kind = 'lot'").select("pnu", ring().alias("ring"), "landuse_code", (F.col("apt_yn") == "Y").alias("apartment"))
    t = pc.first_targets(p, None)
    pairs = nb.box_neighbors(boxed(t), boxed(p.where("kind = 'lot'")))
    pairs = t.select(F.col("pnu").alias("target_pnu")).join(pairs, "target_pnu", "left")
    depths = sorted(r[0] for r in sb.setback_table(spark).select("setback_m").distinct().collect())
    return kn.kernel_areas(lots, pairs, depths, with_rings=False)


def kernel_floor_area(spark, sf_dir) -> DataFrame:
    return kernel_rows(spark, sf_dir).select("pnu", "distance", F.round("area", 4).alias("area"), "seg_cnt")


def lexical(spark, sf_dir, want=("tfidf", "bm25")) -> tuple[rt.Index, DataFrame, DataFrame]:
    index, q = rt.Index(chunks(spark, sf_dir)), questions(spark, sf_dir)
    return index, q, rt.lexical_scores(index, q, want)


def ranked(spark, sf_dir, candidates, k=5, *more) -> DataFrame:
    return rt.ranked(rt.Index(chunks(spark, sf_dir)), questions(spark, sf_dir), candidates, k, *more)


def tfidf_topk(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir, [("tfidf",)]).drop("candidate")


def bm25_topk(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir, [("bm25",)]).drop("candidate")


def hybrid_topk(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir, [("tfidf", "bm25", 0.5)]).drop("candidate")


def boosted_topk(spark, sf_dir) -> DataFrame:
    """The boost rule with words of seven and more letters as signals, since these texts name no articles."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit("[A-Za-z]{7,}"), F.lit(0)), F.lower))
    q = questions(spark, sf_dir).select("item_id", F.explode(words).alias("needle"))
    return ranked(spark, sf_dir, [("tfidf", "bm25", 0.5)], 5, q, F.concat_ws("\x00", "text", "source")).drop("candidate")


def embedding_cosine_topk(spark, sf_dir) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against the vectors of all labels, those without a label too."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rt.vector_topk(e.where(F.pmod("id", F.lit(20)) == 0), e, 5)


#: Modes that the SQL of retrieval_metrics and mode_selection states, and all that the reference sweeps; in order of ties.
LEXICAL_MODES = ("tfidf", "bm25", "hybrid_tfidf_bm25")
ALL_MODES = (*rt.SINGLE, *rt.PAIRS)


def with_dense(spark, sf_dir) -> DataFrame:
    """All three scores and their normalised forms of every chunk."""
    index, q, s = lexical(spark, sf_dir)
    d = rt.Dense(index).scores(q)
    s = rt.every_chunk(index, q, s).join(d, ["item_id", "chunk_id"], "left").withColumn("dense", F.coalesce("dense", F.lit(0.0)))
    return rt.normalize_all(s, list(rt.SINGLE))


def reports(spark, sf_dir, modes: tuple[str, ...] = LEXICAL_MODES) -> DataFrame:
    """The modes, pairs as nine blends each, scored once and ranked in one plan."""
    index = rt.Index(chunks(spark, sf_dir))
    rows = [(m, i, a) for i, m in enumerate(modes) for a in ([0.5] if m in rt.SINGLE else [x / 10 for x in range(1, 10)])]
    candidates = [(m,) if m in rt.SINGLE else (*rt.PAIRS[m], a) for m, _, a in rows]
    top = rt.ranked(index, questions(spark, sf_dir), candidates, 5, dense=rt.Dense(index) if any("dense" in m for m in modes) else None)
    grid = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({n}, '{m}', {i}, {a}D)" for n, (m, i, a) in enumerate(rows)) + " AS t(candidate, mode, ord, alpha)")
    top = top.join(F.broadcast(grid), "candidate").drop("candidate")
    results = cut(small(cut(top)).join(chunks(spark, sf_dir), "chunk_id"))  # five rows a question and candidate, which the metrics read several times
    m = ev.question_metrics(questions(spark, sf_dir), results, by=("mode", "ord", "alpha"))
    return ev.macro(m, ("mode", "ord", "alpha"))


def mode_selection(spark, sf_dir, modes: tuple[str, ...] = LEXICAL_MODES) -> DataFrame:
    return ev.select_mode(reports(spark, sf_dir, modes)).select("mode", "alpha", "recall_at_k", "precision_at_k", "mrr", "readiness_accuracy")


def dense_topk(spark, sf_dir) -> DataFrame:
    index = rt.Index(chunks(spark, sf_dir))
    return rt.top_k(rt.Dense(index).scores(questions(spark, sf_dir)), "dense", 5)


def article_chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source"), "text")
    return ch.article_chunks(d)


def missing_items(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir).select("item_id", F.array_distinct("required_items").alias("required_items"))
    r = q.select("item_id", F.explode("required_items").alias("needle"))
    found = find_needles(chunks(spark, sf_dir), [], F.col("text"), r, "needle").distinct()
    hit = r.join(found, "needle").groupBy("item_id").agg(F.collect_set("needle").alias("found"))
    j = q.join(hit, "item_id", "left")
    missing = F.array_except("required_items", F.coalesce("found", F.array().cast("array<string>")))
    return j.select("item_id", F.size("required_items").alias("required"), F.size(missing).alias("missing"))


def json_salvage(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", ru.salvage(F.col("props")).alias("j"))
    return e.select("event_id", F.col("j").isNotNull().alias("valid"), F.size(F.json_object_keys("j")).alias("keys"))


def resume_pending(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return pending(e.select("user_id").distinct(), e.where("event_type = 'purchase' and event_id % 10 = 0"), "user_id")


QUERIES = {
    "zone_normalize": lambda s, d: pc.classify(raw_parcels(s, d)).select("pnu", "landuse_code", "landuse", "kind"),
    "apt_join": lambda s, d: parcels(s, d).select("pnu", "build_cnt", "build_use", "apt_yn"),
    "apt_counts": lambda s, d: pc.apartment_counts(parcels(s, d)),
    "pnu_lookup": lambda s, d: pc.by_pnu(pc.classify(raw_parcels(s, d)), "P0000000007").select("pnu", "landuse_code", "landuse", "kind"),
    "zone_histogram": lambda s, d: pc.zone_histogram(pc.classify(raw_parcels(s, d))),
    "setback_table": lambda s, d: sb.setback_table(s),
    "floor_area": lambda s, d: floors(s, d).select("scenario", "label", "pnu", "landuse_code", "lot_area_m2", "lot_area_inward_1m_m2", "floor", "height_m", "setback_m", "base_segment_count", "allowed_area_m2"),
    "floor_summary": summary,
    "scenario_comparison": lambda s, d: sb.scenario_comparison(summary(s, d)),
    "volume_by_scenario": lambda s, d: sb.volume_by_scenario(summary(s, d)),
    "weighted_change": lambda s, d: sb.weighted_change(summary(s, d)),
    "parcel_change_rate": lambda s, d: sb.parcel_change(floors(s, d)),
    "change_bins": lambda s, d: sb.change_bins(sb.parcel_change(floors(s, d))),
    "change_stats": lambda s, d: sb.change_stats(sb.parcel_change(floors(s, d))),
    "floor_ranges": ranges,
    "range_totals": lambda s, d: rg.merge_totals(floors(s, d), ranges(s, d)),
    "span_histogram": lambda s, d: au.span_histogram(ranges(s, d)),
    "type_histogram": lambda s, d: au.type_histogram(ranges(s, d)),
    "zone_check": zone_check,
    "output_audit": lambda s, d: au.audit(ranges(s, d)),
    "area_stats": lambda s, d: au.area_stats(ranges(s, d)),
    "neighbor_pairs": neighbor_pairs,
    "visible_parcels": visible_parcels,
    "neighbor_owner": lambda s, d: targets(s, d).select("pnu", "owner_pnu", "base", "effective_gap_m"),
    "qa_rows": qa_rows,
    "ring_area": ring_area,
    "kernel_floor_area": kernel_floor_area,
    "doc_terms": lambda s, d: rt.term_counts(chunks(s, d), "chunk_id"),
    "tfidf_topk": tfidf_topk,
    "bm25_topk": bm25_topk,
    "hybrid_topk": hybrid_topk,
    "boosted_topk": boosted_topk,
    "dense_topk": dense_topk,
    "embedding_cosine_topk": embedding_cosine_topk,
    "retrieval_metrics": lambda s, d: reports(s, d).drop("ord"),
    "mode_selection": mode_selection,
    "retrieval_metrics_all": lambda s, d: reports(s, d, ALL_MODES).drop("ord"),
    "mode_selection_all": lambda s, d: mode_selection(s, d, ALL_MODES),
    "sliding_chunks": lambda s, d: ch.sliding_chunks(table(s, d, "documents"), "doc_id"),
    "article_chunks": article_chunks,
    "chunk_stats": lambda s, d: ch.chunk_stats(article_chunks(s, d)),
    "latest_per_key": lambda s, d: ru.latest(table(s, d, "conversations"), "conv_id", "turn", "role", "text"),
    "missing_items": missing_items,
    "json_salvage": json_salvage,
    "resume_pending": resume_pending,
}
