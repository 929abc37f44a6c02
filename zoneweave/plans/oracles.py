"""The registered queries once more, as SQL for an independent engine."""

from __future__ import annotations

from .constants import RESIDENTIAL, SCENARIOS, ZONE_UNKNOWN, ZONES

_Z = ", ".join(f"('{k}', '{v}')" for k, v in ZONES.items())
_S = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in SCENARIOS)
_T = ", ".join(f"'{z}'" for z in RESIDENTIAL)

PARCELS = f"""
z(code, name) AS (VALUES {_Z}),
p0 AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 10, '0') AS pnu, p_partkey AS part_key, p_partkey % 40 AS col, p_partkey // 40 AS rw,
  ((p_partkey % 40) * 30)::DOUBLE AS x0, ((p_partkey // 40) * 20)::DOUBLE AS y0, (12 + (p_partkey % 40) % 9)::DOUBLE AS width, (14 + p_size % 7)::DOUBLE AS depth,
  CASE WHEN p_partkey % 11 = 0 THEN '도로' WHEN p_partkey % 37 = 0 THEN '' ELSE '대' END AS jimok,
  CASE WHEN p_partkey % 2 = 1 THEN ' ' || zc || '.0' ELSE zc END AS landuse_raw, zc AS landuse_code,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 37 = 0 THEN 'road' ELSE 'lot' END AS kind
  FROM (SELECT *, ['11', '13', '14', '15', '17', '21'][(p_partkey % 6 + 1)::INT] AS zc FROM part)),
b AS (SELECT l_partkey AS part_key, count(*) AS build_cnt,
  arg_min(use_code, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)) AS build_use,
  CASE WHEN bool_or(use_code = '02000') THEN 'Y' ELSE 'N' END AS apt_yn
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN '02000' ELSE '01000' END AS use_code FROM lineitem) GROUP BY l_partkey),
p AS (SELECT p0.*, coalesce(z.name, '{ZONE_UNKNOWN}') AS landuse, coalesce(build_cnt, 0) AS build_cnt, coalesce(build_use, '') AS build_use, coalesce(apt_yn, 'N') AS apt_yn
  FROM p0 LEFT JOIN z ON z.code = p0.landuse_code LEFT JOIN b USING (part_key))"""

BASE = f"""{PARCELS},
n AS (SELECT a.pnu, arg_min(o.pnu, o.rw) AS o_pnu, min(o.y0) AS o_y0, arg_min(o.landuse_code, o.rw) AS o_zone, arg_min(o.apt_yn, o.rw) AS o_apt
  FROM p a JOIN p o ON a.col = o.col AND o.rw > a.rw AND o.kind = 'lot' WHERE a.kind = 'lot' GROUP BY a.pnu),
g AS (SELECT p.*, n.*  EXCLUDE (pnu), o_y0 - (y0 + depth) AS gap FROM p LEFT JOIN n USING (pnu) WHERE kind = 'lot' AND landuse_code IN ({_T})),
t AS (SELECT *, coalesce(gap < 21 AND o_zone <> '21', false) AS base, CASE WHEN gap < 21 THEN o_pnu END AS owner_pnu,
  CASE WHEN gap < 21 AND o_zone <> '21' THEN CASE WHEN o_apt = 'Y' AND o_zone IN ({_T}) AND gap > 0.001 THEN gap / 2 ELSE gap END END AS e,
  coalesce(gap < 21 AND o_zone = '21' AND gap >= 19.999, false) AS qa_road,
  coalesce(gap < 21 AND o_zone <> '21' AND o_apt = 'Y' AND o_zone IN ({_T}) AND gap > 0.001, false) AS qa_center FROM g)"""

SETBACK = f"""
s(scenario, label, low_t, low_s, mid_t, mid_s, slope) AS (VALUES {_S}),
sb AS (SELECT scenario, label, floor, h AS height_m, (CASE WHEN h <= low_t THEN low_s WHEN mid_t IS NOT NULL AND h <= mid_t THEN mid_s ELSE h * slope::DOUBLE END)::DOUBLE AS setback_m
  FROM s, (SELECT r::INT AS floor, (r * 3)::DOUBLE AS h FROM range(1, 8) q(r)))"""

FLOORS = f"""{BASE}, {SETBACK},
f AS (SELECT scenario, label, pnu, landuse_code, landuse, round(width * depth, 4) AS lot_area_m2, round((width - 2) * (depth - 2), 4) AS lot_area_inward_1m_m2,
  floor, height_m, setback_m, base::INT AS base_segment_count,
  round((width - 2) * greatest(0.0, least(depth - 1, coalesce(depth + e - setback_m, depth - 1)) - 1), 4) AS allowed_area_m2,
  x0, y0, width, least(depth - 1, coalesce(depth + e - setback_m, depth - 1)) AS top_m FROM t, sb)"""

SUMMARY = f"""{FLOORS},
m AS (SELECT a.scenario, a.label, a.landuse, parcel_count, floor, mean_area, std_area, median_area FROM
  (SELECT scenario, label, landuse, floor, round(avg(allowed_area_m2), 4) AS mean_area, round(stddev_pop(allowed_area_m2), 4) AS std_area, round(median(allowed_area_m2), 4) AS median_area
   FROM f GROUP BY ALL) a JOIN (SELECT scenario, landuse, count(DISTINCT pnu) AS parcel_count FROM f GROUP BY ALL) c USING (scenario, landuse))"""

CHANGE = f"""{FLOORS},
ch AS (SELECT pnu, landuse, round(a, 4) AS area_before, round(b, 4) AS area_after, round(CASE WHEN w > 0 THEN (b - a) / w * 100 ELSE 0 END, 4) AS change_rate FROM (
  SELECT pnu, landuse, lot_area_inward_1m_m2 AS w, sum(allowed_area_m2) FILTER (scenario = 1) AS a, sum(allowed_area_m2) FILTER (scenario = 2) AS b
  FROM f WHERE floor IN (4, 5) GROUP BY ALL))"""

RANGES = f"""{FLOORS},
k AS (SELECT *, CASE WHEN top_m > 1 THEN top_m END AS key FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY pnu, scenario ORDER BY floor) AS run FROM (
  SELECT *, CASE WHEN lag(key) OVER w = key AND lag(floor) OVER w = floor - 1 THEN 0 ELSE 1 END AS new FROM k WHERE key IS NOT NULL WINDOW w AS (PARTITION BY pnu, scenario ORDER BY floor))),
r AS (SELECT pnu, scenario, min(floor) AS floor_from, max(floor) AS floor_to, arg_min(allowed_area_m2, floor) AS area_m2, arg_min(base_segment_count, floor) AS seg_cnt,
  ((min(floor) - 1) * 3)::DOUBLE AS h_base_m, (max(floor) * 3)::DOUBLE AS h_top_m FROM i GROUP BY pnu, scenario, run)"""

TERMS = """
tk AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
gr AS (SELECT chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM gr GROUP BY ALL)"""

INDEX = f"""{TERMS},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT d.doc_id AS chunk_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN tf ON tf.chunk_id = d.doc_id GROUP BY 1),
tt AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
qk AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM benchmark),
qg AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM qk),
q AS (SELECT item_id, term, count(*) AS qtf FROM qg GROUP BY ALL),
qw AS (SELECT item_id, q.term, qtf * (ln((n + 1) / (df + 1)) + 1) AS w, ln((n + 1) / (df + 1)) + 1 AS idf, ln((n - df + 0.5) / (df + 0.5) + 1) AS bidf FROM q JOIN df USING (term), tt),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY item_id),
dn AS (SELECT chunk_id, sqrt(sum((tf * (ln((n + 1) / (df + 1)) + 1)) ** 2)) AS norm FROM tf JOIN df USING (term), tt GROUP BY chunk_id),
ls AS (SELECT item_id, chunk_id, sum(tf * qw.w * idf) AS dot, sum(bidf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25
  FROM tf JOIN qw USING (term) JOIN dl USING (chunk_id), tt GROUP BY item_id, chunk_id),
lx AS (SELECT item_id, chunk_id, dot / (norm * qnorm) AS tfidf, bm25 FROM ls JOIN qn USING (item_id) JOIN dn USING (chunk_id)),
sc AS (SELECT b.item_id, d.doc_id AS chunk_id, coalesce(tfidf, 0) AS tfidf, coalesce(bm25, 0) AS bm25 FROM benchmark b CROSS JOIN documents d LEFT JOIN lx ON lx.item_id = b.item_id AND lx.chunk_id = d.doc_id),
nm AS (SELECT *, CASE WHEN max(tfidf) OVER w - min(tfidf) OVER w < 1e-9 THEN 0 ELSE (tfidf - min(tfidf) OVER w) / (max(tfidf) OVER w - min(tfidf) OVER w) END AS n_t,
  CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-9 THEN 0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS n_b FROM sc WINDOW w AS (PARTITION BY item_id))"""


def _top(score: str, k: int, source: str) -> str:
    return f"""SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank
  FROM (SELECT item_id, chunk_id, round({score}, 12) AS score FROM {source})) WHERE rank <= {k} AND score > 0"""


_MODES = "[('tfidf', 0, 0.5)] || [('bm25', 1, 0.5)] || list_transform(range(1, 10), lambda i: ('hybrid_tfidf_bm25', 2, i / 10))"
METRICS = f"""{INDEX},
md AS (SELECT 'tfidf' AS mode, 0 AS ord, 0.5::DOUBLE AS alpha UNION ALL SELECT 'bm25', 1, 0.5 UNION ALL SELECT 'hybrid_tfidf_bm25', 2, i / 10 FROM range(1, 10) r(i)),
ms AS (SELECT mode, ord, alpha, item_id, chunk_id, round(CASE ord WHEN 0 THEN tfidf WHEN 1 THEN bm25 ELSE alpha * n_t + (1 - alpha) * n_b END, 12) AS score FROM nm, md),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, alpha, item_id ORDER BY score DESC, chunk_id) AS rank FROM ms) WHERE rank <= 5 AND score > 0),
qs AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) >= 40) AS req, item_id % 3 <> 0 AS gold FROM benchmark),
rq AS (SELECT item_id, unnest(req) AS token, generate_subscripts(req, 1) AS pos FROM qs),
ht AS (SELECT mode, alpha, tp.item_id, pos, rank FROM tp JOIN rq USING (item_id) JOIN documents d ON d.doc_id = tp.chunk_id
  WHERE contains(regexp_replace(coalesce(d.text, ''), '\\s+', '', 'g'), regexp_replace(token, '\\s+', '', 'g')) OR contains(d.source, regexp_replace(token, '\\s+', '', 'g'))),
fr AS (SELECT mode, alpha, item_id, pos, min(rank) AS rank FROM ht GROUP BY ALL),
fd AS (SELECT mode, alpha, item_id, count(*) AS found, arg_min(rank, pos) AS first_rank FROM fr GROUP BY ALL),
sp AS (SELECT mode, alpha, item_id, count(DISTINCT rank) AS supported FROM ht GROUP BY ALL),
rt AS (SELECT mode, alpha, item_id, count(*) AS returned FROM tp GROUP BY ALL),
mq AS (SELECT md.mode, md.ord, md.alpha, qs.item_id, coalesce(found, 0) / greatest(len(req), 1) AS recall, coalesce(supported, 0) / greatest(coalesce(returned, 0), 1) AS precision,
  coalesce(1 / first_rank, 0) AS mrr, ((coalesce(found, 0) = len(req)) = gold)::INT AS right_
  FROM qs CROSS JOIN md LEFT JOIN fd USING (mode, alpha, item_id) LEFT JOIN sp USING (mode, alpha, item_id) LEFT JOIN rt USING (mode, alpha, item_id)),
rp AS (SELECT mode, ord, alpha, count(*) AS queries, round(avg(recall), 6) AS recall_at_k, round(avg(precision), 6) AS precision_at_k, round(avg(mrr), 6) AS mrr, round(avg(right_), 6) AS readiness_accuracy FROM mq GROUP BY ALL)"""

_CLEAN = r"regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"

ORACLES = {
    "zone_normalize": f"WITH {PARCELS} SELECT pnu, landuse_code, landuse, kind FROM p",
    "apt_join": f"WITH {PARCELS} SELECT pnu, build_cnt, build_use, apt_yn FROM p",
    "apt_counts": f"""WITH {PARCELS} SELECT landuse_code, count(*) AS parcels, count(*) FILTER (apt_yn = 'Y') AS apt_y, count(*) FILTER (apt_yn = 'N') AS apt_n,
      round(count(*) FILTER (apt_yn = 'Y') / count(*) * 100, 4) AS apt_share FROM p GROUP BY ROLLUP (landuse_code)""",
    "pnu_lookup": f"WITH {PARCELS} SELECT pnu, landuse_code, landuse, kind FROM p WHERE pnu = 'P0000000007'",
    "zone_histogram": f"WITH {PARCELS} SELECT landuse_code, count(*) AS lots FROM p WHERE kind = 'lot' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "setback_table": f"WITH {SETBACK} SELECT * FROM sb",
    "floor_area": f"WITH {FLOORS} SELECT scenario, label, pnu, landuse_code, lot_area_m2, lot_area_inward_1m_m2, floor, height_m, setback_m, base_segment_count, allowed_area_m2 FROM f",
    "floor_summary": f"WITH {SUMMARY} SELECT * FROM m",
    "scenario_comparison": f"""WITH {SUMMARY} SELECT m.scenario, m.label, m.landuse, m.floor, coalesce(a.mean_area, 0) AS base_mean, m.mean_area,
      round(CASE WHEN coalesce(a.mean_area, 0) > 0 THEN (m.mean_area - a.mean_area) / a.mean_area * 100 ELSE 0 END, 4) AS change_pct, round(m.mean_area - coalesce(a.mean_area, 0), 4) AS change_abs
      FROM m LEFT JOIN m a ON a.scenario = 1 AND a.landuse = m.landuse AND a.floor = m.floor WHERE m.scenario <> 1""",
    "volume_by_scenario": f"""WITH {SUMMARY}, v AS (SELECT scenario, label, landuse, sum(mean_area) AS volume FROM m GROUP BY ALL)
      SELECT v.scenario, v.label, v.landuse, round(v.volume, 4) AS volume, round((v.volume / a.volume - 1) * 100, 4) + 0.0 AS change_pct FROM v LEFT JOIN v a ON a.scenario = 1 AND a.landuse = v.landuse""",
    "weighted_change": f"""WITH {SUMMARY} SELECT m.scenario, m.label, m.floor, round((sum(m.parcel_count * m.mean_area) / sum(m.parcel_count * a.mean_area) - 1) * 100, 4) AS change_pct
      FROM m JOIN m a ON a.scenario = 1 AND a.landuse = m.landuse AND a.floor = m.floor WHERE m.scenario <> 1 GROUP BY ALL""",
    "parcel_change_rate": f"WITH {CHANGE} SELECT * FROM ch",
    "change_bins": f"""WITH {CHANGE} SELECT least(floor(greatest(0, least(30, change_rate)) / 2), 14)::BIGINT AS bin, count(*) AS parcels, min(change_rate) AS min_rate, max(change_rate) AS max_rate FROM ch GROUP BY 1""",
    "change_stats": f"WITH {CHANGE} SELECT min(change_rate) AS min_rate, max(change_rate) AS max_rate, round(median(change_rate), 4) AS median_rate, count(*) AS parcels FROM ch",
    "floor_ranges": f"WITH {RANGES} SELECT * FROM r",
    "range_totals": f"WITH {RANGES} SELECT (SELECT count(*) FROM f) AS raw, (SELECT count(*) FROM r) AS records, round((1 - (SELECT count(*) FROM r) / (SELECT count(*) FROM f)) * 100, 4) AS saved_pct",
    "span_histogram": f"WITH {RANGES} SELECT floor_from, floor_to, count(*) AS records FROM r GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 8",
    "type_histogram": f"WITH {RANGES} SELECT scenario, count(*) AS records, round(avg(floor_to - floor_from + 1), 4) AS mean_floors FROM r GROUP BY scenario",
    "zone_check": f"WITH {PARCELS} SELECT landuse_code AS zone_cd, count(*) AS records, landuse_code IN ({_T}) AS known FROM p GROUP BY 1",
    "output_audit": f"""WITH {RANGES} SELECT count(*) AS records, count(*) FILTER (NOT (floor_from >= 1 AND floor_from <= floor_to AND floor_to <= 7)) AS bad_floors,
      count(*) FILTER (abs(h_base_m - (floor_from - 1) * 3) > 0.01) AS bad_base, count(*) FILTER (abs(h_top_m - floor_to * 3) > 0.01) AS bad_top, count(*) FILTER (area_m2 < 0) AS bad_area FROM r""",
    "area_stats": f"WITH {RANGES} SELECT min(area_m2) AS min_area, max(area_m2) AS max_area, (list(area_m2 ORDER BY area_m2))[(count(*) // 2 + 1)::INT] AS upper_median FROM r WHERE area_m2 > 0",
    "neighbor_pairs": f"""WITH {PARCELS} SELECT a.pnu AS target_pnu, o.pnu AS owner_pnu FROM p a JOIN p o ON o.kind = 'lot' AND a.pnu <> o.pnu
      AND a.x0 - 21 <= o.x0 + o.width AND o.x0 <= a.x0 + a.width + 21 AND a.y0 - 21 <= o.y0 + o.depth AND o.y0 <= a.y0 + a.depth + 21 WHERE a.kind = 'lot' AND a.landuse_code IN ({_T})""",
    "visible_parcels": f"""WITH {PARCELS} SELECT pnu, landuse_code IN ({_T}) AS is_target FROM p o WHERE kind = 'lot' AND (landuse_code IN ({_T}) OR EXISTS (
      SELECT 1 FROM p a WHERE a.kind = 'lot' AND a.landuse_code IN ({_T}) AND a.pnu <> o.pnu AND a.x0 - 21 <= o.x0 + o.width AND o.x0 <= a.x0 + a.width + 21 AND a.y0 - 21 <= o.y0 + o.depth AND o.y0 <= a.y0 + a.depth + 21))""",
    "neighbor_owner": f"WITH {BASE} SELECT pnu, owner_pnu, base, e AS effective_gap_m FROM t",
    "qa_rows": f"""WITH {BASE} SELECT 'road20m' AS kind, pnu AS target_pnu, o_pnu AS owner_pnu FROM t WHERE qa_road UNION ALL SELECT 'centerline', pnu, o_pnu FROM t WHERE qa_center""",
    "ring_area": f"WITH {PARCELS} SELECT pnu, round(width * depth, 6) AS area, x0 AS bx0, y0 AS by0, x0 + width AS bx1, y0 + depth AS by1, 1 AS north_edges FROM p",
    "kernel_floor_area": f"""WITH {FLOORS} SELECT DISTINCT pnu, setback_m AS distance, round((width - 2) * greatest(0.0, top_m - 1), 4) AS area, base_segment_count AS seg_cnt FROM f""",
    "doc_terms": f"WITH {TERMS} SELECT chunk_id, term, tf FROM tf",
    "tfidf_topk": f"WITH {INDEX} {_top('tfidf', 5, 'sc')}",
    "bm25_topk": f"WITH {INDEX} {_top('bm25', 5, 'sc')}",
    "hybrid_topk": f"WITH {INDEX} {_top('0.5 * n_t + 0.5 * n_b', 5, 'nm')}",
    "boosted_topk": f"""WITH {INDEX}, sg AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{{7,}}'), lambda x: lower(x))))  AS s FROM benchmark),
      bs AS (SELECT item_id, doc_id AS chunk_id, least(0.45, count(*) * 0.15)::DOUBLE AS boost FROM sg JOIN documents ON contains(coalesce(text, ''), s) OR contains(source, s) GROUP BY ALL),
      bt AS (SELECT nm.item_id, nm.chunk_id, 0.5 * n_t + 0.5 * n_b + coalesce(boost, 0) AS score0 FROM nm LEFT JOIN bs USING (item_id, chunk_id)) {_top('score0', 5, 'bt')}""",
    "embedding_cosine_topk": """WITH q AS (SELECT vec_id AS item_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
      s AS (SELECT item_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 12) AS score FROM q JOIN embeddings e ON e.vec_id <> q.item_id)
      SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5 AND score > 0""",
    "retrieval_metrics": f"WITH {METRICS} SELECT mode, alpha, queries, recall_at_k, precision_at_k, mrr, readiness_accuracy FROM rp",
    "mode_selection": f"""WITH {METRICS}, bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY recall_at_k DESC, precision_at_k DESC, mrr DESC, alpha) AS x FROM rp) WHERE x = 1),
      ok AS (SELECT bool_or(readiness_accuracy >= 0.85) AS any_ok FROM bt)
      SELECT mode, alpha, recall_at_k, precision_at_k, mrr, readiness_accuracy FROM bt, ok WHERE NOT any_ok OR readiness_accuracy >= 0.85
      ORDER BY CASE WHEN any_ok THEN 0 ELSE readiness_accuracy END DESC, CASE WHEN any_ok THEN recall_at_k ELSE 0 END DESC, CASE WHEN any_ok THEN precision_at_k ELSE 0 END DESC, CASE WHEN any_ok THEN mrr ELSE 0 END DESC, ord LIMIT 1""",
    "sliding_chunks": f"""WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents), k AS (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 900) / 780))::BIGINT + 1)) AS pos FROM c WHERE t <> '')
      SELECT doc_id, pos::INT AS pos, trim(t[pos * 780 + 1 : pos * 780 + 900]) AS chunk FROM k WHERE trim(t[pos * 780 + 1 : pos * 780 + 900]) <> ''""",
    "chunk_stats": f"""WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT section_type, count(*) AS chunks, round(avg(n), 4) AS mean_len, min(n) AS min_len, max(n) AS max_len
      FROM (SELECT 'unknown' AS section_type, length(t)::INT AS n FROM c WHERE t <> '') GROUP BY ROLLUP (section_type)""",
    "latest_per_key": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r = 1",
    "missing_items": """WITH q AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda x: trim(x)), lambda x: length(x) >= 40) AS req FROM benchmark),
      r AS (SELECT item_id, unnest(req) AS token FROM q), h AS (SELECT DISTINCT item_id, token FROM r JOIN documents d ON contains(d.text, token))
      SELECT q.item_id, len(list_distinct(req))::INT AS required, (len(list_distinct(req)) - (SELECT count(*) FROM h WHERE h.item_id = q.item_id))::INT AS missing FROM q""",
    "json_salvage": """SELECT event_id, try_cast(json_valid(props) AS BOOLEAN) AS valid, CASE WHEN json_valid(props) THEN len(json_keys(props))::INT END AS keys FROM events""",
    "resume_pending": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0)",
}
