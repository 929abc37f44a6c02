"""SQL of the further queries, for an independent engine."""

from __future__ import annotations

from ..operators.parcels import DISTRICTS
from .oracles import _T, BASE, CHANGE, FLOORS, INDEX, PARCELS, RANGES, SETBACK, SUMMARY, _top
from .oracles import ORACLES as FIRST

_D = ", ".join(f"('{k}', '{v}')" for k, v in DISTRICTS.items())
_SLUG = r"substr(regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '[^0-9A-Za-z가-힣\-_]', '', 'g'), 1, 40)"

LAWS = """
k AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS s FROM part),
full_ AS (SELECT * FROM k WHERE k % 5 <> 0 AND k % 7 <> 0),
law AS (
  SELECT k, 0 AS pos, '법 별표 ' || s || '.md' AS source, '별표 ' || s AS article_id, '' AS article_title, 'appendix' AS section_type, '표 ' || s || chr(10) || chr(10) || '끝' AS text FROM k WHERE k % 5 = 0
  UNION ALL SELECT k, 0, 'law' || s || '.md', '', '', 'unknown', '본문 ' || s FROM k WHERE k % 5 <> 0 AND k % 7 = 0
  UNION ALL SELECT k, 0, 'law' || s || '.md', '제1조', '목적', 'article', '제1조(목적) 이 법은 ' || s || '호 대지의 높이를 정함을 목적으로 한다.' FROM full_
  UNION ALL SELECT k, 3, 'law' || s || '.md', '제4조의2', '높이', 'article', '# 제4조의2(높이) ① 높이는 ' || s || '미터 이하로 하며 그 밖의 경우는 따로 정한다.' FROM full_
  UNION ALL SELECT k, 5, 'law' || s || '.md', '별표 ' || s, '', 'appendix', '■ 건축법 [별표 ' || s || '] 일조 높이제한 표' || chr(10) || '내용 ' || s FROM full_
  UNION ALL SELECT k, 6, 'law' || s || '.md', '제5조', '기타', 'article', '제5조(기타) 1. 그 밖에 필요한 사항은 조례로 정하고 공고한다.' FROM full_)"""

_CASES = " UNION ALL ".join(f"SELECT {i} AS i, {d}::DOUBLE AS distance" for i, d in enumerate((0.0, 1.5, 5.0, 9.0)))

ORACLES = {
    "shapefile_parcels": f"""WITH {PARCELS} SELECT pnu, 'd' || (col % 4) AS district, jimok, landuse_code, landuse, kind, part_key % 3 <> 1 AS apartment, round(width * depth, 6) AS area FROM p""",
    "shapefile_checks": f"""WITH {RANGES} SELECT 'd/' || scenario AS path, true AS has_shx, true AS has_dbf, true AS korean_grid, 0 AS missing, count(*) AS features, 0 AS bad_rings, true AS ok FROM r GROUP BY scenario""",
    "floor_files": f"""WITH {FLOORS} SELECT label, f.pnu, jimok, f.landuse_code, f.landuse, lot_area_m2, lot_area_inward_1m_m2, floor, height_m, base_segment_count, allowed_area_m2 FROM f JOIN p USING (pnu)""",
    "summary_files": f"""WITH {SUMMARY}, c AS (SELECT m.scenario, m.landuse, m.floor,
      round(CASE WHEN coalesce(a.mean_area, 0) > 0 THEN (m.mean_area - a.mean_area) / a.mean_area * 100 ELSE 0 END, 4) AS change_pct, round(m.mean_area - coalesce(a.mean_area, 0), 4) AS change_abs
      FROM m LEFT JOIN m a ON a.scenario = 1 AND a.landuse = m.landuse AND a.floor = m.floor WHERE m.scenario <> 1)
      SELECT scenario, label, landuse, floor, parcel_count, mean_area, std_area, median_area, change_pct, change_abs FROM m LEFT JOIN c USING (scenario, landuse, floor)""",
    "qa_files": f"""WITH {BASE} SELECT 'road20m' AS kind, pnu AS target_pnu, o_pnu AS owner_pnu FROM t WHERE qa_road UNION ALL SELECT 'centerline', pnu, o_pnu FROM t WHERE qa_center
      UNION ALL SELECT 'warnings', pnu, NULL FROM t WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.kind = 'lot' AND o.col = t.col AND o.rw BETWEEN t.rw + 1 AND t.rw + 3)""",
    "stored_index_topk": FIRST["bm25_topk"],
    "answer_logs": f"""WITH {INDEX}, tp AS ({_top("bm25", 3, "sc")}), n AS (SELECT item_id, count(*) AS c FROM tp GROUP BY 1)
      SELECT item_id, {_SLUG.format("text")} AS slug, 'bm25' AS mode, 3 AS top_k, coalesce(c, 0) AS retrieved_count, CASE WHEN c > 0 THEN 1 END AS first_rank, 'offline' AS provider FROM benchmark LEFT JOIN n USING (item_id)""",
    "rule_files": """SELECT CASE WHEN item_id = 1 THEN 'Q0_포괄질의_BuildingEnvelope' ELSE item_id::VARCHAR END AS label, 1 AS attempts, 0 AS missing_keys, '제0조' AS article_id FROM benchmark WHERE item_id % 4 <> 0""",
    "file_pairs": """WITH n AS (SELECT n_nationkey AS k, lpad(n_nationkey::VARCHAR, 5, '0') AS code FROM nation),
      x AS (SELECT code, CASE WHEN k % 3 <> 0 THEN 'LSMD_P_' || code || '_a.shp' END AS parcel_file, CASE WHEN k % 2 = 0 THEN 'AL_B_' || code || '_b.shp' END AS building_file FROM n)
      SELECT *, parcel_file IS NOT NULL AND building_file IS NOT NULL AS paired FROM x WHERE parcel_file IS NOT NULL OR building_file IS NOT NULL""",
    "first_targets": f"WITH {PARCELS} SELECT pnu, landuse_code FROM p WHERE kind = 'lot' AND landuse_code IN ({_T}) ORDER BY part_key LIMIT 25",
    "parcel_pair": f"WITH {PARCELS} SELECT pnu, landuse, kind FROM p WHERE pnu IN ('P0000000007', 'P0000000011')",
    "parcel_columns": f"WITH {PARCELS} SELECT pnu, jimok, landuse_raw AS A13, apt_yn, build_cnt, build_use, 5 AS points, x0 + width AS bx1 FROM p",
    "scenario_checks": "SELECT c_custkey, c_custkey % 9 BETWEEN 1 AND 6 AS known FROM customer",
    "zero_filled": f"""WITH {FLOORS} SELECT scenario, pnu, floor, CASE WHEN substr(pnu, 2, 10)::BIGINT % 7 = 0 AND floor >= (CASE WHEN scenario = 2 THEN 3 ELSE 5 END) THEN 0 ELSE allowed_area_m2 END AS allowed_area_m2 FROM f""",
    "single_floors": f"""WITH {FLOORS} SELECT pnu, scenario, floor AS floor_from, floor AS floor_to, allowed_area_m2 AS area_m2, base_segment_count AS seg_cnt, ((floor - 1) * 3)::DOUBLE AS h_base_m, (floor * 3)::DOUBLE AS h_top_m FROM f WHERE top_m > 1""",
    "ring_range_records": f"""WITH {RANGES} SELECT r.pnu, r.scenario, floor_from, floor_to, area_m2, seg_cnt, f.landuse_code AS zone, round((f.width - 2) * (f.top_m - 1), 2) AS ring_area
      FROM r JOIN f ON f.pnu = r.pnu AND f.scenario = r.scenario AND f.floor = r.floor_from""",
    "ring_audit": f"""WITH {RANGES}, x AS (SELECT *, substr(pnu, 2, 10)::BIGINT AS k FROM r) SELECT count(*) AS records, count(*) FILTER (NOT (floor_from >= 1 AND floor_from <= floor_to AND floor_to <= 7)) AS bad_floors,
      count(*) FILTER (abs(h_base_m - (floor_from - 1) * 3) > 0.01) AS bad_base, count(*) FILTER (abs(h_top_m - floor_to * 3) > 0.01) AS bad_top, count(*) FILTER (area_m2 < 0) AS bad_area,
      count(*) FILTER (k % 70 = 0 AND k % 50 <> 0) AS bad_ring, count(*) FILTER (k % 50 = 0) AS out_of_extent FROM x""",
    "parcel_map": f"WITH {CHANGE} SELECT p.pnu, p.landuse, change_rate FROM p LEFT JOIN ch USING (pnu) WHERE kind = 'lot'",
    "parcel_rings": f"""WITH {PARCELS} SELECT pnu, CASE part_key % 4 WHEN 1 THEN round(width * depth - 6, 6) WHEN 2 THEN NULL ELSE round(width * depth, 6) END AS area, CASE WHEN part_key % 4 IN (1, 2) THEN 1 ELSE 0 END AS holes,
      CASE WHEN part_key % 4 <> 2 THEN x0 + 10 END AS moved_x0, CASE WHEN part_key % 4 <> 2 THEN y0 + depth - 5 END AS moved_y1, CASE WHEN part_key % 4 <> 2 THEN 9.0 END AS z, CASE WHEN part_key % 4 <> 2 THEN 1.0 END AS same_key FROM p""",
    "district_names": f"""WITH d(code, name) AS (VALUES {_D}), c AS (SELECT c_custkey, (11000 + c_custkey % 80 * 10)::VARCHAR AS code FROM customer) SELECT c_custkey, code, coalesce(name, code) AS district FROM c LEFT JOIN d USING (code)""",
    "law_articles": f"WITH {LAWS} SELECT source, article_id, article_title, section_type, text, length(text)::INT AS char_count FROM law",
    "law_rollup": f"WITH {LAWS} SELECT article_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM law WHERE section_type = 'article' GROUP BY 1",
    "law_chunk_stats": f"WITH {LAWS} SELECT section_type, count(*) AS chunks, round(avg(length(text)), 4) AS mean_len, min(length(text)) AS min_len, max(length(text)) AS max_len FROM law GROUP BY ROLLUP (section_type)",
    "law_boosts": f"""WITH {LAWS}, c AS (SELECT k * 10 + pos AS chunk_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM law WHERE section_type <> 'unknown'),
      q AS (SELECT n_nationkey::BIGINT AS item_id, unnest(['제' || (n_nationkey % 6) || '조'] || CASE WHEN n_nationkey % 2 = 0 THEN ['일조', '높이제한'] ELSE [] END) AS s FROM nation)
      SELECT item_id, chunk_id, least(0.45, count(*) * 0.15)::DOUBLE AS boost FROM c JOIN q ON contains(t, s) GROUP BY ALL""",
    "law_readiness": f"""WITH {LAWS}, m AS (SELECT n_nationkey::BIGINT AS item_id, n_nationkey % 2 = 0 AS gold, (NOT EXISTS (SELECT 1 FROM full_ WHERE k % 2 = 0 AND starts_with(s, (n_nationkey * 8)::VARCHAR)))::INT AS missing_attachments FROM nation)
      SELECT item_id, 1.0 AS recall, 1.0 AS precision, 1.0 AS mrr, missing_attachments = 0 AS ready, ((missing_attachments = 0) = gold)::INT AS right, missing_attachments FROM m""",
    "retrieve_default": FIRST["hybrid_topk"],
    "answer_forms": """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '[{"article_id": "' || c_custkey || '", "R": 1, "S": 2}]' WHEN 1 THEN '{"c": ' || c_custkey || '}' WHEN 2 THEN '[1, ' || c_custkey || ']'
      WHEN 3 THEN '{"d": {"e": ' || c_custkey || '}}' WHEN 6 THEN '{"x": [], "y": [{"article_id": "' || c_custkey || '", "R": 1, "S": {}}, {"R": 1}]}' END AS json, CASE WHEN c_custkey % 7 IN (0, 6) THEN 1 ELSE 0 END AS articles FROM customer""",
    "slugs": f"SELECT item_id, {_SLUG.format(chr(39) + '  질문 ' + chr(39) + ' || text')} AS slug FROM benchmark",
    "kernel_sloped": f"""WITH {PARCELS}, dd AS ({_CASES}) SELECT pnu, 1 AS segments, true AS rings_match, distance,
      round((width - 2) * (depth + e / 2 - greatest(distance, sqrt(1 + (e / width) ** 2)) - 1), 4) AS area FROM (SELECT *, (part_key % 5 - 2) * 0.5::DOUBLE AS e FROM p), dd""",
    "kernel_concave": f"""WITH {PARCELS}, dd AS ({_CASES}) SELECT pnu, 2 AS segments, true AS rings_match, distance,
      round((width / 2 - 1) * (depth - greatest(distance, 1) - 1) + (depth - 2) + (width / 2 - 2) * (2 * depth - greatest(distance, 1) - 1), 4) AS area FROM p, dd""",
    "visual_heights": f"""WITH {BASE}, h AS (SELECT i::INT AS level, (i * 3)::DOUBLE AS z, CASE WHEN i * 3 <= 10 THEN 1.5 ELSE i * 1.5 END::DOUBLE AS d FROM range(0, 7) x(i))
      SELECT pnu, level, false AS empty, z, round((width - 2) * (least(depth - 1, coalesce(depth + e - d, depth - 1)) - 1), 4) AS area FROM t, h""",
    "surface_quads": f"""WITH {BASE}, {SETBACK}, q AS (SELECT *, coalesce(mid_s, low_s)::DOUBLE AS d0, coalesce(mid_t, low_t)::DOUBLE AS z_ FROM s),
      w AS (SELECT scenario, 'vertical' AS part, low_s::DOUBLE AS d_low, 0::DOUBLE AS z0, low_s::DOUBLE AS d_high, low_t::DOUBLE AS z3 FROM q
        UNION ALL SELECT scenario, 'step', low_s, low_t, mid_s, low_t FROM q WHERE mid_t IS NOT NULL UNION ALL SELECT scenario, 'middle', mid_s, low_t, mid_s, mid_t FROM q WHERE mid_t IS NOT NULL
        UNION ALL SELECT scenario, 'slope_step', d0, z_, z_ * slope::DOUBLE, z_ FROM q WHERE z_ * slope::DOUBLE <> d0 UNION ALL SELECT scenario, 'slope', z_ * slope::DOUBLE, z_, 27 * slope::DOUBLE, 27 FROM q)
      SELECT pnu, scenario, part, round(d_low, 6) AS d_low, z0, round(d_high, 6) AS d_high, z3 FROM t, w WHERE base""",
    "ring_operators": f"""WITH {PARCELS}, x AS (SELECT *, width * depth AS a, (width - 3) * (depth - 4) AS i FROM p) SELECT pnu, 2 * a - i AS union_area, i AS intersection_area, a - i AS difference_area, 2 * (a - i) AS xor_area,
      (width + 2) * (depth + 2) AS outward, a AS opened, '1,-1,0' AS inside, 4.0 AS nearest, depth + 4 AS third, 5 AS corners, true AS bow_tie_dropped, 3 AS pieces FROM x""",
}
