"""Relations derived from the star-schema tables, as SQL that Spark and DuckDB both read.

The operators need images, boxes and predictions; these projections stand in for them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

META = """
SELECT o_orderkey AS image_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'synthetic_drone_positive' WHEN 1 THEN 'synthetic_distractor_only' ELSE 'synthetic_drone_plus_distractor' END AS subset,
  o_orderkey % 3 <> 1 AS target_present, o_orderkey % 3 <> 0 AS distractor_present,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'bird' ELSE 'airplane' END AS distractor_type,
  CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 15 WHEN 2 THEN 30 ELSE 60 END AS drone_size_px,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 10 ELSE 20 END AS gaussian_noise_sigma,
  CASE WHEN o_custkey % 5 < 3 THEN 'none' ELSE 'mild' END AS blur_level,
  o_orderpriority AS background_type,
  CAST((o_orderkey * 37 + o_custkey * 11) % 560 AS INT) AS gx, CAST((o_orderkey * 17 + o_custkey * 7) % 320 AS INT) AS gy
FROM orders
"""
GT = "SELECT image_id, gx AS x, gy AS y, drone_size_px AS w, drone_size_px AS h FROM fx_meta WHERE target_present"
PRED = """
SELECT l_orderkey AS image_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS pi,
  CASE WHEN l_suppkey % 2 = 0 THEN 'det_a' ELSE 'det_b' END AS model_name,
  CASE l_returnflag WHEN 'R' THEN 'kite' WHEN 'A' THEN 'Drone ' ELSE 'quadcopter' END AS pred_class_name,
  l_quantity / 50.0 AS confidence,
  CAST(m.gx + (l_partkey % 9 - 4) * greatest(CAST(floor(m.drone_size_px / 15) AS INT), 1) AS INT) AS x,
  CAST(m.gy + (l_suppkey % 9 - 4) * greatest(CAST(floor(m.drone_size_px / 15) AS INT), 1) AS INT) AS y,
  greatest(1, m.drone_size_px + (l_linenumber % 5 - 2)) AS w, greatest(1, m.drone_size_px + (l_linenumber % 5 - 2)) AS h
FROM lineitem JOIN fx_meta m ON m.image_id = l_orderkey
"""
ANN = """
SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey, l_suppkey, lower(p_type) AS class_name, p_brand AS category,
  CAST((l_partkey * 13 + l_suppkey) % 640 AS INT) - 20 AS x, CAST((l_partkey * 7 + l_suppkey * 3) % 480 AS INT) - 15 AS y,
  1 + p_size * 4 AS w, CAST(1 + l_quantity * 3 AS INT) AS h, (1 + p_size * 4) * CAST(1 + l_quantity * 3 AS INT) AS area,
  l_linenumber = 7 AS iscrowd, 640 AS image_width, 480 AS image_height
FROM lineitem JOIN part ON p_partkey = l_partkey
"""
FEAT = """
SELECT p_partkey AS id, ((p_partkey * 7) % 1000) / 1000.0 AS u, ((p_partkey * 11) % 1000) / 1000.0 AS l, ((p_partkey * 13) % 1000) / 1000.0 AS f,
  ((p_partkey * 17) % 1000) / 1000.0 AS blue, ((p_partkey * 19) % 1000) / 1000.0 AS cloud, ((p_partkey * 23) % 1000) / 2000.0 AS green,
  ((p_partkey * 29) % 1000) / 10000.0 AS dark, ((p_partkey * 31) % 1000) / 1000.0 * 400 AS tex, ((p_partkey * 37) % 1000) / 1000.0 * 255 AS bri,
  ((p_partkey * 41) % 1000) / 1000.0 AS cy, ((p_partkey * 43) % 1000) / 1000.0 AS bottom, ((p_partkey * 47) % 1000) / 4000.0 AS area_ratio,
  ((p_partkey * 53) % 1000) / 2000.0 AS max_dim_ratio, ((p_partkey * 59) % 1000) / 5000.0 AS margin, ((p_partkey * 61) % 1000) / 1000.0 * 1200 AS upper_tex,
  CASE p_partkey % 9 WHEN 0 THEN 'ground_to_air' WHEN 1 THEN 'horizon_side_view' WHEN 2 THEN 'top_down' WHEN 3 THEN 'drone_on_ground' WHEN 4 THEN 'product_photo'
    WHEN 5 THEN 'indoor' WHEN 6 THEN 'irrelevant' WHEN 7 THEN 'ambiguous' ELSE NULL END AS clip_scene,
  CASE p_partkey % 9 WHEN 0 THEN 'clean_sky' WHEN 1 THEN 'cloudy_sky' WHEN 2 THEN 'sky_with_trees' WHEN 3 THEN 'sky_with_buildings' WHEN 4 THEN 'horizon'
    WHEN 5 THEN 'night_low_light' WHEN 6 THEN 'reject_irrelevant' WHEN 7 THEN 'review_ambiguous' ELSE NULL END AS clip_background,
  CASE p_partkey % 4 WHEN 0 THEN 'bird' WHEN 1 THEN 'drone' ELSE 'kite' END AS cls,
  CAST(p_partkey % 700 AS INT) AS width, CAST((p_partkey * 3) % 500 AS INT) AS height,
  ((p_partkey * 67) % 1000) / 1000.0 AS bad, ((p_partkey * 71) % 1000) / 1000.0 * 0.5 AS largest, ((p_partkey * 73) % 1000) / 10000.0 AS person_sum,
  ((p_partkey * 79) % 1000) / 12000.0 AS person_max, ((p_partkey * 83) % 1000) / 9000.0 AS food_sum, ((p_partkey * 89) % 1000) / 14000.0 AS indoor_max,
  ((p_partkey * 97) % 1000) / 4000.0 AS vehicle_max, ((p_partkey * 101) % 1000) / 9000.0 AS animal_top, ((p_partkey * 103) % 1000) / 8000.0 AS sports_top
FROM part
"""
ASSET = """
SELECT p_partkey AS id, p_name AS asset_name,
  CASE p_partkey % 3 WHEN 0 THEN 'drone' WHEN 1 THEN 'bird' ELSE 'airplane' END AS asset_type,
  CASE p_partkey % 4 WHEN 0 THEN 'bird' WHEN 1 THEN 'airplane' WHEN 2 THEN 'kite' ELSE 'other' END AS cls,
  CASE p_size % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE '' END AS label,
  CASE p_size % 5 WHEN 0 THEN 'accept' WHEN 1 THEN ' Review ' WHEN 2 THEN 'nan' WHEN 3 THEN '' ELSE NULL END AS qa_label,
  CASE p_size % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'review' ELSE 'accept' END AS quality_label,
  CASE p_partkey % 9 WHEN 0 THEN 'mask_too_large_review' WHEN 1 THEN 'mask_small_review;likely_background_blob' WHEN 2 THEN NULL ELSE '' END AS review_text,
  CASE p_partkey % 6 WHEN 0 THEN 'used_inverse_mask' WHEN 1 THEN NULL ELSE 'best_score' END AS selection, CASE WHEN p_partkey % 31 = 0 THEN 'empty_image' ELSE '' END AS alpha_error,
  CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 1600 END AS crop_area,
  p_partkey % 17 = 0 AS failed, p_partkey % 23 = 0 AS missing, p_partkey % 13 = 0 AS inverted, p_partkey % 2 = 0 AS sam2,
  ((p_partkey * 7) % 1000) / 1000.0 AS r, CAST((p_partkey * 11) % 5 AS INT) AS k, CAST((p_partkey * 13) % 40 AS INT) AS area,
  0.5 + ((p_partkey * 17) % 1000) / 800.0 AS ca, 0.5 + ((p_partkey * 19) % 1000) / 800.0 AS ba, ((p_partkey * 23) % 1000) / 1000.0 AS br,
  ((p_partkey * 29) % 1000) / 200.0 AS bbox_ratio, ((p_partkey * 31) % 1000) / 1000.0 AS alpha_area, ((p_partkey * 37) % 1000) / 1000.0 AS rectangle,
  ((p_partkey * 41) % 1000) / 1000.0 AS border, CAST((p_partkey * 43) % 10 AS INT) AS comps, ((p_partkey * 47) % 1000) / 1000.0 AS largest,
  CASE p_partkey % 4 WHEN 0 THEN 'center_heuristic' WHEN 1 THEN 'largest_detection_fallback' WHEN 2 THEN 'yolo_bird' ELSE 'manual' END AS proposal,
  ((p_partkey * 53) % 1000) / 1000.0 AS conf, ((p_partkey * 59) % 1000) / 1000.0 AS centre, ((p_partkey * 61) % 1000) / 250.0 AS expand
FROM part
"""
HARD = """
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'bird' WHEN 1 THEN 'airplane' ELSE 'kite' END AS cls, p_partkey % 19 = 0 AS missing,
  ((p_partkey * 7) % 1000) / 2000.0 AS a, CAST((p_partkey * 11) % 600 AS INT) AS m, CAST(1 + (p_partkey * 13) % 4 AS INT) AS n,
  ((p_partkey * 17) % 1000) / 1000.0 AS cy, ((p_partkey * 19) % 1000) / 400.0 AS aspect,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE ((p_partkey * 23) % 1000) / 2500.0 END AS u,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE ((p_partkey * 29) % 1000) / 2500.0 END AS f
FROM part
"""
QA = """
SELECT d.doc_id, d.source, concat(d.source, '/', CAST(d.doc_id AS VARCHAR(20))) AS path, d.n_chars,
  CASE q.quality WHEN 1 THEN 'Accept ' WHEN 0 THEN 'reject' ELSE NULL END AS qa_final_label,
  CASE WHEN q.toxic = 1 THEN 'review' WHEN q.toxic = 0 THEN 'nan' ELSE NULL END AS quality_label,
  CASE WHEN d.doc_id % 3 = 0 THEN 'accept' ELSE '' END AS mask_quality_label, d.doc_id % 11 = 0 AS extraction_failed
FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id
"""
FRAMES = """
SELECT event_id, concat('seq_', CAST(user_id AS VARCHAR(20))) AS sequence_key, user_id, ts,
  concat('f', CAST(event_id AS VARCHAR(20)), '.png') AS filename, event_type, value FROM events
"""
LABEL_TEXT = """
SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 17 = 0 THEN '# comment'
    WHEN l_partkey % 13 = 0 THEN concat(CAST(l_suppkey % 4 AS VARCHAR(9)), ' abc 0.5 0.1 0.1')
    WHEN l_partkey % 11 = 0 THEN concat(CAST(l_suppkey % 4 AS VARCHAR(9)), ' 0.5 0.5')
    ELSE concat(CAST(l_suppkey % 4 AS VARCHAR(9)), ' 0.', CAST(100 + l_partkey % 900 AS VARCHAR(9)), ' 0.', CAST(100 + l_suppkey % 900 AS VARCHAR(9)), ' 0.',
      CAST(100 + (l_partkey * 7) % 400 AS VARCHAR(9)), ' 0.0', CAST(10 + (l_suppkey * 3) % 90 AS VARCHAR(9))) END AS line_text
FROM lineitem
"""
LLM = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not json at all {'
  WHEN event_id % 5 = 0 THEN concat('```json', chr(10), '{"decision": "', event_type, '", "sky": "', CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END, '"}', chr(10), '```')
  ELSE concat('{"decision": "', CASE event_id % 4 WHEN 0 THEN 'Reject' WHEN 1 THEN 'review' WHEN 2 THEN 'accept' ELSE 'maybe' END, '", "sky": "',
    CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'medium' ELSE 'small' END, '"}') END AS reply
FROM events
"""

RELATIONS = {
    "fx_meta": META,
    "fx_gt": GT,
    "fx_pred": PRED,
    "fx_ann": ANN,
    "fx_feat": FEAT,
    "fx_asset": ASSET,
    "fx_hard": HARD,
    "fx_qa": QA,
    "fx_frames": FRAMES,
    "fx_label_text": LABEL_TEXT,
    "fx_llm": LLM,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def needed(text: str) -> list[str]:
    """The relations that ``text`` names, those they name first."""
    out: list[str] = []
    for name, body in RELATIONS.items():
        if re.search(rf"\b{name}\b", text):
            out += [x for x in [*needed(body), name] if x not in out]
    return out


def with_relations(sql: str) -> str:
    """``sql`` with the relations it names as common table expressions."""
    ctes = [f"{n} AS ({RELATIONS[n]})" for n in needed(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a relation derived from base tables."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = RELATIONS[name]
    used = {t: table(spark, sf_dir, t) for t in (*TABLES, *RELATIONS) if re.search(rf"\b{t}\b", body) and t != name}
    escaped = body.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)", r"{\1}", escaped), **used)
