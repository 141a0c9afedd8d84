"""SQL of the rule cascades, written from their definitions and not from ``plans.rules``.

Each text is one nested ``CASE`` per relation that gives words joined by ``|``; queries in ``registry`` compare it with the
cascades.  Sums are rounded before they are compared, as one engine computes them in decimals.
"""

from __future__ import annotations


def split_words(decision: str, relation: str, keep: str, names: tuple[str, ...]) -> str:
    """A query with ``keep`` and the words of ``decision`` as columns."""
    words = f"said_{names[0]}"
    columns = ", ".join(f"{words}[{i + 1}] AS {n}" for i, n in enumerate(names))
    return f"SELECT {keep}, {columns} FROM (SELECT *, string_split({decision}, '|') AS {words} FROM {relation})"


_LARGE = "(area_ratio >= 0.10 OR max_dim_ratio >= 0.28)"

SCENE_WORDS = f"""CASE WHEN u <= 0.08 AND round(u + l, 6) <= 0.12 THEN 'reject|likely_top_down_or_non_sky|indoor'
  WHEN u < 0.12 AND (cy >= 0.72 OR bottom >= 0.90) AND {_LARGE} THEN 'reject|likely_product_or_ground_closeup|product_photo'
  WHEN u < 0.12 AND cy >= 0.72 THEN 'reject|likely_top_down_or_non_sky|top_down'
  WHEN u < 0.18 AND bottom >= 0.90 THEN 'reject|likely_product_or_ground_closeup|' || CASE WHEN cls IN ('bird', 'drone') THEN cls || '_on_ground' ELSE 'irrelevant' END
  WHEN u >= 0.28 AND cy <= 0.72 THEN CASE WHEN {_LARGE} THEN 'review|large_but_sky_candidate|ground_to_air' ELSE 'accept|flying_sky_candidate|ground_to_air' END
  WHEN u >= 0.20 AND round(u - l, 6) > 0.05 THEN CASE WHEN {_LARGE} THEN 'review|large_but_sky_candidate|horizon_side_view' ELSE 'accept|horizon_candidate|horizon_side_view' END
  WHEN u >= 0.18 THEN CASE WHEN {_LARGE} THEN 'review|large_but_sky_candidate|horizon_side_view' ELSE 'review|horizon_candidate|horizon_side_view' END
  WHEN {_LARGE} OR area_ratio > 0.05 THEN 'review|large_object_review|unknown'
  ELSE 'review|horizon_candidate|unknown' END"""
SCENE = split_words(SCENE_WORDS, "fx_feat", "*", ("disposition", "reason", "viewpoint"))

_GOOD = "clip_scene IN ('ground_to_air', 'horizon_side_view')"
_STRONG = "clip_scene IN ('top_down', 'drone_on_ground', 'product_photo', 'indoor')"
_BAD = "clip_scene IN ('top_down', 'drone_on_ground', 'product_photo', 'indoor', 'irrelevant')"

SCENE_ASSET_WORDS = f"""CASE WHEN clip_scene IS NULL THEN disposition || '|heuristic_only'
  WHEN disposition = 'reject' THEN 'reject|heuristic_hard_reject'
  WHEN {_BAD} AND u < 0.18 AND cy >= 0.72 THEN 'reject|clip_bad_scene_cues_reject'
  ELSE CASE reason WHEN 'large_but_sky_candidate' THEN CASE WHEN {_GOOD} THEN 'accept|large_sky_clip_good_accept'
        WHEN clip_scene = 'ambiguous' OR margin < 0.05 THEN 'review|large_sky_clip_ambiguous_review'
        WHEN {_BAD} AND u < 0.18 THEN 'reject|large_sky_clip_bad_weak_sky_reject' ELSE 'review|large_sky_default_review' END
      WHEN 'large_object_review' THEN CASE WHEN {_GOOD} THEN 'accept|large_object_clip_good_accept'
        WHEN {_BAD} AND u < 0.18 THEN 'reject|large_object_clip_bad_weak_sky_reject' ELSE 'review|large_object_default_review' END
      ELSE CASE WHEN {_STRONG} THEN 'review|strong_heuristic_clip_bad_review' ELSE 'accept|strong_heuristic_preserved_accept' END END END"""
SCENE_ASSET = split_words(SCENE_ASSET_WORDS, f"({SCENE})", "id, disposition", ("final_disposition", "final_reason"))

SCENE_EVAL_WORDS = f"""CASE WHEN clip_scene IS NULL THEN disposition || '|heuristic_only'
  WHEN disposition = 'reject' THEN 'reject|heuristic_hard_reject'
  WHEN {_LARGE} AND {_BAD} AND u < 0.18 THEN 'reject|large_bbox_clip_bad_scene_reject'
  WHEN {_LARGE} AND {_GOOD} AND disposition = 'accept' THEN 'accept|large_bbox_clip_good_keep'
  WHEN margin < 0.05 THEN 'review|clip_low_margin_review'
  WHEN disposition = 'accept' AND {_GOOD} THEN 'accept|heuristic_clip_agree_accept'
  WHEN disposition = 'review' AND NOT {_GOOD} AND NOT {_BAD} THEN 'review|heuristic_clip_agree_review'
  ELSE 'review|heuristic_clip_disagree_review' END"""
SCENE_EVAL = split_words(SCENE_EVAL_WORDS, f"({SCENE})", "id, disposition", ("final_disposition", "final_reason"))

_HORIZON = "round(u - CASE WHEN 2 * f > u THEN 2 * f - u ELSE 0 END, 6) > 0.06"
BACKGROUND_WORDS = f"""CASE WHEN least(width, height) < 64 THEN 'reject|reject|image_too_small'
  WHEN bri < 55 AND f >= 0.05 AND (dark > 0.01 OR tex > 80) THEN 'review|review|night_low_light_candidate'
  WHEN u < 0.08 AND f < 0.06 THEN 'reject|reject|no_sky'
  WHEN u < 0.08 AND f < 0.10 THEN 'reject|reject|no_sky_indoor_or_closeup'
  WHEN u < 0.10 AND tex < 120 THEN 'reject|reject|indoor_low_sky'
  WHEN u < 0.12 AND green < 0.05 AND NOT ({_HORIZON}) THEN 'reject|reject|closeup_or_mostly_ground'
  WHEN cloud >= 0.18 AND u >= 0.28 THEN 'cloudy_sky|accept|cloudy_upper_sky'
  WHEN green >= 0.16 AND u >= 0.22 THEN 'trees_sky|accept|sky_with_trees_lower'
  WHEN dark >= 0.025 AND u >= 0.22 AND tex >= 150 AND green < 0.14 THEN 'urban_skyline|accept|sky_with_buildings_lower'
  WHEN green < 0.12 AND dark < 0.03 AND u >= 0.35 AND blue >= 0.12 AND cloud < 0.35 AND tex < 250 THEN 'clean_sky|accept|clean_blue_sky_low_texture'
  WHEN green < 0.12 AND dark < 0.03 AND u >= 0.38 AND cloud < 0.30 THEN 'clean_sky|accept|clean_upper_sky_low_texture'
  WHEN u >= 0.16 AND u < 0.38 AND {_HORIZON} THEN 'horizon|accept|horizon_structure'
  WHEN u >= 0.28 THEN CASE WHEN cloud >= 0.12 THEN 'cloudy_sky|review|uncertain_cloudy_sky' WHEN green >= 0.10 THEN 'trees_sky|review|uncertain_trees_sky'
    WHEN dark >= 0.02 THEN 'urban_skyline|review|uncertain_urban_skyline' ELSE 'clean_sky|review|uncertain_clean_sky' END
  WHEN u >= 0.14 AND {_HORIZON} THEN 'horizon|review|uncertain_horizon'
  WHEN u >= 0.12 THEN 'review|review|uncertain_sky_scene' ELSE 'reject|reject|insufficient_sky' END"""
BACKGROUND = split_words(BACKGROUND_WORDS, "fx_feat", "*", ("type", "status", "reason"))

_ABSORB = """CASE WHEN cloud >= 0.14 AND u >= 0.18 THEN 'cloudy_sky' WHEN green >= 0.10 THEN 'sky_with_natural_landscape'
  WHEN dark >= 0.018 OR tex >= 180 THEN 'sky_with_built_environment' WHEN u >= 0.28 THEN 'clear_upper_sky' ELSE 'review_ambiguous' END"""
_TO_V1 = f"""(VALUES ('clean_sky', 'clear_upper_sky'), ('cloudy_sky', 'cloudy_sky'), ('trees_sky', 'sky_with_natural_landscape'), ('sky_with_trees', 'sky_with_natural_landscape'),
  ('urban_skyline', 'sky_with_built_environment'), ('sky_with_buildings', 'sky_with_built_environment'), ('review', 'review_ambiguous'), ('reject', 'reject_irrelevant')) v(label, category)"""
_V1 = lambda c: f"CASE WHEN {c} = 'horizon' THEN {_ABSORB} ELSE (SELECT category FROM {_TO_V1} WHERE label = {c}) END"
_V1_NAMES = "('clear_upper_sky', 'cloudy_sky', 'sky_with_natural_landscape', 'sky_with_built_environment')"
#: Labels of either side as numbers: 1 clean, 2 cloudy, 3 natural, 4 built, 5 horizon, 0 anything else.
_CODE = lambda c: f"CASE WHEN {c} = 'clean_sky' THEN 1 WHEN {c} = 'cloudy_sky' THEN 2 WHEN {c} IN ('trees_sky', 'sky_with_trees') THEN 3 WHEN {c} IN ('urban_skyline', 'sky_with_buildings') THEN 4 WHEN {c} = 'horizon' THEN 5 ELSE 0 END"

BACKGROUND_V1 = f"""WITH b AS MATERIALIZED ({BACKGROUND}),
c AS (SELECT *, {_CODE('type')} AS h, {_CODE('clip_background')} AS c, {_V1('type')} AS hv, {_V1('clip_background')} AS cv, {_ABSORB} AS none FROM b),
n AS (SELECT *, hv IN {_V1_NAMES} AS h_ok, coalesce(cv IN {_V1_NAMES}, FALSE) AS c_ok, clip_background IS NULL OR (h > 0 AND c > 0 AND (h = c OR h = 5 OR c = 5)) AS fits FROM c),
d AS (SELECT *, CASE WHEN least(width, height) = 0 OR (f < 0.02 AND bri < 12) OR (type = 'reject' AND u < 0.08) OR (u < 0.06 AND f < 0.05) THEN 'reject|reject_irrelevant|unusable_dark_or_no_scene'
  WHEN clip_background = 'night_low_light' OR contains(reason, 'night_low_light') OR (bri < 58 AND f >= 0.04 AND (dark > 0.008 OR tex > 70)) THEN 'holdout_night|night_low_light|night_low_light_holdout'
  WHEN h > 0 AND status = 'accept' AND h_ok AND fits THEN 'approved_daytime|' || hv || '|strong_heuristic_accept'
  WHEN h > 0 AND status = 'accept' AND h_ok AND c_ok THEN 'approved_daytime|' || cv || '|strong_heuristic_compatible_clip'
  WHEN h > 0 AND u >= 0.15 AND h_ok AND fits THEN 'approved_daytime|' || hv || '|heuristic_useful_daytime'
  WHEN h > 0 AND u >= 0.15 AND h_ok AND c_ok THEN 'approved_daytime|' || cv || '|heuristic_useful_compatible_clip'
  WHEN type = 'reject' AND u >= 0.22 AND c > 0 AND c_ok THEN 'approved_daytime|' || cv || '|salvage_reject_heuristic_clip_daytime'
  WHEN type = 'reject' AND u >= 0.28 AND none IN {_V1_NAMES} THEN 'approved_daytime|' || none || '|salvage_strong_sky_from_reject'
  WHEN h = 0 AND u >= 0.15 AND c > 0 AND c_ok THEN 'approved_daytime|' || cv || '|clip_daytime_salvage'
  WHEN type = 'reject' AND u < 0.15 THEN 'reject|reject_irrelevant|heuristic_reject_no_useful_sky'
  WHEN h = 0 AND (clip_background IS NULL OR clip_background IN ('review_ambiguous', 'reject_irrelevant')) THEN 'review|review_ambiguous|' || CASE WHEN u >= 0.15 THEN 'borderline_useful_ambiguous' ELSE 'ambiguous_weak_signals' END
  WHEN clip_background = 'reject_irrelevant' AND u < 0.15 THEN 'reject|reject_irrelevant|clip_reject_no_useful_sky'
  WHEN h_ok AND u >= 0.15 THEN 'approved_daytime|' || hv || '|default_heuristic_v1' ELSE 'review|review_ambiguous|uncertain_merge' END AS said FROM n)
SELECT id, status, split_part(said, '|', 1) AS split, split_part(said, '|', 2) AS category, split_part(said, '|', 3) AS merge_reason FROM d"""

COCO_STRICT = f"""WITH b AS MATERIALIZED ({BACKGROUND}), c AS (SELECT *, CASE WHEN type = 'horizon' THEN {_ABSORB} ELSE {_V1('type')} END AS v FROM b),
d AS (SELECT id, CASE WHEN person_sum >= 0.08 THEN 'reject|person_dominated' WHEN person_max >= 0.06 THEN 'reject|person_closeup' WHEN food_sum >= 0.10 THEN 'reject|food_dominated'
  WHEN indoor_max >= 0.06 THEN 'reject|indoor_object_dominated' WHEN vehicle_max >= 0.22 THEN 'reject|vehicle_dominated' WHEN animal_top >= 0.10 THEN 'reject|animal_dominated'
  WHEN sports_top >= 0.12 THEN 'reject|sports_closeup_dominated' WHEN bad > 0.25 THEN 'reject|bad_category_area_high' WHEN bad > 0.18 THEN 'review|bad_category_area_borderline'
  WHEN largest > 0.35 THEN CASE WHEN u >= 0.45 THEN 'review' ELSE 'reject' END || '|object_dominated_large_bbox'
  WHEN indoor_max >= 0.04 OR (u < 0.20 AND indoor_max >= 0.02) OR (u < 0.15 AND f < 0.12) OR (u < 0.12 AND tex < 120) THEN 'reject|likely_indoor_scene'
  WHEN u < 0.25 THEN 'reject|insufficient_upper_sky' WHEN status = 'reject' THEN 'reject|' || reason
  WHEN status = 'review' OR v NOT IN {_V1_NAMES} THEN 'review|' || reason
  WHEN v = 'clear_upper_sky' AND u < 0.45 OR v = 'cloudy_sky' AND u < 0.35 THEN 'review|below_upper_sky_' || v
  WHEN v IN ('sky_with_natural_landscape', 'sky_with_built_environment') AND green < 0.10 AND dark < 0.02 AND NOT ({_HORIZON}) THEN 'review|no_outdoor_horizon_context'
  ELSE 'accept|' || reason END AS said FROM c)
SELECT id, split_part(said, '|', 1) AS decision, split_part(said, '|', 2) AS why FROM d"""

COCO_PERMISSIVE = f"""WITH b AS MATERIALIZED ({BACKGROUND}), c AS (SELECT *, {_V1('type')} AS v FROM b),
d AS (SELECT id, CASE WHEN person_sum >= 0.12 THEN 'reject|person_dominated' WHEN food_sum >= 0.14 THEN 'reject|food_dominated' WHEN indoor_max >= 0.10 THEN 'reject|indoor_object_dominated'
  WHEN animal_top >= 0.16 THEN 'reject|animal_closeup' WHEN status = 'reject' THEN 'reject|' || reason WHEN u < 0.12 THEN 'reject|no_plausible_upper_sky'
  WHEN status = 'accept' AND v IN {_V1_NAMES} THEN 'accept|' || reason ELSE 'review|' || reason END AS said FROM c)
SELECT id, split_part(said, '|', 1) AS decision, split_part(said, '|', 2) AS why FROM d"""

HARD_NEGATIVE = """WITH s AS (SELECT *, coalesce(u >= 0.18 OR f >= 0.22, FALSE) AS outdoors, coalesce(u < 0.10 AND f < 0.10, FALSE) AS indoors FROM fx_hard),
e AS (SELECT *, CASE WHEN missing THEN 'reject|image_missing' WHEN m < 20 THEN 'review|object_tiny_review' WHEN a > 0.40 THEN 'review|closeup_large_area_review'
  WHEN indoors AND a > 0.30 THEN 'review|indoor_no_sky_review' END AS early FROM s),
k AS (SELECT *, CASE cls
  WHEN 'bird' THEN CASE WHEN a >= 0.20 THEN 'review|bird_closeup_review' WHEN n = 1 AND (m > 280 OR a >= 0.12) THEN 'review|bird_large_single_review'
    WHEN n >= 2 AND (u IS NULL OR outdoors OR (u >= 0.14 AND NOT indoors)) THEN 'approved|bird_multi_object_sky'
    WHEN m <= 250 AND (outdoors OR coalesce(u >= 0.14 AND NOT indoors, FALSE)) THEN 'approved|bird_distant_outdoor' ELSE 'review|uncertain_review' END
  WHEN 'airplane' THEN CASE WHEN a >= 0.25 THEN 'review|airplane_closeup_review' WHEN m > 450 AND cy >= 0.72 THEN 'review|airplane_large_ground_review' WHEN m < 30 THEN 'review|uncertain_review'
    WHEN m > 500 THEN 'approved|airplane_outdoor_candidate' WHEN indoors THEN 'review|indoor_no_sky_review' WHEN aspect > 1.2 THEN 'approved|airplane_wide_outdoor' ELSE 'approved|airplane_distant_outdoor' END
  WHEN 'kite' THEN CASE WHEN a >= 0.30 THEN 'review|kite_closeup_review' WHEN n >= 2 THEN 'approved|kite_multi_object' WHEN indoors AND a > 0.15 THEN 'review|indoor_no_sky_review'
    WHEN a < 0.15 THEN 'approved|kite_outdoor_scene' ELSE 'approved|kite_small_outdoor' END
  ELSE 'review|uncertain_review' END AS own FROM e),
g AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN own LIKE 'approved%' AND indoors THEN 'review|indoor_no_sky_review'
  WHEN own LIKE 'review%' AND outdoors AND a < 0.25 AND cy < 0.80 THEN 'approved|sky_boost_approved' ELSE own END AS x FROM k),
z AS (SELECT *, CASE WHEN x LIKE 'approved%' AND cy >= 0.75 AND n < 2 AND cls <> 'kite' THEN 'review|uncertain_review' ELSE x END AS y FROM g),
o AS (SELECT id, cls, split_part(y, '|', 1) AS status, split_part(y, '|', 2) AS reason FROM z)
SELECT *, CAST(CASE WHEN reason IN ('image_missing', 'clearly_unusable') THEN 0 WHEN reason = 'uncertain_review' THEN 25 WHEN reason = 'indoor_no_sky_review' THEN 30
  WHEN reason IN ('object_tiny_review', 'closeup_large_area_review') THEN 35 WHEN status = 'review' THEN 40 WHEN reason = 'airplane_outdoor_candidate' THEN 70 WHEN reason = 'kite_small_outdoor' THEN 75
  WHEN reason = 'sky_boost_approved' THEN 80 WHEN reason = 'airplane_wide_outdoor' THEN 85 WHEN reason IN ('kite_outdoor_scene', 'airplane_distant_outdoor') THEN 90
  WHEN reason = 'bird_multi_object_sky' THEN 100 ELSE 95 END AS INT) AS priority FROM o"""

DISTRACTOR = """WITH g AS (SELECT *, (k >= 2) :: INT + (r > 0.75) :: INT + (ca < 1) :: INT AS odd FROM fx_asset),
d AS (SELECT id, cls, CASE cls
  WHEN 'bird' THEN CASE WHEN label = 'reject' THEN 'reject|technical_qa_reject' WHEN k >= 3 THEN 'reject|mask_touches_many_borders' WHEN r < 0.02 OR r > 0.85 THEN 'reject|extreme_mask_area_ratio'
    WHEN greatest(ca, ba) >= 1.15 THEN CASE WHEN label = 'accept' THEN 'approved|bird_flying_like_shape' ELSE 'review|bird_flying_shape_technical_review' END
    WHEN greatest(ca, ba) < 0.85 THEN CASE WHEN label = 'accept' THEN 'review|bird_vertical_portrait_like' ELSE 'review|bird_vertical_technical_review' END
    WHEN label = 'accept' THEN 'review|bird_ambiguous_shape' ELSE 'review|bird_technical_review' END
  WHEN 'airplane' THEN CASE WHEN label = 'reject' THEN 'reject|technical_qa_reject' WHEN odd = 3 THEN 'reject|airplane_extreme_partial_crop' WHEN odd = 2 THEN 'review|airplane_likely_nose_tail_fragment'
    WHEN greatest(ca, ba) >= 1.5 AND k <= 1 AND r <= 0.75 THEN CASE WHEN label = 'accept' THEN 'approved|airplane_wide_full_like' ELSE 'review|airplane_partial_but_wide' END
    WHEN odd = 1 THEN 'review|airplane_likely_nose_tail_fragment' ELSE 'review|airplane_ambiguous' END
  WHEN 'kite' THEN CASE WHEN label = 'reject' OR k >= 3 OR r > 0.95 THEN 'reject|kite_extreme_failure'
    WHEN label = 'accept' AND r BETWEEN 0.03 AND 0.85 THEN CASE WHEN k = 2 THEN 'review|kite_border_touch_review' ELSE 'approved|kite_ok' END
    WHEN k = 2 OR r < 0.03 THEN 'review|kite_small_or_fragment' ELSE 'review|kite_technical_review' END
  ELSE 'reject|unknown_class' END AS said FROM g),
o AS (SELECT id, cls, split_part(said, '|', 1) AS status, split_part(said, '|', 2) AS reason FROM d)
SELECT *, CAST(coalesce((SELECT p FROM (VALUES ('airplane_partial_but_wide', 70), ('bird_flying_shape_technical_review', 65), ('kite_border_touch_review', 60), ('bird_ambiguous_shape', 50),
  ('bird_vertical_portrait_like', 40), ('kite_small_or_fragment', 35), ('airplane_likely_nose_tail_fragment', 30), ('bird_vertical_technical_review', 25), ('kite_technical_review', 20),
  ('airplane_ambiguous', 15), ('bird_technical_review', 10)) t(name, p) WHERE name = reason), CASE status WHEN 'approved' THEN 100 ELSE 0 END) AS INT) AS priority FROM o"""

PLACES = """WITH x AS (SELECT id, u, least(width, height) + 300 AS short, CASE WHEN id % 4 = 0 THEN 0.15 ELSE 0.18 END AS enough FROM fx_feat)
SELECT id, CASE WHEN short < 512 OR u < 0.10 THEN 'reject' WHEN u < enough THEN 'review' ELSE 'accept' END AS status,
  CASE WHEN short < 512 THEN 'image_too_small' WHEN u < 0.10 THEN 'insufficient_upper_sky' WHEN u < enough THEN 'borderline_upper_sky' ELSE 'ok' END AS reason FROM x"""

OVERLAY = f"""WITH b AS MATERIALIZED ({BACKGROUND}), one AS (SELECT *, u < 0.18 AND status <> 'reject' AS h1 FROM b),
two AS (SELECT *, NOT h1 AND status = 'accept' AND bri < 40 AS h2 FROM one), three AS (SELECT *, NOT h1 AND NOT h2 AND status = 'accept' AND upper_tex > 900 AND u < 0.30 AS h3 FROM two),
four AS (SELECT *, status <> 'reject' AND green > 0.28 AND u < 0.25 AS h4 FROM three), five AS (SELECT *, status <> 'reject' AND NOT h4 AND dark > 0.06 AND u < 0.20 AS h5 FROM four)
SELECT id, status, CASE WHEN status = 'reject' OR h4 OR h5 THEN 'reject' WHEN h1 OR h2 OR h3 THEN 'review' ELSE status END AS qa_status,
  concat_ws(';', reason, CASE WHEN h1 THEN 'low_upper_sky_ratio' END, CASE WHEN h2 THEN 'dark_scene' END, CASE WHEN h3 THEN 'upper_high_texture' END, CASE WHEN h4 THEN 'forest_or_ground_dominant' END,
    CASE WHEN h5 THEN 'built_environment_low_sky' END) AS qa_reasons,
  CASE WHEN status = 'reject' OR h4 OR h5 THEN 'reject' WHEN h1 OR h2 OR h3 OR type = 'review' THEN 'low_sky_or_contextual' WHEN type = 'clean_sky' THEN 'clear_upper_sky'
    WHEN type = 'cloudy_sky' THEN 'cloudy_sky' WHEN type = 'urban_skyline' THEN 'sky_with_built_environment' ELSE 'sky_with_natural_landscape' END AS background_category FROM five"""

MASK = """WITH x AS (SELECT id, r, k, sam2, area = 0 AS none, CASE WHEN r > 0.95 THEN 2 WHEN r > 0.80 THEN 1 ELSE 0 END AS big, CASE WHEN r < 0.01 THEN 2 WHEN r < 0.05 THEN 1 ELSE 0 END AS small FROM fx_asset),
y AS (SELECT *, concat_ws(';', CASE WHEN none THEN 'empty_mask' WHEN small = 2 THEN 'mask_too_small' WHEN small = 1 THEN 'mask_small_review' END,
  CASE big WHEN 2 THEN 'likely_background_blob' WHEN 1 THEN 'mask_too_large_review' END, CASE WHEN k >= 3 THEN 'mask_touches_many_borders' WHEN k = 2 THEN 'mask_touches_two_borders' END) AS reasons FROM x)
SELECT id, reasons, CASE WHEN none OR small = 2 OR big = 2 OR k >= 3 THEN 'reject' WHEN reasons = '' AND sam2 THEN 'accept' ELSE 'review' END AS label,
  CASE WHEN none OR small = 2 THEN 0.0 ELSE CAST(round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN small = 1 THEN 0.25::DOUBLE WHEN big > 0 THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN big = 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + 0.12::DOUBLE * k))), 3) AS DOUBLE) END AS score FROM y"""

SEGMENT = """WITH x AS (SELECT id, area, crop_area, r, k, CASE WHEN crop_area = 0 THEN 'invalid_crop' WHEN area = 0 THEN 'empty_mask' END AS stop FROM fx_asset),
y AS (SELECT *, CASE WHEN stop IS NOT NULL THEN stop ELSE concat_ws(';', CASE WHEN area < 4 THEN 'mask_too_small' END,
  CASE WHEN r > 0.95 THEN 'likely_background_blob' WHEN r > 0.85 THEN 'mask_too_large_review' WHEN r < 0.03 THEN 'mask_small_review' END,
  CASE WHEN k >= 3 THEN 'mask_touches_many_borders' WHEN k = 2 THEN 'mask_touches_two_borders' END) END AS reasons FROM x)
SELECT id, reasons, CASE WHEN stop IS NOT NULL OR r > 0.95 OR k >= 3 THEN 'reject' WHEN reasons = '' THEN 'accept' ELSE 'review' END AS label FROM y"""

_W = lambda condition, reason: f"CASE WHEN {condition} THEN '{reason}' END"
ASSET = f"""WITH x AS (SELECT *, coalesce(review_text, '') || ' ' || coalesce(selection, '') AS notes, proposal = 'center_heuristic' AS centred, proposal IN ('center_heuristic', 'largest_detection_fallback') AS weak FROM fx_asset),
y AS (SELECT *, concat_ws(';', {_W('failed', 'extraction_failed')}, {_W('missing', 'missing_asset_file')}, {_W("quality_label = 'reject'", 'quality_label_reject')}, {_W("label = 'reject'", 'mask_quality_label_reject')},
  {_W('r > 0.70', 'mask_area_ratio_high')}, {_W('br > 0.65', 'mask_touches_border_high')}, {_W('bbox_ratio > 4', 'mask_bbox_area_ratio_high')},
  {_W("regexp_matches(notes, 'likely_background_blob|mask_too_large|missing_proposal|failed|no_object')", 'mask_review_hard_failure')},
  CASE WHEN alpha_error <> '' THEN 'alpha_analysis_error:' || alpha_error WHEN alpha_area < 0.005 THEN 'alpha_area_tiny' WHEN rectangle > 0.65 THEN 'opaque_background_rectangle'
    WHEN border > 0.72 AND alpha_area > 0.70 THEN 'alpha_border_background_blob' END, {_W('comps >= 8 AND largest < 0.45', 'alpha_many_fragments')},
  CASE asset_type WHEN 'drone' THEN nullif(concat_ws(';', {_W('r > 0.55 AND br > 0.50', 'drone_large_background_patch')}, {_W('alpha_area > 0.65 AND border > 0.55', 'drone_background_residue')},
      {_W('comps > 3 AND largest < 0.35', 'drone_broken_shape')}, {_W('weak AND r > 0.50', 'drone_weak_proposal_large_mask')}), '')
    WHEN 'bird' THEN nullif(concat_ws(';', {_W('comps >= 5 AND largest < 0.40', 'bird_fragmented')}, {_W('r > 0.62 AND br > 0.55', 'bird_large_sky_chunk')}, {_W('alpha_area < 0.02', 'bird_mostly_missing')}), '')
    ELSE nullif(concat_ws(';', {_W('alpha_area < 0.015', 'airplane_mostly_missing')}, {_W('r > 0.75 AND br > 0.70', 'airplane_huge_background_blob')}, {_W('rectangle > 0.75', 'airplane_crop_failure')}), '') END) AS no,
 concat_ws(';', {_W("quality_label = 'review'", 'quality_label_review')}, {_W("label = 'review'", 'mask_quality_label_review')}, {_W('inverted', 'mask_inverted')}, {_W('r BETWEEN 0.45 AND 0.70', 'mask_area_ratio_mid')},
  {_W('br BETWEEN 0.35 AND 0.65', 'mask_touches_border_mid')}, {_W('bbox_ratio BETWEEN 2 AND 4', 'mask_bbox_area_ratio_mid')}, {_W("centred AND asset_type <> 'drone'", 'center_heuristic_proposal')},
  {_W("starts_with(proposal, 'yolo') AND conf < 0.25 AND asset_type <> 'drone'", 'low_yolo_confidence')}, {_W("contains(selection, 'inverse')", 'inverse_mask_used')},
  {_W('comps >= 4 AND largest < 0.70', 'alpha_multiple_components')}, {_W('border > 0.45 AND alpha_area > 0.40', 'alpha_border_contact')},
  CASE asset_type WHEN 'drone' THEN nullif(concat_ws(';', {_W('weak', 'drone_heuristic_proposal')}, {_W('border > 0.35', 'drone_edge_halo')}), '')
    WHEN 'bird' THEN nullif(concat_ws(';', {_W('inverted', 'bird_mask_inverted')}, {_W('comps >= 3 AND largest < 0.75', 'bird_disconnected_alpha')}, {_W('border > 0.30', 'bird_edge_artifacts')}), '')
    ELSE nullif(concat_ws(';', {_W('inverted', 'airplane_mask_inverted')}, {_W('border > 0.55 AND alpha_area > 0.35', 'airplane_strong_crop')}), '') END) AS maybe FROM x)
SELECT id, no, CASE WHEN no <> '' THEN 'reject' WHEN maybe <> '' THEN 'review' ELSE 'accept' END AS auto_label, CASE WHEN no <> '' THEN no WHEN maybe <> '' THEN maybe ELSE 'auto_accept' END AS auto_reasons FROM y"""
