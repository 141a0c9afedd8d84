"""The rule cascades of curation: scenes, backgrounds, annotations, hard negatives, distractors, masks, assets.

Column names: u, l, f are the shares of sky in the upper part, the lower part and the whole image; blue, cloud, green,
dark, tex, bri are the other background features; cy and bottom are a box's centre and lower edge; r is a mask's share
of its crop, k its number of touched borders, ca and ba the aspect ratios of crop and box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .cascade import Cascade, q, rule

SCENE = Cascade(
    outputs=("disposition", "reason", "viewpoint"),
    terms={
        "large_": "area_ratio >= 0.10 OR max_dim_ratio >= 0.28",
        "low_": "cy >= 0.72",
        "ground_": "bottom >= 0.90",
        "horizon_": "u >= 0.20 AND u > l + 0.05",
        "flying_": "u >= 0.28 AND cy <= 0.72",
    },
    rules=(
        rule("(u + l) / 2 <= 0.06 AND u <= 0.08", "reject", "likely_top_down_or_non_sky", "indoor"),
        rule("large_ AND u < 0.12 AND (low_ OR ground_)", "reject", "likely_product_or_ground_closeup", "product_photo"),
        rule("u < 0.12 AND low_ AND NOT horizon_", "reject", "likely_top_down_or_non_sky", "top_down"),
        ("ground_ AND u < 0.18", *q("reject", "likely_product_or_ground_closeup"), "CASE lower(cls) WHEN 'bird' THEN 'bird_on_ground' WHEN 'drone' THEN 'drone_on_ground' ELSE 'irrelevant' END"),
        rule("flying_ AND large_", "review", "large_but_sky_candidate", "ground_to_air"),
        rule("flying_", "accept", "flying_sky_candidate", "ground_to_air"),
        rule("horizon_ AND u >= 0.18 AND large_", "review", "large_but_sky_candidate", "horizon_side_view"),
        rule("horizon_ AND u >= 0.18", "accept", "horizon_candidate", "horizon_side_view"),
        rule("large_ AND u >= 0.18", "review", "large_but_sky_candidate", "horizon_side_view"),
        rule("large_", "review", "large_object_review", "unknown"),
        rule("u >= 0.18", "review", "horizon_candidate", "horizon_side_view"),
        rule("area_ratio > 0.05", "review", "large_object_review", "unknown"),
    ),
    default=q("review", "horizon_candidate", "unknown"),
)

_CLIP = {
    "good_": "coalesce(clip_scene IN ('ground_to_air', 'horizon_side_view'), FALSE)",
    "bad_": "coalesce(clip_scene IN ('top_down', 'drone_on_ground', 'product_photo', 'indoor', 'irrelevant'), FALSE)",
    "strong_bad_": "coalesce(clip_scene IN ('top_down', 'drone_on_ground', 'product_photo', 'indoor'), FALSE)",
    "weak_": "u < 0.18",
    "close_": "margin < 0.05",
}

#: Heuristic and CLIP scene labels, for asset extraction.  Needs SCENE's outputs, clip_scene and margin.
SCENE_ASSET = Cascade(
    outputs=("final_disposition", "final_reason"),
    terms=_CLIP,
    rules=(
        ("clip_scene IS NULL", "disposition", "'heuristic_only'"),
        rule("disposition = 'reject'", "reject", "heuristic_hard_reject"),
        rule("bad_ AND weak_ AND cy >= 0.72", "reject", "clip_bad_scene_cues_reject"),
        rule("reason IN ('flying_sky_candidate', 'horizon_candidate') AND strong_bad_", "review", "strong_heuristic_clip_bad_review"),
        rule("reason IN ('flying_sky_candidate', 'horizon_candidate')", "accept", "strong_heuristic_preserved_accept"),
        rule("reason = 'large_but_sky_candidate' AND good_", "accept", "large_sky_clip_good_accept"),
        rule("reason = 'large_but_sky_candidate' AND (clip_scene = 'ambiguous' OR close_)", "review", "large_sky_clip_ambiguous_review"),
        rule("reason = 'large_but_sky_candidate' AND bad_ AND weak_", "reject", "large_sky_clip_bad_weak_sky_reject"),
        rule("reason = 'large_but_sky_candidate'", "review", "large_sky_default_review"),
        rule("reason = 'large_object_review' AND good_", "accept", "large_object_clip_good_accept"),
        rule("reason = 'large_object_review' AND bad_ AND weak_", "reject", "large_object_clip_bad_weak_sky_reject"),
    ),
    default=q("review", "large_object_default_review"),
)

#: The stricter policy for real evaluation images.
SCENE_EVAL = Cascade(
    outputs=("final_disposition", "final_reason"),
    terms=_CLIP
    | {
        "large_": "area_ratio >= 0.10 OR max_dim_ratio >= 0.28",
        "c_": "CASE WHEN good_ THEN 'accept' WHEN bad_ THEN 'reject' ELSE 'review' END",
        "base_": "CASE WHEN close_ THEN 'review' WHEN disposition = c_ THEN disposition ELSE 'review' END",
    },
    rules=(
        ("clip_scene IS NULL", "disposition", "'heuristic_only'"),
        rule("disposition = 'reject'", "reject", "heuristic_hard_reject"),
        rule("large_ AND bad_ AND weak_", "reject", "large_bbox_clip_bad_scene_reject"),
        rule("large_ AND good_ AND disposition = 'accept'", "accept", "large_bbox_clip_good_keep"),
        rule("large_ AND base_ = 'accept'", "review", "large_bbox_real_eval_review"),
        rule("large_ AND good_ AND base_ = 'reject'", "review", "large_bbox_clip_good_scene_review"),
        rule("close_", "review", "clip_low_margin_review"),
        ("disposition = c_", "disposition", "concat('heuristic_clip_agree_', disposition)"),
    ),
    default=q("review", "heuristic_clip_disagree_review"),
)

BACKGROUND = Cascade(
    outputs=("type", "status", "reason"),
    terms={"hz_": "u > greatest(0, 2 * f - u) + 0.06"},
    rules=(
        rule("width < 64 OR height < 64", "reject", "reject", "image_too_small"),
        rule("bri < 55 AND f >= 0.05 AND (dark > 0.01 OR tex > 80)", "review", "review", "night_low_light_candidate"),
        rule("f < 0.06 AND u < 0.08", "reject", "reject", "no_sky"),
        rule("u < 0.08 AND f < 0.10", "reject", "reject", "no_sky_indoor_or_closeup"),
        rule("u < 0.10 AND tex < 120", "reject", "reject", "indoor_low_sky"),
        rule("u < 0.12 AND NOT hz_ AND green < 0.05", "reject", "reject", "closeup_or_mostly_ground"),
        rule("u >= 0.28 AND cloud >= 0.18", "cloudy_sky", "accept", "cloudy_upper_sky"),
        rule("u >= 0.22 AND green >= 0.16", "trees_sky", "accept", "sky_with_trees_lower"),
        rule("u >= 0.22 AND dark >= 0.025 AND green < 0.14 AND tex >= 150", "urban_skyline", "accept", "sky_with_buildings_lower"),
        rule("u >= 0.35 AND blue >= 0.12 AND green < 0.12 AND dark < 0.03 AND cloud < 0.35 AND tex < 250", "clean_sky", "accept", "clean_blue_sky_low_texture"),
        rule("u >= 0.38 AND cloud < 0.30 AND green < 0.12 AND dark < 0.03", "clean_sky", "accept", "clean_upper_sky_low_texture"),
        rule("hz_ AND u >= 0.16 AND u < 0.38", "horizon", "accept", "horizon_structure"),
        rule("u >= 0.28 AND cloud >= 0.12", "cloudy_sky", "review", "uncertain_cloudy_sky"),
        rule("u >= 0.28 AND green >= 0.10", "trees_sky", "review", "uncertain_trees_sky"),
        rule("u >= 0.28 AND dark >= 0.02", "urban_skyline", "review", "uncertain_urban_skyline"),
        rule("u >= 0.28", "clean_sky", "review", "uncertain_clean_sky"),
        rule("u >= 0.14 AND hz_", "horizon", "review", "uncertain_horizon"),
        rule("u >= 0.12", "review", "review", "uncertain_sky_scene"),
    ),
    default=q("reject", "reject", "insufficient_sky"),
)


#: What other relations call the kinds of backgrounds, and the first version's categories.
CANONICAL = {"trees_sky": "sky_with_trees", "urban_skyline": "sky_with_buildings", "review": "review_ambiguous", "reject": "reject_irrelevant"}
CATEGORY = {"clean_sky": "clear_upper_sky", "cloudy_sky": "cloudy_sky", "sky_with_trees": "sky_with_natural_landscape", "sky_with_buildings": "sky_with_built_environment"}


def _arms(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())


def _v1(label: str) -> str:
    """The first-version category of a background label; horizons are absorbed by what they show."""
    return f"{_arms(label, CATEGORY)} WHEN 'horizon' THEN {ABSORBED} END"


ABSORBED = "CASE WHEN cloud >= 0.14 AND u >= 0.18 THEN 'cloudy_sky' WHEN green >= 0.10 THEN 'sky_with_natural_landscape' WHEN dark >= 0.018 OR tex >= 180 THEN 'sky_with_built_environment' WHEN u >= 0.28 THEN 'clear_upper_sky' END"
_DAY = "('clean_sky', 'cloudy_sky', 'sky_with_trees', 'sky_with_buildings', 'horizon')"

#: Heuristic and CLIP backgrounds merged to the first version's splits.  Needs BACKGROUND's outputs and clip_background.
BACKGROUND_V1 = Cascade(
    outputs=("split", "category", "merge_reason"),
    terms={
        "kind_": f"{_arms('type', CANONICAL)} ELSE type END",
        "day_h_": f"kind_ IN {_DAY}",
        "day_c_": f"coalesce(clip_background IN {_DAY}, FALSE)",
        "hv_": _v1("kind_"),
        "cv_": _v1("clip_background"),
        "sh_": "status = 'accept' AND day_h_",
        "useful_": "u >= 0.15",
        "agrees_": "clip_background IS NULL OR (day_c_ AND (kind_ = clip_background OR kind_ = 'horizon' OR clip_background = 'horizon'))",
        "none_": ABSORBED,
        "weak_h_": "kind_ IN ('review_ambiguous', 'reject_irrelevant')",
    },
    rules=(
        rule("width = 0 OR height = 0 OR (f < 0.02 AND bri < 12) OR (status = 'reject' AND u < 0.08) OR (f < 0.05 AND u < 0.06)", "reject", "reject_irrelevant", "unusable_dark_or_no_scene"),
        rule(
            "coalesce(clip_background = 'night_low_light', FALSE) OR reason LIKE '%night_low_light%' OR (bri < 58 AND f >= 0.04 AND (dark > 0.008 OR tex > 70))",
            "holdout_night",
            "night_low_light",
            "night_low_light_holdout",
        ),
        ("sh_ AND hv_ IS NOT NULL AND agrees_", "'approved_daytime'", "hv_", "'strong_heuristic_accept'"),
        ("sh_ AND hv_ IS NOT NULL AND cv_ IS NOT NULL", "'approved_daytime'", "cv_", "'strong_heuristic_compatible_clip'"),
        ("day_h_ AND useful_ AND hv_ IS NOT NULL AND agrees_", "'approved_daytime'", "hv_", "'heuristic_useful_daytime'"),
        ("day_h_ AND useful_ AND hv_ IS NOT NULL AND cv_ IS NOT NULL", "'approved_daytime'", "cv_", "'heuristic_useful_compatible_clip'"),
        ("status = 'reject' AND u >= 0.22 AND day_c_ AND cv_ IS NOT NULL", "'approved_daytime'", "cv_", "'salvage_reject_heuristic_clip_daytime'"),
        ("status = 'reject' AND u >= 0.28 AND none_ IS NOT NULL", "'approved_daytime'", "none_", "'salvage_strong_sky_from_reject'"),
        ("day_c_ AND useful_ AND cv_ IS NOT NULL AND weak_h_", "'approved_daytime'", "cv_", "'clip_daytime_salvage'"),
        rule("status = 'reject' AND NOT useful_", "reject", "reject_irrelevant", "heuristic_reject_no_useful_sky"),
        rule("weak_h_ AND (clip_background IS NULL OR clip_background IN ('review_ambiguous', 'reject_irrelevant')) AND useful_", "review", "review_ambiguous", "borderline_useful_ambiguous"),
        rule("weak_h_ AND (clip_background IS NULL OR clip_background IN ('review_ambiguous', 'reject_irrelevant'))", "review", "review_ambiguous", "ambiguous_weak_signals"),
        rule("clip_background = 'reject_irrelevant' AND NOT useful_", "reject", "reject_irrelevant", "clip_reject_no_useful_sky"),
        ("hv_ IS NOT NULL AND useful_", "'approved_daytime'", "hv_", "'default_heuristic_v1'"),
    ),
    default=q("review", "review_ambiguous", "uncertain_merge"),
)

#: Rejects by what annotations cover; the strict and the permissive thresholds.  animal_top and sports_top are the greatest
#: sums of a single category of their group.
def coco_rejects(person: float, food: float, indoor: float, animal: float, strict: bool) -> tuple[tuple[str, ...], ...]:
    rules = [rule(f"person_sum >= {person}", "reject", "person_dominated")]
    if strict:
        rules.append(rule("person_max >= 0.06", "reject", "person_closeup"))
    rules += [rule(f"food_sum >= {food}", "reject", "food_dominated"), rule(f"indoor_max >= {indoor}", "reject", "indoor_object_dominated")]
    if strict:
        rules.append(rule("vehicle_max >= 0.22", "reject", "vehicle_dominated"))
    rules.append(rule(f"animal_top >= {animal}", "reject", "animal_dominated" if strict else "animal_closeup"))
    if strict:
        rules.append(rule("sports_top >= 0.12", "reject", "sports_closeup_dominated"))
    return tuple(rules)


_CONTEXT = "hz_ OR green >= 0.10 OR dark >= 0.02"
#: Needs BACKGROUND's outputs as well.
COCO_STRICT = Cascade(
    outputs=("decision", "why"),
    terms={"hz_": "u > greatest(0, 2 * f - u) + 0.06", "kind_": f"{_arms('type', CANONICAL)} ELSE type END", "v1_": _v1("kind_")},
    rules=(
        *coco_rejects(0.08, 0.10, 0.06, 0.10, True),
        rule("bad > 0.25", "reject", "bad_category_area_high"),
        rule("bad > 0.18", "review", "bad_category_area_borderline"),
        rule("largest > 0.35 AND u >= 0.45", "review", "object_dominated_large_bbox"),
        rule("largest > 0.35", "reject", "object_dominated_large_bbox"),
        rule("indoor_max >= 0.04 OR (u < 0.15 AND f < 0.12) OR (u < 0.20 AND indoor_max >= 0.02) OR (u < 0.12 AND tex < 120)", "reject", "likely_indoor_scene"),
        rule("u < 0.25", "reject", "insufficient_upper_sky"),
        ("status = 'reject'", "'reject'", "reason"),
        ("status = 'review' OR v1_ IS NULL", "'review'", "reason"),
        ("u < CASE v1_ WHEN 'clear_upper_sky' THEN 0.45 WHEN 'cloudy_sky' THEN 0.35 ELSE 0.20 END", "'review'", "concat('below_upper_sky_', v1_)"),
        rule(f"v1_ LIKE 'sky_with_%' AND NOT ({_CONTEXT})", "review", "no_outdoor_horizon_context"),
    ),
    default=("'accept'", "reason"),
)
COCO_PERMISSIVE = Cascade(
    outputs=("decision", "why"),
    terms={"kind_": f"{_arms('type', CANONICAL)} ELSE type END", "v1_": _v1("kind_")},
    rules=(
        *coco_rejects(0.12, 0.14, 0.10, 0.16, False),
        rule("u < 0.12 AND status <> 'reject'", "reject", "no_plausible_upper_sky"),
        ("status = 'accept' AND v1_ IS NULL", "'review'", "reason"),
    ),
    default=("status", "reason"),
)

_HARD_TERMS = {
    "outdoor_": "coalesce(u >= 0.18, FALSE) OR coalesce(f >= 0.22, FALSE)",
    "indoor_": "coalesce(u < 0.10 AND f < 0.10, FALSE)",
    "outdoor_ok_": "outdoor_ OR coalesce(NOT indoor_ AND u >= 0.14, FALSE)",
}
#: Hard negatives before the sky adjustment; ``stop_`` marks verdicts that it must not change.
HARD_NEGATIVE_BASE = Cascade(
    outputs=("base", "base_reason", "stop_"),
    terms=_HARD_TERMS,
    rules=(
        rule("missing", "reject", "image_missing", "y"),
        rule("m < 20", "review", "object_tiny_review", "y"),
        rule("a > 0.40", "review", "closeup_large_area_review", "y"),
        rule("indoor_ AND a > 0.30", "review", "indoor_no_sky_review", "y"),
        rule("cls = 'bird' AND indoor_ AND a > 0.35 AND n < 2", "reject", "clearly_unusable", "n"),
        rule("cls = 'bird' AND a >= 0.20", "review", "bird_closeup_review", "n"),
        rule("cls = 'bird' AND n = 1 AND (a >= 0.12 OR m > 280)", "review", "bird_large_single_review", "n"),
        rule("cls = 'bird' AND n >= 2 AND (outdoor_ok_ OR u IS NULL)", "approved", "bird_multi_object_sky", "n"),
        rule("cls = 'bird' AND outdoor_ok_ AND m >= 20 AND m <= 250 AND a < 0.20", "approved", "bird_distant_outdoor", "n"),
        rule("cls = 'airplane' AND a >= 0.25", "review", "airplane_closeup_review", "n"),
        rule("cls = 'airplane' AND m > 450 AND cy >= 0.72", "review", "airplane_large_ground_review", "n"),
        rule("cls = 'airplane' AND m >= 30 AND m <= 500 AND indoor_", "review", "indoor_no_sky_review", "n"),
        rule("cls = 'airplane' AND m >= 30 AND m <= 500 AND aspect > 1.2", "approved", "airplane_wide_outdoor", "n"),
        rule("cls = 'airplane' AND m >= 30 AND m <= 500", "approved", "airplane_distant_outdoor", "n"),
        rule("cls = 'airplane' AND m >= 30", "approved", "airplane_outdoor_candidate", "n"),
        rule("cls = 'kite' AND a >= 0.30", "review", "kite_closeup_review", "n"),
        rule("cls = 'kite' AND n >= 2 AND m >= 20", "approved", "kite_multi_object", "n"),
        rule("cls = 'kite' AND m >= 20 AND indoor_ AND a > 0.15", "review", "indoor_no_sky_review", "n"),
        rule("cls = 'kite' AND m >= 20 AND a < 0.15", "approved", "kite_outdoor_scene", "n"),
        rule("cls = 'kite' AND m >= 20", "approved", "kite_small_outdoor", "n"),
    ),
    default=q("review", "uncertain_review", "n"),
)
HARD_NEGATIVE = Cascade(
    outputs=("status", "reason"),
    terms=_HARD_TERMS
    | {
        "s_": "CASE WHEN stop_ = 'y' OR base = 'reject' THEN base WHEN indoor_ AND base = 'approved' THEN 'review' WHEN outdoor_ AND base = 'review' AND a < 0.25 AND cy < 0.80 THEN 'approved' ELSE base END",
        "r_": "CASE WHEN stop_ = 'y' OR base = 'reject' THEN base_reason WHEN indoor_ AND base = 'approved' THEN 'indoor_no_sky_review' WHEN outdoor_ AND base = 'review' AND a < 0.25 AND cy < 0.80 THEN 'sky_boost_approved' ELSE base_reason END",
    },
    rules=(("s_ = 'approved' AND cy >= 0.75 AND n < 2 AND cls <> 'kite'", "'review'", "'uncertain_review'"),),
    default=("s_", "r_"),
)

#: How much a reason counts when approved rows are chosen; others count 20.
HARD_PRIORITY = {
    "bird_multi_object_sky": 100,
    "bird_distant_outdoor": 95,
    "kite_multi_object": 95,
    "kite_outdoor_scene": 90,
    "airplane_distant_outdoor": 90,
    "airplane_wide_outdoor": 85,
    "sky_boost_approved": 80,
    "kite_small_outdoor": 75,
    "bird_outdoor_candidate": 70,
    "airplane_outdoor_candidate": 70,
    "bird_closeup_review": 40,
    "bird_large_single_review": 40,
    "airplane_closeup_review": 40,
    "airplane_large_ground_review": 40,
    "kite_closeup_review": 40,
    "object_tiny_review": 35,
    "closeup_large_area_review": 35,
    "indoor_no_sky_review": 30,
    "uncertain_review": 25,
    "image_missing": 0,
    "image_unreadable": 0,
    "clearly_unusable": 0,
}

DISTRACTOR = Cascade(
    outputs=("status", "reason"),
    terms={
        "fly_": "ca >= 1.15 OR ba >= 1.15",
        "vert_": "ca < 0.85 AND ba < 0.85",
        "flags_": "CASE WHEN k >= 2 THEN 1 ELSE 0 END + CASE WHEN r > 0.75 THEN 1 ELSE 0 END + CASE WHEN ca < 1 THEN 1 ELSE 0 END",
    },
    rules=(
        rule("cls IN ('bird', 'airplane') AND label = 'reject'", "reject", "technical_qa_reject"),
        rule("cls = 'bird' AND k >= 3", "reject", "mask_touches_many_borders"),
        rule("cls = 'bird' AND (r > 0.85 OR r < 0.02)", "reject", "extreme_mask_area_ratio"),
        rule("cls = 'bird' AND label = 'accept' AND fly_", "approved", "bird_flying_like_shape"),
        rule("cls = 'bird' AND label = 'accept' AND vert_", "review", "bird_vertical_portrait_like"),
        rule("cls = 'bird' AND label = 'accept'", "review", "bird_ambiguous_shape"),
        rule("cls = 'bird' AND fly_", "review", "bird_flying_shape_technical_review"),
        rule("cls = 'bird' AND vert_", "review", "bird_vertical_technical_review"),
        rule("cls = 'bird'", "review", "bird_technical_review"),
        rule("cls = 'airplane' AND k >= 2 AND r > 0.75 AND ca < 1", "reject", "airplane_extreme_partial_crop"),
        rule("cls = 'airplane' AND flags_ >= 2", "review", "airplane_likely_nose_tail_fragment"),
        rule("cls = 'airplane' AND (ca >= 1.5 OR ba >= 1.5) AND k <= 1 AND r <= 0.75 AND label = 'accept'", "approved", "airplane_wide_full_like"),
        rule("cls = 'airplane' AND (ca >= 1.5 OR ba >= 1.5) AND k <= 1 AND r <= 0.75", "review", "airplane_partial_but_wide"),
        rule("cls = 'airplane' AND flags_ >= 1", "review", "airplane_likely_nose_tail_fragment"),
        rule("cls = 'airplane' AND ca < 1", "review", "airplane_narrow_crop"),
        rule("cls = 'airplane'", "review", "airplane_ambiguous"),
        rule("cls = 'kite' AND (label = 'reject' OR r > 0.95 OR k >= 3)", "reject", "kite_extreme_failure"),
        rule("cls = 'kite' AND label = 'accept' AND r >= 0.03 AND r <= 0.85 AND k >= 2", "review", "kite_border_touch_review"),
        rule("cls = 'kite' AND label = 'accept' AND r >= 0.03 AND r <= 0.85", "approved", "kite_ok"),
        rule("cls = 'kite' AND (r < 0.03 OR k >= 2)", "review", "kite_small_or_fragment"),
        rule("cls = 'kite'", "review", "kite_technical_review"),
    ),
    default=q("reject", "unknown_class"),
)

#: The same for distractors; others count 0.
DISTRACTOR_PRIORITY = {
    "bird_flying_like_shape": 100,
    "airplane_wide_full_like": 100,
    "kite_ok": 100,
    "airplane_partial_but_wide": 70,
    "bird_flying_shape_technical_review": 65,
    "kite_border_touch_review": 60,
    "bird_ambiguous_shape": 50,
    "airplane_narrow_crop": 45,
    "bird_vertical_portrait_like": 40,
    "kite_small_or_fragment": 35,
    "airplane_likely_nose_tail_fragment": 30,
    "bird_vertical_technical_review": 25,
    "kite_technical_review": 20,
    "airplane_ambiguous": 15,
    "bird_technical_review": 10,
}


def priority(reason: str, table: dict[str, int], other: int) -> Column:
    """The priority of the reason in a column."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(reason)), F.lit(other)).cast("int")


#: Fixed value: how technical candidates for distractors were cut out.
EXTRACTION_METHOD = "coco_segmentation_mask"


def technical_candidates(df: DataFrame, labels: tuple[str, ...] = ("accept", "review")) -> DataFrame:
    """Rows fit for the semantic rules: cut out by segmentation, with alpha, not failed, not empty, and with one of the labels.

    Needs extraction_method, has_alpha, extraction_failed, mask_area_px and mask_quality_label; flags may be text.
    """
    yes = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "1", "yes"), F.lit(False))
    label = F.lower(F.col("mask_quality_label").cast("string")).isin(*labels)
    return df.where((F.col("extraction_method") == EXTRACTION_METHOD) & yes("has_alpha") & ~yes("extraction_failed") & (F.col("mask_area_px").cast("double") > 0) & label)


PLACES = Cascade(
    outputs=("status", "reason"),
    rules=(
        rule("least(width, height) < 512", "reject", "image_too_small"),
        rule("u < 0.10", "reject", "insufficient_upper_sky"),
        rule("u < CASE WHEN mapped = 'runway' THEN 0.15 ELSE 0.18 END", "review", "borderline_upper_sky"),
    ),
    default=q("accept", "ok"),
)


def reasons(*pairs: tuple[str, str]) -> Column:
    """All reasons whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for c, r in pairs])))


def reasons_sql(*pairs: tuple[str, str]) -> str:
    """The same as text joined by semicolons."""
    parts = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in pairs)
    return f"concat_ws(';', {parts})"


MASK_REASONS = (
    ("area = 0", "empty_mask"),
    ("area > 0 AND r < 0.01", "mask_too_small"),
    ("area > 0 AND r >= 0.01 AND r < 0.05", "mask_small_review"),
    ("r > 0.95", "likely_background_blob"),
    ("r <= 0.95 AND r > 0.80", "mask_too_large_review"),
    ("k >= 3", "mask_touches_many_borders"),
    ("k = 2", "mask_touches_two_borders"),
)
_THERE = "crop_area > 0 AND area > 0"
SEGMENT_REASONS = (
    ("crop_area = 0", "invalid_crop"),
    ("crop_area > 0 AND area = 0", "empty_mask"),
    (f"{_THERE} AND area < 4", "mask_too_small"),
    (f"{_THERE} AND r > 0.95", "likely_background_blob"),
    (f"{_THERE} AND r <= 0.95 AND r > 0.85", "mask_too_large_review"),
    (f"{_THERE} AND r < 0.03", "mask_small_review"),
    (f"{_THERE} AND k >= 3", "mask_touches_many_borders"),
    (f"{_THERE} AND k = 2", "mask_touches_two_borders"),
)


def mask_quality(df: DataFrame, sam2: str = "sam2") -> DataFrame:
    """``reasons`` (joined by semicolons), ``label`` and ``score`` of masks, from area, r, k."""
    found = reasons(*MASK_REASONS)
    bad = F.arrays_overlap(found, F.array(*[F.lit(x) for x in ("empty_mask", "mask_too_small", "likely_background_blob", "mask_touches_many_borders")]))
    label = F.when(bad, "reject").when(F.size(found) > 0, "review").when(F.col(sam2), "accept").otherwise("review")
    lost = F.when(F.col("r") < 0.05, 0.25).when(F.col("r") > 0.80, 0.20).otherwise(0.0) + F.when(F.col("r") > 0.95, 0.50).otherwise(0.0) + F.lit(0.12) * F.col("k")
    score = F.when((F.col("area") == 0) | (F.col("r") < 0.01), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - lost)), 3))
    return df.select(*[c for c in df.columns if c not in ("reasons", "label", "score")], F.array_join(found, ";").alias("reasons"), label.alias("label"), score.alias("score"))


def segment_quality(df: DataFrame) -> DataFrame:
    """``reasons`` and ``label`` of segmentation masks, from crop_area, area, r, k."""
    found = reasons(*SEGMENT_REASONS)
    bad = F.arrays_overlap(found, F.array(*[F.lit(x) for x in ("empty_mask", "invalid_crop", "likely_background_blob", "mask_touches_many_borders")]))
    label = F.when(bad, "reject").when(F.size(found) > 0, "review").otherwise("accept")
    return df.select(*[c for c in df.columns if c not in ("reasons", "label")], F.array_join(found, ";").alias("reasons"), label.alias("label"))


#: Words in the notes on a mask that rule an asset out.
HARD_FAILURES = ("likely_background_blob", "mask_too_large", "missing_proposal", "failed", "no_object")
_NOTES = "lower(concat(coalesce(review_text, ''), ' ', coalesce(selection, '')))"
_WEAK = "('center_heuristic', 'largest_detection_fallback')"
#: Reasons, in the order in which they are told.  Alpha reasons exclude each other.
ASSET_REJECT = (
    ("failed", "extraction_failed"),
    ("missing", "missing_asset_file"),
    ("lower(trim(quality_label)) = 'reject'", "quality_label_reject"),
    ("lower(trim(label)) = 'reject'", "mask_quality_label_reject"),
    ("r > 0.70", "mask_area_ratio_high"),
    ("br > 0.65", "mask_touches_border_high"),
    ("bbox_ratio > 4", "mask_bbox_area_ratio_high"),
    (" OR ".join(f"{_NOTES} LIKE '%{word}%'" for word in HARD_FAILURES), "mask_review_hard_failure"),
    ("alpha_error <> ''", "alpha_analysis_error:"),
    ("coalesce(alpha_error, '') = '' AND coalesce(alpha_area, 0) < 0.005", "alpha_area_tiny"),
    ("coalesce(alpha_error, '') = '' AND alpha_area >= 0.005 AND rectangle > 0.65", "opaque_background_rectangle"),
    ("coalesce(alpha_error, '') = '' AND alpha_area >= 0.005 AND coalesce(rectangle, 0) <= 0.65 AND border > 0.72 AND alpha_area > 0.70", "alpha_border_background_blob"),
    ("comps >= 8 AND coalesce(largest, 0) < 0.45", "alpha_many_fragments"),
    ("asset_type = 'drone' AND r > 0.55 AND br > 0.50", "drone_large_background_patch"),
    ("asset_type = 'drone' AND alpha_area > 0.65 AND border > 0.55", "drone_background_residue"),
    ("asset_type = 'drone' AND coalesce(largest, 0) < 0.35 AND comps > 3", "drone_broken_shape"),
    (f"asset_type = 'drone' AND proposal IN {_WEAK} AND r > 0.50", "drone_weak_proposal_large_mask"),
    ("asset_type = 'bird' AND coalesce(largest, 0) < 0.40 AND comps >= 5", "bird_fragmented"),
    ("asset_type = 'bird' AND r > 0.62 AND br > 0.55", "bird_large_sky_chunk"),
    ("asset_type = 'bird' AND coalesce(alpha_area, 0) < 0.02", "bird_mostly_missing"),
    ("asset_type = 'airplane' AND coalesce(alpha_area, 0) < 0.015", "airplane_mostly_missing"),
    ("asset_type = 'airplane' AND r > 0.75 AND br > 0.70", "airplane_huge_background_blob"),
    ("asset_type = 'airplane' AND rectangle > 0.75", "airplane_crop_failure"),
)
ASSET_REVIEW = (
    ("lower(trim(quality_label)) = 'review'", "quality_label_review"),
    ("lower(trim(label)) = 'review'", "mask_quality_label_review"),
    ("inverted", "mask_inverted"),
    ("r >= 0.45 AND r <= 0.70", "mask_area_ratio_mid"),
    ("br >= 0.35 AND br <= 0.65", "mask_touches_border_mid"),
    ("bbox_ratio >= 2 AND bbox_ratio <= 4", "mask_bbox_area_ratio_mid"),
    ("asset_type IN ('bird', 'airplane') AND proposal = 'center_heuristic'", "center_heuristic_proposal"),
    ("asset_type IN ('bird', 'airplane') AND proposal LIKE 'yolo%' AND coalesce(conf, 0) < 0.25", "low_yolo_confidence"),
    ("lower(selection) LIKE '%inverse%'", "inverse_mask_used"),
    ("comps >= 4 AND coalesce(largest, 0) < 0.70", "alpha_multiple_components"),
    ("border > 0.45 AND alpha_area > 0.40", "alpha_border_contact"),
    (f"asset_type = 'drone' AND proposal IN {_WEAK}", "drone_heuristic_proposal"),
    ("asset_type = 'drone' AND border > 0.35", "drone_edge_halo"),
    ("asset_type = 'bird' AND inverted", "bird_mask_inverted"),
    ("asset_type = 'bird' AND comps >= 3 AND coalesce(largest, 0) < 0.75", "bird_disconnected_alpha"),
    ("asset_type = 'bird' AND border > 0.30", "bird_edge_artifacts"),
    ("asset_type = 'airplane' AND inverted", "airplane_mask_inverted"),
    ("asset_type = 'airplane' AND border > 0.55 AND alpha_area > 0.35", "airplane_strong_crop"),
)


def asset_quality(df: DataFrame) -> DataFrame:
    """``auto_label`` and ``auto_reasons`` of cut-out assets: reasons to reject, else to review, else accepted.

    Needs failed, missing, quality_label, label (of the mask), review_text, selection, alpha_error, asset_type, proposal,
    inverted and the numbers r, br, bbox_ratio, alpha_area, rectangle, border, comps, largest, conf.  Missing numbers count 0,
    missing text is empty; labels are compared in lower case.
    """
    told = lambda c: F.when(c == "alpha_analysis_error:", F.concat(c, F.col("alpha_error"))).otherwise(c)
    known = df.withColumns({"no_": F.array_join(F.transform(reasons(*ASSET_REJECT), told), ";"), "maybe_": F.array_join(reasons(*ASSET_REVIEW), ";")})
    label = F.when(F.col("no_") != "", "reject").when(F.col("maybe_") != "", "review").otherwise("accept")
    why = F.when(F.col("no_") != "", F.col("no_")).when(F.col("maybe_") != "", F.col("maybe_")).otherwise("auto_accept")
    return known.withColumns({"auto_label": label, "auto_reasons": why}).drop("no_", "maybe_")


#: The conservative overlay on BACKGROUND: condition on the status so far, new status, reason, category.
OVERLAY = (
    ("u < 0.18 AND s <> 'reject'", "review", "low_upper_sky_ratio", "low_sky_or_contextual"),
    ("bri < 40 AND s = 'accept'", "review", "dark_scene", "low_sky_or_contextual"),
    ("upper_tex > 900 AND u < 0.30 AND s = 'accept'", "review", "upper_high_texture", "low_sky_or_contextual"),
    ("green > 0.28 AND u < 0.25 AND s <> 'reject'", "reject", "forest_or_ground_dominant", "reject"),
    ("dark > 0.06 AND u < 0.20 AND s <> 'reject'", "reject", "built_environment_low_sky", "reject"),
)
#: The category of a kind of background.
QA_CATEGORY = {
    "clean_sky": "clear_upper_sky",
    "cloudy_sky": "cloudy_sky",
    "trees_sky": "sky_with_natural_landscape",
    "urban_skyline": "sky_with_built_environment",
    "horizon": "sky_with_natural_landscape",
    "review": "low_sky_or_contextual",
    "reject": "reject",
}


def overlay(df: DataFrame) -> DataFrame:
    """``qa_status``, ``qa_reasons`` and ``background_category``: the overlay's steps in turn, each seeing the status that the last one left."""
    now = df.withColumn("s", F.col("status")).withColumn("why_", F.array("reason")).withColumn("kind_", F.expr(f"{_arms('type', QA_CATEGORY)} ELSE 'unknown' END"))
    for condition, status, why, category in OVERLAY:
        now = now.withColumn("hit_", F.coalesce(F.expr(condition), F.lit(False)))
        now = now.withColumns(
            {
                "s": F.when(F.col("hit_"), status).otherwise(F.col("s")),
                "why_": F.when(F.col("hit_"), F.array_append("why_", F.lit(why))).otherwise(F.col("why_")),
                "kind_": F.when(F.col("hit_"), category).otherwise(F.col("kind_")),
            }
        )
    kind = F.when(F.col("s") == "reject", "reject").otherwise(F.col("kind_"))
    return now.select(*df.columns, F.col("s").alias("qa_status"), F.array_join("why_", ";").alias("qa_reasons"), kind.alias("background_category"))


def vision_triage(df: DataFrame) -> DataFrame:
    """``decision`` and ``sky`` in standard words, ``corrected`` and ``manifest_decision``.

    A reject in spite of a large or medium sky becomes a candidate, one of a small sky a review; the manifest takes
    candidates and reviews in.
    """
    known = df.withColumns({"decision": scalars.triage(F.col("decision")), "sky": scalars.sky_region(F.col("sky"))})
    reject = F.col("decision") == "reject"
    corrected = F.when(reject & F.col("sky").isin("large", "medium"), "accept_candidate").when(reject & (F.col("sky") == "small"), "review").otherwise(F.col("decision"))
    manifest = F.when(F.col("corrected").isin("accept_candidate", "review"), "accept").when(F.col("corrected") == "reject", "reject").otherwise("")
    return known.withColumn("corrected", corrected).withColumn("manifest_decision", manifest)


def accepted(decision: str = "decision", vision: str = "vision_decision", values: tuple[str, ...] = ("accept", "accept_candidate")) -> Column:
    """Whether a reviewer or the triage takes a row in."""
    return scalars.decision(F.col(decision)).isin(*values) | scalars.triage(F.col(vision)).isin(*values)


def export_category() -> Column:
    """The corrected category, else the final one, else the mapped one."""
    return F.coalesce(scalars.first_of(F.col("corrected_category"), F.col("final_category"), F.col("mapped_background_type")), F.lit("uncategorized"))


def export_status(df: DataFrame, there: Column) -> DataFrame:
    """``export_category`` and ``export_status`` of manifest rows; ``there`` says whether the source exists."""
    status = F.when(~accepted(), "skipped_not_accepted").when(there, "exported").otherwise("missing_source")
    return df.withColumn("export_category", export_category()).withColumn("export_status", status)


def mask_candidate_score(df: DataFrame) -> DataFrame:
    """``score`` and ``may_invert`` of mask candidates, from area, r, k, expand, centre, inverted."""
    r, k, expand, centre = F.col("r"), F.col("k"), F.col("expand"), F.col("centre")
    score = (
        F.lit(1.0)
        - F.when(r > 0.60, 0.55).when(r > 0.45, 0.20).when(r < 0.02, 0.50).otherwise(0.0)
        - F.when(k >= 3, 0.35).when(k == 2, 0.12).otherwise(0.0)
        - F.when(expand > 2.5, 0.25).otherwise(0.0)
        + F.when(centre < 0.25, -0.30).otherwise(F.lit(0.15) * centre)
        + F.lit(0.10) * (F.lit(1.0) - F.abs(r - 0.25))
        - F.when(F.col("inverted"), 0.05).otherwise(0.0)
    )
    may = (F.col("area") > 0) & (r >= 0.02) & (r <= 0.60) & (k < 3) & (centre >= 0.35)
    return df.select("*", F.round(F.when(F.col("area") == 0, -1.0).otherwise(score), 6).alias("score"), may.alias("may_invert"))


def mask_verdict(df: DataFrame) -> DataFrame:
    """``verdict`` and ``verdict_reason`` of the chosen candidate, from r, blob, score and the label of ``mask_quality``."""
    verdict = F.when((F.col("r") > 0.60) | F.col("blob"), "reject").when(F.col("score") < 0.35, "review").otherwise(F.col("label"))
    reason = F.when(F.col("r") > 0.60, "rejected_background_area").when(~F.col("blob") & (F.col("score") < 0.35), "low_mask_score")
    return df.withColumn("verdict", verdict).withColumn("verdict_reason", reason)
