"""Golden rows of the rule cascades, at their thresholds; words are fixed values."""

import pytest

from lodestack.plans import rules

FEATURES = dict(u=0.5, l=0.1, f=0.4, blue=0.0, cloud=0.0, green=0.0, dark=0.0, tex=0.0, bri=120.0, width=640, height=480, cls="drone", clip_background=None, upper_tex=0.0)
COVERAGE = dict(bad=0.0, largest=0.0, person_sum=0.0, person_max=0.0, food_sum=0.0, indoor_max=0.0, vehicle_max=0.0, animal_top=0.0, sports_top=0.0)
FEATURE_DDL = (
    "u double, l double, f double, blue double, cloud double, green double, dark double, tex double, bri double, width int, height int, cls string, clip_background string, upper_tex double, "
    "bad double, largest double, person_sum double, person_max double, food_sum double, indoor_max double, vehicle_max double, animal_top double, sports_top double"
)


def features(spark, **given):
    row = FEATURES | COVERAGE | given
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in FEATURE_DDL.split(", "))], FEATURE_DDL)


@pytest.mark.parametrize("cls, view", [("bird", "bird_on_ground"), ("Drone", "drone_on_ground"), ("kite", "irrelevant"), (None, "irrelevant")])
def test_ground_closeups_keep_their_viewpoint(spark, cls, view):
    df = spark.createDataFrame([(0.17, 0.3, 0.5, 0.90, 0.01, 0.1, cls)], "u double, l double, cy double, bottom double, area_ratio double, max_dim_ratio double, cls string")
    out = rules.SCENE.apply(df).first()
    assert (out.disposition, out.reason, out.viewpoint) == ("reject", "likely_product_or_ground_closeup", view)


@pytest.mark.parametrize(
    "given, want",
    [
        (dict(cloud=0.18), ("approved_daytime", "cloudy_sky", "strong_heuristic_accept")),
        (dict(green=0.16, clip_background="sky_with_trees"), ("approved_daytime", "sky_with_natural_landscape", "strong_heuristic_accept")),
        (dict(green=0.16, clip_background="sky_with_buildings"), ("approved_daytime", "sky_with_built_environment", "strong_heuristic_compatible_clip")),
        (dict(blue=0.12, clip_background="review_ambiguous"), ("approved_daytime", "clear_upper_sky", "default_heuristic_v1")),
        (dict(clip_background="night_low_light"), ("holdout_night", "night_low_light", "night_low_light_holdout")),
        (dict(f=0.01, bri=5.0), ("reject", "reject_irrelevant", "unusable_dark_or_no_scene")),
        (dict(u=0.13, f=0.2), ("review", "review_ambiguous", "ambiguous_weak_signals")),
        (dict(u=0.10, f=0.2, tex=150.0), ("reject", "reject_irrelevant", "heuristic_reject_no_useful_sky")),
    ],
)
def test_first_version_splits(spark, given, want):
    out = rules.BACKGROUND_V1.apply(rules.BACKGROUND.apply(features(spark, **given))).first()
    assert (out.split, out.category, out.merge_reason) == want


@pytest.mark.parametrize(
    "given, want",
    [
        (dict(person_sum=0.08), ("reject", "person_dominated")),
        (dict(person_max=0.06), ("reject", "person_closeup")),
        (dict(indoor_max=0.06), ("reject", "indoor_object_dominated")),
        (dict(vehicle_max=0.22), ("reject", "vehicle_dominated")),
        (dict(animal_top=0.10), ("reject", "animal_dominated")),
        (dict(sports_top=0.12), ("reject", "sports_closeup_dominated")),
        (dict(bad=0.26), ("reject", "bad_category_area_high")),
        (dict(bad=0.19), ("review", "bad_category_area_borderline")),
        (dict(largest=0.36), ("review", "object_dominated_large_bbox")),
        (dict(largest=0.36, u=0.44), ("reject", "object_dominated_large_bbox")),
        (dict(indoor_max=0.04), ("reject", "likely_indoor_scene")),
        (dict(u=0.24, f=0.2), ("reject", "insufficient_upper_sky")),
        (dict(u=0.44, blue=0.12), ("review", "below_upper_sky_clear_upper_sky")),
        (dict(u=0.34, cloud=0.18), ("review", "below_upper_sky_cloudy_sky")),
        (dict(u=0.45, blue=0.12), ("accept", "clean_blue_sky_low_texture")),
        (dict(u=0.30, f=0.4, green=0.16), ("accept", "sky_with_trees_lower")),
    ],
)
def test_strict_backgrounds(spark, given, want):
    out = rules.COCO_STRICT.apply(rules.BACKGROUND.apply(features(spark, **given))).first()
    assert (out.decision, out.why) == want


@pytest.mark.parametrize("given, want", [(dict(animal_top=0.16), ("reject", "animal_closeup")), (dict(u=0.11, f=0.2, green=0.06, tex=130.0), ("reject", "insufficient_sky")), (dict(cloud=0.18), ("accept", "cloudy_upper_sky"))])
def test_permissive_backgrounds(spark, given, want):
    out = rules.COCO_PERMISSIVE.apply(rules.BACKGROUND.apply(features(spark, **given))).first()
    assert (out.decision, out.why) == want


def test_overlay_keeps_the_category(spark):
    def said(**given):
        r = rules.overlay(rules.BACKGROUND.apply(features(spark, **given))).first()
        return r.qa_status, r.qa_reasons, r.background_category

    assert said(cloud=0.18) == ("accept", "cloudy_upper_sky", "cloudy_sky")
    assert said(cloud=0.18, bri=39.0, f=0.04) == ("review", "cloudy_upper_sky;dark_scene", "low_sky_or_contextual")
    assert said(u=0.17, f=0.1) == ("review", "horizon_structure;low_upper_sky_ratio", "low_sky_or_contextual")
    assert said(u=0.24, green=0.29) == ("reject", "sky_with_trees_lower;forest_or_ground_dominant", "reject")
    assert said(u=0.02, f=0.01) == ("reject", "no_sky", "reject")


HARD = "cls string, missing boolean, a double, m int, n int, cy double, aspect double, u double, f double"


@pytest.mark.parametrize(
    "row, want",
    [
        (("bird", True, 0.1, 50, 1, 0.5, 1.0, 0.3, 0.3), ("reject", "image_missing", 0)),
        (("bird", False, 0.1, 19, 1, 0.5, 1.0, 0.3, 0.3), ("review", "object_tiny_review", 35)),
        (("bird", False, 0.41, 50, 1, 0.5, 1.0, 0.3, 0.3), ("review", "closeup_large_area_review", 35)),
        (("bird", False, 0.26, 50, 1, 0.9, 1.0, 0.3, 0.3), ("review", "bird_closeup_review", 40)),
        (("bird", False, 0.13, 50, 1, 0.9, 1.0, 0.3, 0.3), ("review", "bird_large_single_review", 40)),
        (("bird", False, 0.13, 50, 1, 0.5, 1.0, 0.3, 0.3), ("approved", "sky_boost_approved", 80)),
        (("bird", False, 0.1, 50, 2, 0.5, 1.0, None, None), ("approved", "bird_multi_object_sky", 100)),
        (("bird", False, 0.1, 50, 1, 0.75, 1.0, 0.3, 0.3), ("review", "uncertain_review", 25)),
        (("airplane", False, 0.25, 50, 1, 0.9, 1.0, 0.15, 0.15), ("review", "airplane_closeup_review", 40)),
        (("airplane", False, 0.1, 451, 1, 0.72, 1.0, 0.15, 0.15), ("review", "airplane_large_ground_review", 40)),
        (("airplane", False, 0.1, 500, 1, 0.5, 1.21, 0.15, 0.15), ("approved", "airplane_wide_outdoor", 85)),
        (("airplane", False, 0.1, 501, 1, 0.5, 1.21, 0.15, 0.15), ("approved", "airplane_outdoor_candidate", 70)),
        (("kite", False, 0.30, 50, 1, 0.5, 1.0, 0.15, 0.15), ("review", "kite_closeup_review", 40)),
        (("kite", False, 0.15, 50, 1, 0.9, 1.0, 0.15, 0.15), ("approved", "kite_small_outdoor", 75)),
        (("kite", False, 0.20, 50, 1, 0.9, 1.0, 0.05, 0.05), ("review", "indoor_no_sky_review", 30)),
    ],
)
def test_hard_negatives(spark, row, want):
    out = rules.HARD_NEGATIVE.apply(rules.HARD_NEGATIVE_BASE.apply(spark.createDataFrame([row], HARD))).withColumn("p", rules.priority("reason", rules.HARD_PRIORITY, 20)).first()
    assert (out.status, out.reason, out.p) == want


@pytest.mark.parametrize(
    "row, want",
    [
        (("bird", "reject", 0, 0.5, 1.2, 1.0), ("reject", "technical_qa_reject", 0)),
        (("bird", "review", 0, 0.5, 1.15, 1.0), ("review", "bird_flying_shape_technical_review", 65)),
        (("bird", "accept", 0, 0.5, 1.0, 1.0), ("review", "bird_ambiguous_shape", 50)),
        (("airplane", "accept", 2, 0.76, 0.9, 1.6), ("reject", "airplane_extreme_partial_crop", 0)),
        (("airplane", "accept", 1, 0.75, 1.5, 1.0), ("approved", "airplane_wide_full_like", 100)),
        (("airplane", "accept", 1, 0.5, 1.2, 1.0), ("review", "airplane_ambiguous", 15)),
        (("kite", "accept", 2, 0.5, 1.0, 1.0), ("review", "kite_border_touch_review", 60)),
        (("kite", "accept", 1, 0.85, 1.0, 1.0), ("approved", "kite_ok", 100)),
        (("balloon", "accept", 1, 0.5, 1.0, 1.0), ("reject", "unknown_class", 0)),
    ],
)
def test_distractors(spark, row, want):
    df = spark.createDataFrame([row], "cls string, label string, k int, r double, ca double, ba double")
    out = rules.DISTRACTOR.apply(df).withColumn("p", rules.priority("reason", rules.DISTRACTOR_PRIORITY, 0)).first()
    assert (out.status, out.reason, out.p) == want


def test_segment_quality(spark):
    rows = [(0, 0, 0.0, 0), (100, 0, 0.0, 0), (100, 3, 0.03, 0), (100, 3, 0.02, 2), (100, 90, 0.86, 0), (100, 96, 0.96, 1), (100, 50, 0.5, 3), (100, 50, 0.85, 1)]
    out = rules.segment_quality(spark.createDataFrame(rows, "crop_area int, area int, r double, k int")).collect()
    assert [(r.label, r.reasons) for r in out] == [
        ("reject", "invalid_crop"),
        ("reject", "empty_mask"),
        ("review", "mask_too_small"),
        ("review", "mask_too_small;mask_small_review;mask_touches_two_borders"),
        ("review", "mask_too_large_review"),
        ("reject", "likely_background_blob"),
        ("reject", "mask_touches_many_borders"),
        ("accept", ""),
    ]


ASSET = dict(failed=False, missing=False, quality_label="accept", label="accept", r=0.3, br=0.1, bbox_ratio=1.0, review_text="", selection="", alpha_error="", alpha_area=0.3, rectangle=0.0, border=0.1, comps=1, largest=1.0, asset_type="drone", proposal="manual", conf=0.9, inverted=False)
ASSET_DDL = "failed boolean, missing boolean, quality_label string, label string, r double, br double, bbox_ratio double, review_text string, selection string, alpha_error string, alpha_area double, rectangle double, border double, comps int, largest double, asset_type string, proposal string, conf double, inverted boolean"


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, ("accept", "auto_accept")),
        (dict(failed=True, missing=True), ("reject", "extraction_failed;missing_asset_file")),
        (dict(quality_label=" Reject", label="reject"), ("reject", "quality_label_reject;mask_quality_label_reject")),
        (dict(review_text="mask_too_large_review"), ("reject", "mask_review_hard_failure")),
        (dict(selection="NO_OBJECT found"), ("reject", "mask_review_hard_failure")),
        (dict(alpha_error="empty_image", alpha_area=None), ("reject", "alpha_analysis_error:empty_image")),
        (dict(alpha_area=None), ("reject", "alpha_area_tiny")),
        (dict(rectangle=0.66, border=0.8, alpha_area=0.8), ("reject", "opaque_background_rectangle;drone_background_residue")),
        (dict(border=0.73, alpha_area=0.71, asset_type="bird"), ("reject", "alpha_border_background_blob")),
        (dict(comps=8, largest=0.44, asset_type="kite"), ("reject", "alpha_many_fragments")),
        (dict(r=0.56, br=0.51), ("reject", "drone_large_background_patch")),
        (dict(asset_type="bird", r=0.63, br=0.56), ("reject", "bird_large_sky_chunk")),
        (dict(asset_type="airplane", alpha_area=0.014), ("reject", "airplane_mostly_missing")),
        (dict(label="review", inverted=True, asset_type="bird"), ("review", "mask_quality_label_review;mask_inverted;bird_mask_inverted")),
        (dict(selection="used_inverse_mask"), ("review", "inverse_mask_used")),
        (dict(proposal="center_heuristic"), ("review", "drone_heuristic_proposal")),
        (dict(asset_type="bird", proposal="yolo_bird", conf=None), ("review", "low_yolo_confidence")),
        (dict(asset_type="airplane", border=0.56, alpha_area=0.41), ("review", "alpha_border_contact;airplane_strong_crop")),
        (dict(comps=4, largest=0.69), ("review", "alpha_multiple_components")),
    ],
)
def test_assets(spark, given, want):
    row = ASSET | given
    out = rules.asset_quality(spark.createDataFrame([tuple(row[c.split()[0]] for c in ASSET_DDL.split(", "))], ASSET_DDL)).first()
    assert (out.auto_label, out.auto_reasons) == want


def test_triage_and_manifest(spark):
    rows = [(" Reject", "large"), ("drop", "small"), ("reject", "none"), ("reject", "huge"), ("maybe", None), ("Candidate", "x"), ("error", "large"), ("what", "large"), (None, None)]
    out = rules.vision_triage(spark.createDataFrame(rows, "decision string, sky string")).collect()
    assert [(r.decision, r.sky, r.corrected, r.manifest_decision) for r in out] == [
        ("reject", "large", "accept_candidate", "accept"),
        ("reject", "small", "review", "accept"),
        ("reject", "none", "reject", "reject"),
        ("reject", "", "reject", "reject"),
        ("review", "", "review", "accept"),
        ("accept_candidate", "", "accept_candidate", "accept"),
        ("error", "large", "error", ""),
        ("", "large", "", ""),
        ("", "", "", ""),
    ]


def test_mask_verdict(spark):
    rows = [(0.61, False, 0.9, "accept"), (0.5, True, 0.1, "accept"), (0.5, False, 0.34, "accept"), (0.5, False, 0.35, "accept")]
    out = rules.mask_verdict(spark.createDataFrame(rows, "r double, blob boolean, score double, label string")).collect()
    assert [(r.verdict, r.verdict_reason) for r in out] == [("reject", "rejected_background_area"), ("reject", None), ("review", "low_mask_score"), ("accept", None)]


def test_technical_candidates(spark):
    rows = [(1, "coco_segmentation_mask", "True", False, 5, "Accept"), (2, "box", "true", False, 5, "accept"), (3, "coco_segmentation_mask", "0", False, 5, "accept"), (4, "coco_segmentation_mask", "1", False, 0, "review"), (5, "coco_segmentation_mask", "yes", True, 5, "review"), (6, "coco_segmentation_mask", "yes", False, 5, None)]
    df = spark.createDataFrame(rows, "id int, extraction_method string, has_alpha string, extraction_failed boolean, mask_area_px int, mask_quality_label string")
    assert [r.id for r in rules.technical_candidates(df).collect()] == [1]
