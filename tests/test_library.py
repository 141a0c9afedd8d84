import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.functions import geometry as geo
from lodestack.functions import pixels
from lodestack.functions import scalars as sca
from lodestack.operators import dedup, matching, metrics, models, selection
from lodestack.plans import rules
from lodestack.sources import tables

SCENE = "u double, l double, cy double, bottom double, area_ratio double, max_dim_ratio double, cls string"


@pytest.mark.parametrize(
    "row, want",
    [
        ((0.08, 0.04, 0.5, 0.5, 0.01, 0.1), ("reject", "likely_top_down_or_non_sky", "indoor")),
        ((0.11, 0.5, 0.72, 0.5, 0.10, 0.1), ("reject", "likely_product_or_ground_closeup", "product_photo")),
        ((0.11, 0.5, 0.72, 0.5, 0.01, 0.1), ("reject", "likely_top_down_or_non_sky", "top_down")),
        ((0.28, 0.1, 0.72, 0.5, 0.01, 0.1), ("accept", "flying_sky_candidate", "ground_to_air")),
        ((0.28, 0.1, 0.72, 0.5, 0.10, 0.1), ("review", "large_but_sky_candidate", "ground_to_air")),
        ((0.20, 0.1, 0.8, 0.5, 0.01, 0.1), ("accept", "horizon_candidate", "horizon_side_view")),
        ((0.15, 0.3, 0.5, 0.5, 0.06, 0.1), ("review", "large_object_review", "unknown")),
        ((0.15, 0.3, 0.5, 0.5, 0.05, 0.1), ("review", "horizon_candidate", "unknown")),
    ],
)
def test_scene_rules_at_their_thresholds(spark, row, want):
    out = rules.SCENE.apply(spark.createDataFrame([(*row, "kite")], SCENE)).first()
    assert (out.disposition, out.reason, out.viewpoint) == want


def test_mask_quality_boundaries(spark):
    rows = [(0, 0.0, 0, True), (9, 0.0099, 0, True), (9, 0.01, 0, True), (9, 0.05, 0, True), (9, 0.95, 2, True), (9, 0.96, 3, True), (9, 0.5, 0, False)]
    out = rules.mask_quality(spark.createDataFrame(rows, "area int, r double, k int, sam2 boolean")).collect()
    assert [r.label for r in out] == ["reject", "reject", "review", "accept", "review", "reject", "review"]
    assert [r.score for r in out] == [0.0, 0.0, 0.75, 1.0, 0.56, 0.0, 1.0]


def test_matching_ties_and_images_without_predictions(spark):
    box = "image_id int, gi int, x int, y int, w int, h int"
    truth = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 10, 10), (2, 0, 0, 0, 10, 10)], box)
    preds = spark.createDataFrame([(1, 0, "m", 0.9, 5, 0, 10, 10), (1, 1, "m", 0.8, 0, 0, 10, 10)], "image_id int, pi int, model_name string, confidence double, x int, y int, w int, h int")
    got = {(r.gi, r.pi) for r in matching.match_greedy(truth, preds, [0.25]).collect()}
    assert got == {(0, 1), (1, 0)}
    meta = spark.createDataFrame([(1, True), (2, True), (3, False)], "image_id int, target_present boolean")
    facts = matching.image_facts(meta, truth, preds, ["m"], [0.25], matching.match_greedy(truth, preds, [0.25]))
    by = {r.image_id: r for r in facts.collect()}
    assert (by[1].tp, by[1].fn, by[1].fp) == (2, 0, 0) and (by[2].missed, by[2].fn) == (1, 1) and by[3].false_positive_image == 0


def test_corrected_denominators_reproduce_published_rows(spark):
    rows = [("positive", 131, 180, 143, 0.6771), ("positive", 123, 180, 143, 0.0), ("mixed", 130, 180, 157, 0.0), ("hard_negative", 0, 180, 62, None)]
    df = spark.createDataFrame(rows, "kind string, tp long, metadata_total_images long, prediction_unique_images long, mean_best_iou double")
    out = metrics.correct_denominators(df).collect()
    assert [None if r.recall is None else round(r.recall, 4) for r in out] == [0.7278, 0.6833, 0.7222, None]
    assert round(out[3].false_positive_rate, 4) == 0.3444 and out[0].fn == 49


def test_split_is_whole_and_sized(spark):
    for n in (0, 1, 2, 7, 100):
        got = selection.stratified_split(spark.range(n).withColumn("s", F.lit("a")), "s", "id", 1).groupBy("split").count().collect()
        sizes = {r.split: r["count"] for r in got}
        assert sum(sizes.values()) == n and sizes.get("train", 0) == int(n * 0.7) and sizes.get("val", 0) == int(n * 0.15)


def test_first_fit_equals_the_sequential_walk(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(10)]
    hashes = [b ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5))) for b in base * 8] + [None]
    reps, want = [], {}
    for i, h in enumerate(hashes):
        hit = next((r for r in reps if h is not None and bin(hashes[r] ^ h).count("1") <= 4), None)
        if hit is None:
            want[i] = i
            if h is not None:
                reps.append(i)
        else:
            want[i] = hit
    df = spark.createDataFrame(list(enumerate(hashes)), "k int, h long")
    assert {r.k: r.representative for r in dedup.first_fit(df, "k", "h", 4).collect()} == want


def test_geometry_rounds_half_to_even(spark):
    r = spark.range(1).select(*geo.corners_to_box(F.lit(0.5), F.lit(1.5), F.lit(2.5), F.lit(1.6))).first()
    assert tuple(r) == (0, 2, 2, 1)
    r = spark.range(1).select(geo.iou((F.lit(0), F.lit(0), F.lit(2), F.lit(2)), (F.lit(2), F.lit(0), F.lit(2), F.lit(2))).alias("v")).first()
    assert r.v == 0.0


def test_labels_and_natural_order(spark):
    df = spark.createDataFrame([(" Accept ", "x"), ("nan", "Review"), ("", None)], "a string, b string")
    label, source = sca.qa_label("a", "b")
    assert [tuple(r) for r in df.select(label, source).collect()] == [("accept", "a"), ("review", "b"), (None, None)]
    names = spark.createDataFrame([("f10.png",), ("f9.png",), ("F2b.png",)], "n string").orderBy(sca.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["F2b.png", "f9.png", "f10.png"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "keep.txt").write_text("# ids\na1\n\nb2 7\n")
    assert [(r.entry, r.value) for r in tables.listed_lines(spark, str(tmp_path / "keep.txt")).collect()] == [("a1", None), ("b2", "7")]
    assert tables.class_names("nc: 2\nnames:\n  0: bird\n  1: kite\n") == {0: "bird", 1: "kite"} == tables.class_names("names: ['bird', 'kite']")
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a", "width": 4, "height": 3}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 1, 2, 3], "area": 6, "iscrowd": 0}], "categories": [{"id": 2, "name": "bird", "supercategory": "x"}]}')
    row = tables.coco_annotations(*tables.coco(spark, str(tmp_path / "c.json"))).first()
    assert (row.class_name, row.w, row.image_width) == ("bird", 2.0, 4)


def test_pixels(spark, tmp_path):
    image = np.zeros((20, 10, 3), np.uint8)
    image[:11] = (200, 210, 220)
    (tmp_path / "a.png").write_bytes(pixels.png(image))
    df = tables.images(spark, str(tmp_path))
    r = df.select(pixels.image_features("data", "height", "width", "nChannels").alias("f")).select("f.*").first()
    assert (r.u, r.l, r.tex) == (1.0, 0.0, 0.0) and len(r.phash) == 16
    assert (r.blue, r.cloud, r.green, r.dark, r.bri) == (1.0, 1.0, 0.0, 0.0, 115.5)
    mask = np.zeros((10, 10), bool)
    mask[1:6, 1:6] = mask[6:10, 6:10] = True
    assert pixels.components(mask) == [41] and pixels.mask_box(mask) == (1, 1, 9, 9)
    assert pixels.polygon_mask([0, 0, 4, 0, 4, 4, 0, 4], 6, 6).sum() == 16
    assert pixels.run_lengths_to_mask([2, 3, 4], 3, 3).sum() == 3


def test_canny_edges():
    step = np.zeros((8, 10), int)
    step[:, 5:] = 200
    assert np.nonzero(pixels.edges(step, 50, 140).all(0))[0].tolist() == [4] and pixels.edges(step, 50, 140).sum() == 8
    assert np.nonzero(pixels.edges(step.T, 50, 140).all(1))[0].tolist() == [4]
    assert not pixels.edges(np.full((5, 5), 9), 50, 140).any()
    # A weak edge stays only where it meets a strong one.
    weak = np.zeros((12, 10), int)
    weak[:, 5:] = 25
    assert not pixels.edges(weak, 50, 140).any()
    weak[:3, 5:] = 200
    assert pixels.edges(weak, 50, 140)[6:, 4].all()
    diagonal = np.add.outer(np.arange(12), np.arange(12))
    assert pixels.edges(np.where(diagonal > 11, 200, 0), 50, 140).any()


def test_edges_grow_like_a_walk_over_all_pixels():
    rng = np.random.default_rng(3)
    within = rng.random((15, 17)) < 0.5
    start = within & (rng.random((15, 17)) < 0.03)
    want = start.copy()
    for _ in range(within.size):
        p = np.pad(want, 1)
        want = within & np.any([p[i : i + 15, j : j + 17] for i in range(3) for j in range(3)], axis=0)
    assert (pixels.reached(start, within) == want).all()


def test_blur_and_resize():
    dot = np.zeros((7, 7, 3), np.uint8)
    dot[3, 3] = 160
    assert pixels.blurred(dot, 3)[2:5, 2:5, 0].tolist() == [[10, 20, 10], [20, 40, 20], [10, 20, 10]]
    assert (pixels.blurred(dot, 2) == pixels.blurred(dot, 3)).all() and pixels.blurred(dot, 0) is dot
    for size in (5, 7, 9, 31):
        assert (pixels.blurred(np.full((4, 1, 3), 77, np.uint8), size) == 77).all()
    board = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) * 10
    assert pixels.resized(board, 2)[..., 0].tolist() == [[25, 45], [105, 125]] and pixels.resized(board, 4) is board
    assert pixels.resized(board, 8)[::2, ::2, 0].tolist() == board[..., 0].tolist()
    assert pixels.resized(np.zeros((1, 9, 4), np.uint8), 3).shape == (1, 3, 4)
    with pytest.raises(ValueError):
        pixels.resized(board, 0)


def test_pasting_cuts_at_borders_and_alpha_is_cleaned():
    base = np.full((4, 4, 3), 100, np.uint8)
    paste = np.dstack([np.full((3, 3, 3), 201, np.uint8), np.full((3, 3), 128, np.uint8)])
    out = pixels.composite(base, paste, -2, 3)
    assert out[3, 0].tolist() == [150] * 3 and (out[:3] == 100).all() and (out[3, 1:] == 100).all()
    assert (pixels.composite(base, paste, 9, 0) == base).all()
    rgba = pixels.cropped(base, (1, 1, 2, 2))
    assert rgba.shape == (2, 2, 4) and (rgba[..., 3] == 255).all() and pixels.cropped(base, (9, 9, 2, 2)) is None
    assert not pixels.without_corner_colour(rgba)[..., 3].any() and (pixels.without_white(rgba, 101)[..., 3] == 255).all()
    cleaned, notes = pixels.clean_alpha(paste, 129, 0.5)
    assert not cleaned[..., 3].any() and notes == ["threshold<129_zeroed", "low_alpha_fraction=0.0000"] and (paste[..., 3] == 128).all()
    assert pixels.on_checkerboard(np.zeros((24, 24, 4), np.uint8))[[0, 0], [0, 12], 0].tolist() == [192, 240]


def test_mask_facts():
    mask = np.zeros((20, 20), bool)
    mask[5:15, 5:15] = True
    got = pixels.mask_facts(mask, (5, 5, 10, 10))
    assert (got["area"], got["r"], got["k"], got["centre"], got["expansion"], got["x"], got["h"]) == (100, 0.25, 0, 1.0, 1.0, 5, 10)
    none = pixels.mask_facts(np.zeros((4, 4), bool), (50, 50, 2, 2))
    assert none["area"] == 0 and none["centre"] == 0.0 and none["w"] == 0


def test_every_query_with_sql_has_a_name():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 80


def test_models_run_once_and_resume(spark):
    table = {1: [("drone", 0.1234567, 10.0, 20.0, 4.0, 6.0)], 2: [("bird", 0.01, 0.0, 0.0, 1.0, 1.0)]}

    def make():
        def run(batch):
            rows = [(i, "m", *p) for i in batch.image_id for p in table.get(i, [])]
            return pd.DataFrame(rows, columns=["image_id", "model_name", "pred_class_name", "confidence", "x1", "y1", "x2", "y2"])

        return run

    todo = models.unfinished(spark.createDataFrame([(1,), (2,), (3,)], "image_id long"), spark.createDataFrame([(3,)], "image_id long"), "image_id")
    raw = models.run_model(todo, make, models.PREDICTIONS)
    [r] = models.shaped(raw, 0.05, centred=True).collect()
    assert (r.image_id, r.confidence, r.x1, r.y1, r.x2, r.y2, r.width, r.height) == (1, 0.123457, 8.0, 17.0, 12.0, 23.0, 4.0, 6.0)
    assert models.run_model(todo.where("false"), make, models.PREDICTIONS).count() == 0
    full = models.with_fallback(todo, models.shaped(raw, 0.05), "image_id", {"pred_class_name": "none", "confidence": 0.0})
    assert sorted(tuple(x) for x in full.collect()) == [(1, "drone", 0.123457), (2, "none", 0.0)]


def test_every_image_gets_a_placement(spark):
    import hashlib
    import math

    from lodestack import registry

    d = "/root/testdata/sf0.001"
    images = registry.t(spark, d, "fx_meta").select("image_id", "drone_size_px", "gx", "gy").collect()
    got = {r.image_id: (r.attempt, r.px, r.py) for r in registry.queries()["placement_sampling"](spark, d).collect()}
    assert len(got) == len(images)
    for i, w, gx, gy in images:
        if None in (w, gx, gy):
            continue
        for attempt in range(1, 51):
            x, y = (int(hashlib.sha256(f"8|{i}|{attempt}|{axis}".encode()).hexdigest()[:8], 16) % n for axis, n in (("x", 561), ("y", 321)))
            both = max(0, min(x + w, gx + 60) - max(x, gx)) * max(0, min(y + w, gy + 60) - max(y, gy))
            if both / (w * w + 3600 - both) <= 0.05 and math.hypot(x + w / 2 - gx - 30, y + w / 2 - gy - 30) >= 20:
                break
        assert got[i] == (attempt, x, y)
