import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import geometry as geo
from lodestack.functions import pixels
from lodestack.functions import scalars as sca
from lodestack.operators import annotations, matching, packs, relations, selection
from lodestack.sources import config, tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_boxes_are_moved_in_and_judged_as_they_were(spark):
    box = lambda *v: tuple(F.lit(x) for x in v)
    size = F.lit(100), F.lit(50)
    assert one(spark, *geo.clip(box(-5, 3, 10, 10), *size)) == (0, 3, 10, 10)
    assert one(spark, *geo.clip(box(95, 49, 10, 10), *size)) == (95, 49, 5, 1)
    assert one(spark, *geo.clip(box(5, 5, -3, 4), *size)) == (5, 5, 0, 4)
    said = lambda *v: one(spark, geo.problem(box(*v), *size, 8))[0]
    assert [said(0, 0, 100, 50), said(-1, 0, 20, 20), said(81, 0, 20, 20), said(0, 0, 0, 9), said(0, 0, 7, 7)] == [None, "outside_image", "outside_image", "non_positive_size", "below_min_bbox_px"]
    assert one(spark, *geo.expand(box(10, 10, 5, 15), 0.1, *size)) == (10, 8, 5, 19)
    assert one(spark, *geo.expand(box(10, 10, 15, 25), 0.1, *size)) == (8, 8, 19, 29)


def test_placement_gives_way_to_all_places(spark):
    bounds = lambda w, h: one(spark, *geo.placement_bounds(F.lit(w), F.lit(h), F.lit(640), F.lit(480), (0.2, 0.8), (0.1, 0.55), 4))
    assert bounds(60, 60) == (98, 482, 18, 234)
    assert bounds(300, 480) == (4, 336, 4, 4)
    assert bounds(700, 200) == (4, 4, 4, 164)


def test_decisions(spark):
    df = spark.createDataFrame([(" Y ",), ("n",), ("NaN",), (None,), ("later",), ("Approved",)], "d string")
    assert [r[0] for r in df.select(sca.decision(F.col("d"))).collect()] == ["accept", "reject", "", "", "later", "accept"]
    rows = [("no", "keep"), ("yes", None), ("", "review"), ("maybe", "accept")]
    from lodestack.plans import rules

    assert [r[0] for r in spark.createDataFrame(rows, "decision string, vision_decision string").select(rules.accepted()).collect()] == [True, True, False, True]


def test_scalars(spark):
    df = spark.createDataFrame([(" Yes", "1.5", "Quad_copter", "a\\b/c.png"), ("off", "nan", "plane-x", "c.png"), (None, "x", "other", None)], "t string, n string, s string, p string")
    got = df.select(sca.truthy(F.col("t")), sca.number(F.col("n"), 7.0), sca.type_of_stem(F.col("s"), {"quad": "drone", "plane": "airplane"}), sca.parent_folder(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, 1.5, "drone", "b"), (False, 7.0, "airplane", ""), (False, 7.0, "unknown", None)]


def test_alpha_statistics():
    full = np.full((20, 20), 255, np.uint8)
    assert pixels.alpha_statistics(full) == {"alpha_area": 1.0, "border": 0.19, "comps": 1, "largest": 1.0, "rectangle": 1.0}
    inner = np.zeros((20, 20), np.uint8)
    inner[2:18, 2:18] = 255
    got = pixels.alpha_statistics(inner)
    assert (got["border"], got["rectangle"], got["alpha_area"]) == (0.0, 0.0, 0.64)
    edge = np.zeros((20, 20), np.uint8)
    edge[0, :] = edge[10, 5:7] = 13
    assert pixels.alpha_statistics(edge) == {"alpha_area": 0.055, "border": 0.909091, "comps": 1, "largest": 0.909091, "rectangle": 0.0}
    assert pixels.alpha_statistics(np.full((4, 4), 12, np.uint8))["comps"] == 0


def test_annotation_reasons(spark):
    lines = ["", "  # note", "0 0.5 0.5", "x 0.5 0.5 0.1 0.1", "9 0.5 0.5 0.1 0.1", "1.0\t0.5 0.5 0.1 0.1", "0 0.5 0.5 0 0.1", "0 0.5 0.5 0.01 0.01", "0 0.0 0.5 0.2 0.2 extra"]
    got = annotations.label_lines(spark.createDataFrame([(x,) for x in lines], "line_text string")).collect()
    assert [r.reason for r in got] == ["malformed_label_line", "parse_error", "class_id_not_exported", None, "clip_failed", "below_min_bbox_px", None]
    assert [(r.cls, r.x, r.y, r.w, r.h) for r in got if r.reason is None] == [(1, 288, 216, 64, 48), (0, 0, 192, 128, 96)]
    ddl = "category string, iscrowd int, x double, y double, w double, h double, image_width int, image_height int, there boolean"
    boxes = [("b", 0, 0.0, 0.0, 9.0, 9.0, 9, 9, True), ("a", 1, 0.0, 0.0, 9.0, 9.0, 9, 9, True), ("a", 0, 0.0, 0.0, 0.0, 9.0, 9, 9, True), ("a", 0, 0.0, 0.0, 3.0, 3.0, 9, 9, True), ("a", 0, 0.0, 0.0, 99.0, 3.0, 9, 9, True),
             ("a", 0, 0.0, 0.0, 9.0, 9.0, None, None, True), ("a", 0, 0.0, 0.0, 9.0, 9.0, 9, 9, False), ("a", 0, 0.0, 0.0, 9.0, 9.0, 0, 9, True), ("a", 0, 0.6, 0.0, 9.0, 9.0, 9, 9, True), ("a", 0, 0.5, 0.0, 9.0, 9.0, 9, 9, True)]
    got = annotations.coco_boxes(spark.createDataFrame(boxes, ddl), ("a",), 4, 50).collect()
    assert [r.reason for r in got] == ["category_not_requested", "iscrowd", "invalid_bbox", "bbox_too_small", "bbox_too_large", "image_missing", "image_missing", "other", "invalid_bbox", None]
    assert annotations.coco_boxes(spark.createDataFrame(boxes[1:2], ddl), ("a",), 4, crowds=True).first().reason is None


def plain_greedy(truth, preds, threshold):
    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    pairs = sorted(((iou(t, p), gi, pi) for gi, t in truth for pi, p in preds), reverse=True)
    g, q, out = set(), set(), set()
    for v, gi, pi in pairs:
        if v >= threshold and v > 0 and gi not in g and pi not in q:
            g.add(gi), q.add(pi), out.add((gi, pi))
    return out


def test_greedy_matching_against_brute_force(spark):
    rng = random.Random(4)
    box = lambda: (rng.randrange(20), rng.randrange(20), rng.randrange(5, 15), rng.randrange(5, 15))
    truth = [(i, gi, *box()) for i in range(60) for gi in range(rng.randrange(5))]
    preds = [(i, pi, "m", rng.random(), *box()) for i in range(60) for pi in range(rng.randrange(6))]
    t = spark.createDataFrame(truth, "image_id int, gi int, x int, y int, w int, h int")
    p = spark.createDataFrame(preds, "image_id int, pi int, model_name string, confidence double, x int, y int, w int, h int")
    got = {(r.image_id, r.iou_threshold, r.gi, r.pi) for r in matching.match_greedy(t, p, [0.1, 0.3]).collect()}
    want = {(i, th, g, q) for i in range(60) for th in (0.1, 0.3) for g, q in plain_greedy([(r[1], r[2:]) for r in truth if r[0] == i], [(r[1], r[4:]) for r in preds if r[0] == i], th)}
    assert got == want and len(want) > 30


def test_ranks_do_not_need_a_task_for_each_group(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(6)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(7)
    got = {r.k: r.n for r in selection.ranked(df, ["g"], [F.col("v").desc(), "k"], "n").collect()}
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = n
    assert got == want
    assert sorted(r.n for r in selection.ranked(df, [], ["k"], "n").collect()) == list(range(1, 301)) and selection.ranked(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_ranks_are_gapless_when_ranges_are_drawn_anew(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.exchange.reuse": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 5000, 1, 6)
        got = {r.id: r.n for r in selection.ranked(df, [], [selection.chance(7, "id"), "id"], "n").collect()}
        levels = selection.balanced_schedule(df, "id", 5000, {"size": [8, 15, 30], "blur": ["none", "mild"]}, 42).groupBy("size").count().collect()
        candidates = df.selectExpr(
            "concat('in/', id, '.jpg') as original_path", "'' as clip_output_path", "concat('out/', id, '.jpg') as output_path", "'field' as places365_category", "'horizon' as mapped_background_type",
            "id % 7 as upper_sky_ratio", "'good' as clip_good_prompt", "'bad' as clip_bad_prompt", "id % 5 as clip_suitability_score", "'accept' as clip_filter_status",
        )
        manifest = {r.original_path: int(r.candidate_id.split("_")[2]) for r in packs.review_manifest(candidates).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    drawn = sorted(range(5000), key=lambda i: hashlib.sha256(f"7|{i}".encode()).hexdigest())
    assert got == {i: n for n, i in enumerate(drawn, 1)}
    assert {r["size"]: r["count"] for r in levels} == {8: 1667, 15: 1667, 30: 1666}
    ordered = sorted(range(5000), key=lambda i: (-(i % 5), -(i % 7), f"in/{i}.jpg"))
    assert manifest == {f"in/{i}.jpg": n for n, i in enumerate(ordered, 1)}


def test_shares_leave_the_rest_to_the_first(spark):
    got = {r.subset: r["count"] for r in selection.assign_by_ratio(spark.range(11), "id", 11, {"a": 0.3, "b": 0.3, "c": 0.4}, 1).groupBy("subset").count().collect()}
    assert got == {"a": 4, "b": 3, "c": 4}


def test_split_caps(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") < 70, "x").otherwise("y"))
    assert selection.stratified_split(df, "s", "id", 1, most=20).count() == 20
    assert {r.s: r["count"] for r in selection.stratified_split(df, "s", "id", 1, most_each=10).groupBy("s").count().collect()} == {"x": 10, "y": 10}


def test_manifests_and_exports(spark):
    rows = [("a", "accept", "cloudy_sky", ""), ("b", "no", "", ""), ("c", "", "", ""), ("d", "yes", "", "runway_or_airport")]
    ddl = "candidate_id string, decision string, final_category string, mapped_background_type string"
    good = packs.applied_decisions(spark.createDataFrame(rows, ddl))
    assert sorted((r.candidate_id, r.final_category) for r in packs.require_applicable(good).collect()) == [("a", "cloudy_sky"), ("d", "runway_or_airport")]
    for bad in (("e", "perhaps", "cloudy_sky", ""), ("e", "accept", "moon", "")):
        with pytest.raises(ValueError, match="invalid"):
            packs.require_applicable(packs.applied_decisions(spark.createDataFrame([*rows, bad], ddl)))
    with pytest.raises(ValueError, match="no row"):
        packs.require_applicable(good.where("decision <> 'accept'"))
    assert packs.class_filter(["a", "b", "c"], ["c", " a "]) == ["a", "c"] and packs.class_filter(["a"], None) == ["a"]
    with pytest.raises(ValueError, match="unknown classes"):
        packs.class_filter(["a"], ["b"])
    pool = spark.createDataFrame([("bird",)], "cls string")
    packs.check_pools({"rivals": pool}, "cls", {"rivals": ["bird"]})
    with pytest.raises(ValueError, match="no assets of kite"):
        packs.check_pools({"rivals": pool}, "cls", {"rivals": ["bird", "kite"]})
    with pytest.raises(ValueError, match="no assets in the pool"):
        packs.check_pools({"rivals": pool.limit(0)})


def test_records_of_generated_images(spark):
    ddl = "idx int, subset string, background_id string, background_type string, background_path string, drone_asset_id string, drone_path string, drone_source string, distractor_asset_id string, distractor_type string, drone_x int, drone_y int, drone_w int, drone_h int, distractor_x int, distractor_y int, distractor_w int, distractor_h int, noise_sigma int, blur_level string, attempts int"
    plan = [(0, "synthetic_drone_positive", "sky1", "cloudy_sky", "/bg/sky1.jpg", "d7", "/a/d7.png", "set", None, None, 10, 20, 15, 12, None, None, None, None, 10, "mild", 1),
            (1, "synthetic_distractor_only", "sky2", "cloudy_sky", "/bg/sky2.jpg", None, None, None, "b3", "bird", None, None, None, None, 5, 6, 30, 20, 0, "none", 2),
            (2, "synthetic_drone_plus_distractor", "sky1", "cloudy_sky", "/bg/sky1.jpg", "d7", "/a/d7.png", "set", "b3", "bird", 10, 20, 15, 12, 5, 6, 30, 20, 20, "mild", 3)]
    settings = {"split": "test", "seed": 42, "images_dir": "/out/images", "labels_dir": "/out/labels", "asset_source": "processed", "mode": "upper_sky", "region": (0.05, 0.95, 0.03, 0.55)}
    out = packs.metadata_record(spark.createDataFrame(plan, ddl), settings, {"near": 60, "medium": 30, "far": 15, "very_far": 8}, {"none": 0, "mild": 5})
    assert tuple(out.columns) == packs.RECORD_COLUMNS and len(out.columns) == 63
    a, b, c = out.orderBy("image_id").collect()
    assert (a.image_id, a.image_path, a.label_path, a.seed, a.generation_seed) == ("img_000001.png", "/out/images/img_000001.png", "/out/labels/img_000001.txt", 42, 42)
    assert (a.target_bbox, a.bbox, a.distractor_bboxes, a.distractor_classes) == ("[10, 20, 15, 12]", "[10, 20, 15, 12]", "[]", "[]")
    assert (a.pasted_object_summary, b.pasted_object_summary, c.pasted_object_summary) == ("drone:d7", "distractor:bird:b3", "drone:d7+distractor:bird:b3")
    assert (a.asset_id, b.asset_id, c.asset_id) == ("d7", "b3", "d7+b3") and json.loads(b.distractor_bboxes) == [[5, 6, 30, 20]] and json.loads(c.distractor_asset_ids) == ["b3"]
    assert (a.difficulty, b.difficulty, c.difficulty) == ("hard", "hard_negative", "hard") and (a.distance_bin, b.distance_bin) == ("far", "medium")
    assert (a.drone_center_x, a.distractor_center_x, a.drone_distractor_iou, a.blur_strength, b.blur_strength) == (17.5, None, None, 5, 0)
    assert round(c.drone_distractor_iou, 6) == round(15 * 6 / (180 + 600 - 90), 6) and (c.drone_bbox_w, b.drone_bbox_w, c.placement_region_y_max) == (15, None, 0.55)


def test_proposals(spark):
    images = spark.createDataFrame([(1, "bird", 100, 100), (2, "drone", 100, 100), (3, "bird", 100, 40), (4, "kite", 30, 30)], "image_id int, asset_type string, width int, height int")
    found = spark.createDataFrame([(1, 0, 14, 0.5, 10.0, 10.0, 20.0, 20.0), (1, 1, 4, 0.9, 0.0, 0.0, 90.0, 90.0), (2, 0, 7, 0.5, 40.0, 40.0, 60.0, 60.0), (2, 1, 8, 0.5, 40.0, 40.0, 60.0, 60.0), (3, 0, 4, 0.9, 0.0, 0.0, 9.0, 9.0)], "image_id int, pi int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: (r.method, r.x, r.y, r.w, r.h) for r in packs.propose(images, found).collect()}
    assert got == {1: ("yolo_bird", 10, 10, 10, 10), 2: ("largest_detection_fallback", 40, 40, 20, 20), 3: ("center_heuristic", 14, 4, 72, 32), 4: ("center_heuristic", 0, 0, 30, 30)}


def test_appending_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(f"{tmp_path}/one")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    first = relations.append_once(f"{tmp_path}/one", new, ["k"], f"{tmp_path}/two")
    again = relations.append_once(f"{tmp_path}/two", new, ["k"], f"{tmp_path}/three")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        relations.append_once(f"{tmp_path}/one", new, ["k"], f"{tmp_path}/one/")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,\n,x\n")
    assert [tuple(r) for r in tables.csv_table(spark, f"{tmp_path}/t.csv", "a int, b string").collect()] == [(1, None), (None, "x")]
    assert [tuple(r) for r in tables.csv_table(spark, f"{tmp_path}/t.csv", keep_strings=True).collect()] == [("1", ""), ("", "x")]
    with pytest.raises(ValueError, match="lacks"):
        tables.csv_table(spark, f"{tmp_path}/t.csv", required=["c"])
    assert one(spark, tables.label_path(F.lit("/d/images/train/a.b.jpg")))[0] == "/d/labels/train/a.b.txt"
    for d in ("one/valid/images", "one/valid/labels", "one/images/train", "one/labels/train"):
        (tmp_path / d).mkdir(parents=True)
    root = f"{tmp_path}/one"
    assert tables.split_folders(spark, root, ["train", "val", "valid", "test"]) == [("train", f"{root}/images/train", f"{root}/labels/train"), ("valid", f"{root}/valid/images", f"{root}/valid/labels")]
    lines = spark.createDataFrame([(0,), (1,), (5,)], "cls int")
    assert [r.class_name for r in tables.resolved_classes(lines, {0: "bird", 1: "kite"}, ["kite"]).collect()] == [None, "kite", None]
    df = spark.createDataFrame([("b", "/x/a10.png", "f", 1), ("b", "/y/a10.png", "f", 2), ("a", "/x/a9.png", "f", 3)], "split string, p string, folder string, k int")
    assert sorted(r.export_path for r in tables.export_names(df, "folder", "p", "k").collect()) == ["f/2_a10.png", "f/a10.png", "f/a9.png"]
    tables.write_columns(df, f"{tmp_path}/out", ["k", "p"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").columns == ["k", "p"]
    with pytest.raises(ValueError, match="lacks"):
        tables.write_columns(df, f"{tmp_path}/out", ["nothing"])
    tables.write_by(df, f"{tmp_path}/by", "split")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"split=a", "split=b"}
    tables.write_lists(df, f"{tmp_path}/lists", "p")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lists/split=b").collect()) == ["/x/a10.png", "/y/a10.png"]
    text = tables.dataset_yaml("/d", {0: "drone"})
    assert tables.class_names(text) == {0: "drone"} and "nc: 1" in text


def test_settings():
    raw = {"seed": 1, "generation": {"num_images": 9, "subset_ratios": {"a": 0.5, "b": 0.5}}, "input": {}, "variables": {"drone_size_px": [8, "15"]}, "placement": {"y_max_fraction": 0.6}}
    got = config.generation(raw)
    assert (got.images, got.sizes, got.placement.down, got.placement.across, got.excluded_labels) == (9, (8, 15), (0.03, 0.6), (0.05, 0.95), frozenset({"reject"}))
    for change in ({"generation": {"mode": "x"}}, {"generation": {"num_images": 9, "subset_ratios": {"a": 0.5}}}, {"generation": {"mode": "smoke_manual"}}, {"input": {"asset_source": "x"}}, {"variables": {}}):
        with pytest.raises(ValueError):
            config.generation(raw | change)
    pinned = config.generation(raw | {"generation": {"mode": "smoke_manual", "subset_counts": {"synthetic_drone_positive": 2, "synthetic_distractor_only_bird": 1}}})
    assert pinned.images == 3 and pinned.schedule[-1] == ("synthetic_distractor_only", "bird") and config.generation({k: v for k, v in raw.items() if k != "placement"}).placement.mode == "legacy"
    ev = config.evaluation({"evaluation": {}, "grounding_dino": {"box_threshold": 0.3}, "models": [{"name": "a", "type": "grounding_dino"}, {"name": "b", "type": "x", "enabled": False}]})
    assert [m["box_threshold"] for m in ev.models] == [0.3] and ev.thresholds == (0.25, 0.5)
    with pytest.raises(ValueError):
        config.evaluation({"evaluation": {"iou_thresholds": [2]}})
    assert json.loads(config.run_info({"b": 1}, images=3)) == {"settings": {"b": 1}, "images": 3}
