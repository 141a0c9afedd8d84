"""Manifests, exports, pool checks and metadata records of image packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..plans import rules

#: The categories of the final pack.
FINAL_CATEGORIES = ("clear_upper_sky", "cloudy_sky", "sky_with_natural_landscape", "sky_with_built_environment", "runway_or_airport")
#: The columns of a review manifest.
MANIFEST_COLUMNS = (
    "candidate_id", "original_path", "output_path", "places365_category", "mapped_background_type", "upper_sky_ratio", "clip_good_prompt", "clip_bad_prompt", "clip_suitability_score",
    "decision", "final_category", "notes",
)
#: The columns of a generated image's record.
RECORD_COLUMNS = (
    "image_id", "split", "subset", "target_present", "target_class", "distractor_classes", "background_source", "foreground_asset_source", "background_type", "background_path",
    "background_filename", "object_size_px", "distance_bin", "gaussian_noise_sigma", "blur_level", "contrast_level", "lighting", "difficulty", "target_bbox", "target_asset_id",
    "distractor_bboxes", "distractor_asset_ids", "pasted_object_summary", "bbox", "asset_id", "seed", "foreground_asset_path", "foreground_asset_id", "foreground_source_dataset",
    "generation_seed", "background_id", "background_category", "drone_present", "drone_asset_id", "drone_bbox_x", "drone_bbox_y", "drone_bbox_w", "drone_bbox_h", "drone_size_px",
    "distractor_present", "distractor_type", "distractor_asset_id", "distractor_bbox_x", "distractor_bbox_y", "distractor_bbox_w", "distractor_bbox_h", "distractor_size_px", "noise_sigma",
    "blur_type", "blur_strength", "image_path", "label_path", "placement_mode", "placement_region_x_min", "placement_region_x_max", "placement_region_y_min", "placement_region_y_max",
    "drone_center_x", "drone_center_y", "distractor_center_x", "distractor_center_y", "drone_distractor_iou", "placement_attempts",
)


def class_filter(available: list[str], wanted: list[str] | None) -> list[str]:
    """The wanted classes, in the order of the data; all if none is wanted.  Unknown ones raise."""
    names = {w.strip() for w in wanted or [] if w.strip()}
    if not names:
        return list(available)
    unknown = names - set(available)
    if unknown:
        raise ValueError(f"unknown classes {sorted(unknown)}; there are {sorted(available)}")
    return [a for a in available if a in names]


def check_pools(pools: dict[str, DataFrame], class_col: str | None = None, required: dict[str, list[str]] | None = None) -> None:
    """Raise if a pool is empty or lacks a required class.  Reads one row of each pool and the distinct required classes."""
    for name, df in pools.items():
        if df.isEmpty():
            raise ValueError(f"no assets in the pool {name}")
    for name, classes in (required or {}).items():
        known = {r[0] for r in pools[name].where(F.col(class_col).isin(*classes)).select(class_col).distinct().collect()}
        if lost := [c for c in classes if c not in known]:
            raise ValueError(f"the pool {name} has no assets of {', '.join(lost)}")


def pool_checks(pool: DataFrame, class_col: str, classes: list[str]) -> DataFrame:
    """``check`` and ``n`` for each required class, 0 where it is missing, and the whole pool."""
    counts = pool.agg(F.count("*").alias("pool"), *[F.count_if(F.col(class_col) == c).alias(c) for c in classes])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in ("pool", *classes)])).alias("r")
    return counts.select(rows).select("r.check", "r.n")


def review_manifest(candidates: DataFrame, ids: Column | None = None) -> DataFrame:
    """The manifest of candidates that the scorer took in: blank decisions, the mapped type as final category.

    Rows are numbered in the order of type, falling score and falling sky share; ties go by file.
    """
    from .relations import ids_in_order

    path = F.coalesce(scalars.first_of(F.col("clip_output_path"), F.col("output_path")), F.lit(""))
    mapped = F.coalesce(scalars.clean(F.col("mapped_background_type")), F.lit("sky_with_natural_landscape"))
    taken = candidates.where("clip_filter_status = 'accept'").withColumns({"output_path": path, "mapped_background_type": mapped})
    file = F.regexp_extract(F.when(F.col("output_path") != "", F.col("output_path")).otherwise(F.col("original_path")), r"([^/\\]*)$", 1)
    order = [F.col("mapped_background_type"), F.col("clip_suitability_score").desc(), F.col("upper_sky_ratio").desc(), F.col("original_path")]
    numbered = ids_in_order(taken.withColumn("file_", file), order, "p365_bg_%04d", "candidate_id", first=1)
    blank = F.lit("")
    out = numbered.withColumn("candidate_id", F.concat("candidate_id", F.lit("_"), F.substring(F.sha2(F.col("file_"), 256), 1, 6)))
    return out.withColumns({"decision": blank, "final_category": F.col("mapped_background_type"), "notes": blank}).select(*MANIFEST_COLUMNS)


def applied_decisions(manifest: DataFrame) -> DataFrame:
    """``decision`` and ``final_category`` of accepted rows, and in ``invalid`` what is wrong with a row, or null.

    Blank decisions are pending; other words than accept and reject, and categories that are not known, are invalid.
    """
    word = scalars.decision(F.col("decision"))
    category = F.coalesce(scalars.first_of(F.col("final_category"), F.col("mapped_background_type")), F.lit(""))
    known = manifest.withColumns({"decision": word, "final_category": category})
    wrong = F.when(~F.col("decision").isin("", "accept", "reject"), "decision").when((F.col("decision") == "accept") & ~F.col("final_category").isin(*FINAL_CATEGORIES), "final_category")
    return known.withColumn("invalid", wrong)


def require_applicable(applied: DataFrame) -> DataFrame:
    """Accepted rows; raises if there are none or if any row is invalid, naming the first few words."""
    bad = applied.where("invalid is not null").select("invalid", F.when(F.col("invalid") == "decision", F.col("decision")).otherwise(F.col("final_category")).alias("word"))
    if found := bad.distinct().limit(5).collect():
        raise ValueError("invalid " + ", ".join(f"{r.invalid} {r.word!r}" for r in found))
    taken = applied.where("decision = 'accept'")
    if taken.isEmpty():
        raise ValueError("no row is accepted")
    return taken


def export_approved(df: DataFrame, listing: DataFrame, label: str = "accept") -> DataFrame:
    """``export_status`` of rows: skipped by their label, failed, without file, repeating a path, or exported.

    ``df`` has id, label, extraction_failed and path; ``listing`` the paths that exist.  Of rows of one path the least id goes out.
    """
    there = listing.select(F.col("path").alias("there_")).distinct()
    joined = df.join(there, F.col("path") == F.col("there_"), "left")
    status = F.when(F.col("extraction_failed"), "skipped_extraction_failed").when(~F.coalesce(F.col("label") == label, F.lit(False)), "skipped_label").when(F.col("there_").isNull(), "skipped_missing_file")
    first = joined.withColumn("status_", status)
    least = first.where("status_ is null").groupBy(F.col("path").alias("p_")).agg(F.min("id").alias("least_"))
    out = first.join(least, F.col("path") == F.col("p_"), "left")
    final = F.coalesce("status_", F.when(F.col("id") == F.col("least_"), "exported").otherwise("skipped_duplicate_path"))
    return out.select(*df.columns, final.alias("export_status"))


def export_counts(exported: DataFrame) -> DataFrame:
    """How many rows met each status."""
    return exported.groupBy("export_status").agg(F.count("*").alias("n"))


def sky_pack_checks(pack: DataFrame, listing: DataFrame, least: int = 20) -> DataFrame:
    """``check, level, n`` of a pack of backgrounds: repeated ids and files, labels other than accept, missing files, too few rows."""
    from .relations import checks

    there = listing.select(F.col("path").alias("there_")).distinct()
    known = pack.join(there, F.col("path") == F.col("there_"), "left")
    rows = {"not_accepted": ("error", "lower(coalesce(qa_final_label, '')) <> 'accept'"), "missing_file": ("error", "there_ is null")}
    out = checks(known, rows, ["background_id", "file_name"])
    few = pack.agg(F.when(F.count("*") < least, F.count("*")).otherwise(0).alias("n"))
    return out.unionByName(few.select(F.lit("below_min_count").alias("check"), F.lit("warning").alias("level"), "n"))


def asset_pack_checks(pack: DataFrame, listing: DataFrame, group: str, name: str) -> DataFrame:
    """``check, level, n`` of a pack of assets: repeats, missing files, other groups, classes or labels, and no rows at all."""
    from .relations import checks

    there = listing.select(F.col("path").alias("there_")).distinct()
    known = pack.join(there, F.col("path") == F.col("there_"), "left").withColumns({"group_": F.lit(group), "name_": F.lit(name)})
    rows = {
        "missing_file": ("error", "there_ is null"),
        "unexpected_group": ("error", "trim(coalesce(class_group, '')) <> group_"),
        "unexpected_class": ("error", "trim(coalesce(class_name, '')) <> name_"),
        "not_accepted": ("warning", "lower(trim(coalesce(qa_final_label, ''))) <> 'accept'"),
    }
    out = checks(known, rows, ["asset_id", "path"])
    none = pack.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("n"))
    return out.unionByName(none.select(F.lit("empty_pack").alias("check"), F.lit("error").alias("level"), "n"))


def propose(images: DataFrame, detections: DataFrame, coverage: float = 0.72) -> DataFrame:
    """A box for each image: the best detection of its type, else the middle of the image.

    ``images`` has image_id, asset_type, width, height; ``detections`` image_id, pi, class_id, confidence and corners.  Birds
    and airplanes take their own class only; drones, which the classes lack, any; other types none.
    """
    # The detector's numbers of birds and airplanes.
    own = F.when(F.col("asset_type") == "bird", 14).when(F.col("asset_type") == "airplane", 4)
    joined = detections.join(images, "image_id").where((F.col("asset_type") == "drone") | F.coalesce(F.col("class_id") == own, F.lit(False)))
    whole = lambda c: F.greatest(F.lit(1), F.bround(c).cast("int"))
    w, h = whole(F.col("x2") - F.col("x1")), whole(F.col("y2") - F.col("y1"))
    middle = ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    away = F.abs(middle[0] - F.col("width") / 2) / F.greatest("width", F.lit(1)) + F.abs(middle[1] - F.col("height") / 2) / F.greatest("height", F.lit(1))
    score = F.col("confidence") * F.sqrt(w * h) * (F.lit(1.0) - F.lit(0.35) * away)
    box = F.struct(F.bround("x1").cast("int").alias("x"), F.bround("y1").cast("int").alias("y"), w.alias("w"), h.alias("h"), F.col("confidence").cast("double").alias("confidence"))
    best = joined.groupBy("image_id").agg(F.max_by(box, F.struct(score, -F.col("pi"))).alias("found"))
    side = lambda c: F.greatest(F.lit(32), F.bround(F.col(c) * coverage).cast("int"))
    cw, ch = side("width"), side("height")
    centred = F.struct(
        F.greatest(F.lit(0), F.floor((F.col("width") - cw) / 2).cast("int")).alias("x"), F.greatest(F.lit(0), F.floor((F.col("height") - ch) / 2).cast("int")).alias("y"),
        cw.alias("w"), ch.alias("h"), F.lit(0.0).alias("confidence"),
    )
    method = F.when(F.col("found").isNull(), "center_heuristic").when(F.col("asset_type") == "drone", "largest_detection_fallback").otherwise(F.concat(F.lit("yolo_"), F.col("asset_type")))
    chosen = images.join(best, "image_id", "left").withColumn("method", method).withColumn("b", F.coalesce("found", centred))
    clamped = geo.clamp((F.col("b.x"), F.col("b.y"), F.col("b.w"), F.col("b.h")), F.col("width"), F.col("height"))
    return chosen.select("image_id", "method", F.col("b.confidence").alias("confidence"), *[c.alias(n) for c, n in zip(clamped, "xywh")])


def by_label(df: DataFrame, label: str, *then: str) -> DataFrame:
    """``label_rank`` and ``df`` in the order accept, review, reject, none, anything else, then by the other columns."""
    word = F.coalesce(F.col(label), F.lit(""))
    rank = F.when(word == "accept", 0).when(word == "review", 1).when(word == "reject", 2).when(word == "", 3).otherwise(99)
    return df.withColumn("label_rank", rank).orderBy("label_rank", *then)


def _json(*columns: str) -> Column:
    """A JSON list of numbers, empty where the first is missing."""
    return F.when(F.col(columns[0]).isNotNull(), F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in columns]), F.lit("]"))).otherwise("[]")


def metadata_record(plan: DataFrame, settings: dict[str, object], bins: dict[str, int], kernels: dict[str, int]) -> DataFrame:
    """The record of each generated image, with all ``RECORD_COLUMNS``.

    ``plan`` has idx, subset, background_id, background_type, background_path, drone_asset_id, drone_path, drone_source,
    distractor_asset_id, distractor_type, drone_x, drone_y, drone_w, drone_h, distractor_x, distractor_y, distractor_w,
    distractor_h, noise_sigma, blur_level and attempts; parts that an image lacks are null.  ``settings`` has split, seed, images_dir,
    labels_dir, asset_source, mode and region (four shares).  Missing numbers and names are null, as a CSV shows them blank.
    """
    there, other = F.col("drone_x").isNotNull(), F.col("distractor_x").isNotNull()
    drone = tuple(F.col("drone_" + n) for n in "xywh")
    rival = tuple(F.col("distractor_" + n) for n in "xywh")
    drone_px, rival_px = F.when(there, F.greatest("drone_w", "drone_h")), F.when(other, F.greatest("distractor_w", "distractor_h"))
    size = F.coalesce(drone_px, rival_px)
    stem = F.format_string("img_%06d", F.col("idx") + 1)
    quoted = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('["'), F.col(c), F.lit('"]'))).otherwise("[]")
    pasted_drone = F.concat(F.lit("drone:"), F.coalesce("drone_asset_id", F.lit("")))
    pasted_other = F.concat(F.lit("distractor:"), F.coalesce("distractor_type", F.lit("distractor")), F.lit(":"), F.coalesce("distractor_asset_id", F.lit("?")))
    middle, rival_middle = geo.centre(drone), geo.centre(rival)
    seed = F.lit(settings["seed"]) + F.col("idx")
    text = lambda name: F.lit(settings[name])
    blur = F.create_map(*[F.lit(x) for pair in kernels.items() for x in pair])
    kind = F.when(there & other, "mixed_challenge").when(other, "hard_negative").otherwise(F.col("subset"))
    values = {
        "image_id": F.concat(stem, F.lit(".png")),
        "split": text("split"),
        "target_present": there,
        "target_class": F.when(there, "drone"),
        "distractor_classes": quoted("distractor_type"),
        "background_source": F.lit("manual_curated"),
        "foreground_asset_source": text("asset_source"),
        "background_filename": F.regexp_extract("background_path", r"([^/\\]*)$", 1),
        "object_size_px": size,
        "distance_bin": geo.distance_bin(size, bins),
        "gaussian_noise_sigma": F.col("noise_sigma"),
        "contrast_level": F.lit("normal"),
        "lighting": F.lit("day"),
        "difficulty": geo.difficulty(size, F.col("noise_sigma"), F.col("blur_level"), kind),
        "target_bbox": _json("drone_x", "drone_y", "drone_w", "drone_h"),
        "target_asset_id": F.col("drone_asset_id"),
        "distractor_bboxes": F.when(other, F.concat(F.lit("["), _json("distractor_x", "distractor_y", "distractor_w", "distractor_h"), F.lit("]"))).otherwise("[]"),
        "distractor_asset_ids": quoted("distractor_asset_id"),
        "pasted_object_summary": F.when(there & other, F.concat(pasted_drone, F.lit("+"), pasted_other)).when(there, pasted_drone).otherwise(pasted_other),
        "bbox": F.when(there, _json("drone_x", "drone_y", "drone_w", "drone_h")).otherwise(_json("distractor_x", "distractor_y", "distractor_w", "distractor_h")),
        "asset_id": F.when(there & other, F.concat_ws("+", "drone_asset_id", "distractor_asset_id")).otherwise(F.coalesce("drone_asset_id", "distractor_asset_id", F.lit(""))),
        "seed": seed,
        "foreground_asset_path": F.col("drone_path"),
        "foreground_asset_id": F.col("drone_asset_id"),
        "foreground_source_dataset": F.col("drone_source"),
        "generation_seed": seed,
        "background_category": F.col("background_type"),
        "drone_present": there,
        "drone_size_px": drone_px,
        "distractor_present": other,
        "distractor_size_px": rival_px,
        "blur_type": F.col("blur_level"),
        "blur_strength": F.element_at(blur, F.col("blur_level")),
        "image_path": F.concat(text("images_dir"), F.lit("/"), stem, F.lit(".png")),
        "label_path": F.concat(text("labels_dir"), F.lit("/"), stem, F.lit(".txt")),
        "placement_mode": text("mode"),
        "drone_center_x": middle[0],
        "drone_center_y": middle[1],
        "distractor_center_x": rival_middle[0],
        "distractor_center_y": rival_middle[1],
        "drone_distractor_iou": F.when(there & other, geo.iou(drone, rival)),
        "placement_attempts": F.col("attempts"),
    }
    values |= {f"{side}_bbox_{n}": F.col(f"{side}_{n}") for side in ("drone", "distractor") for n in "xywh"}
    values |= {f"placement_region_{n}": F.lit(float(v)) for n, v in zip(("x_min", "x_max", "y_min", "y_max"), settings["region"])}
    return plan.select(*[values.get(c, F.col(c) if c in plan.columns else None).alias(c) for c in RECORD_COLUMNS])


def accepted_rows(manifest: DataFrame) -> DataFrame:
    """Rows that a reviewer or the triage took in."""
    return manifest.where(rules.accepted())
