"""Predictions matched to ground truth by overlap, and per-image facts.

Pairs come from an equi-join on the image with the overlap as a residual filter.  With at most one true box per image a
window picks the match; the general case takes pairs greedily inside each image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, iou


def iou_pairs(truth: DataFrame, predictions: DataFrame, least: float = 0.0) -> DataFrame:
    """``image_id, gi, pi, model_name, confidence, iou`` of overlapping pairs at or above ``least``."""
    g = truth.select("image_id", "gi", *[F.col(c).alias("g_" + c) for c in "xywh"])
    pairs = predictions.join(g, "image_id").withColumn("iou", iou(box("g_"), box()))
    return pairs.where((F.col("iou") > 0) & (F.col("iou") >= least)).select("image_id", "model_name", "gi", "pi", "confidence", "iou")


def match_single(truth: DataFrame, predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Matches where an image has at most one true box: the best overlap wins, ties go to the later prediction."""
    pairs = iou_pairs(truth, predictions, min(thresholds))
    fanned = pairs.withColumn("iou_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("iou >= iou_threshold")
    best = F.max(F.struct("iou", "pi", "confidence", "gi"))
    return fanned.groupBy("image_id", "model_name", "iou_threshold").agg(best.alias("b")).select("image_id", "model_name", "iou_threshold", "b.gi", "b.pi", "b.iou", "b.confidence")


def match_greedy(truth: DataFrame, predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """One-to-one matches of any number of boxes: pairs in descending order of (iou, gi, pi), taken if both are free.

    A group is one image's pairs for one model and threshold, which the boxes of an image bound; the walk over them is an
    array aggregation.
    """
    pairs = iou_pairs(truth, predictions, min(thresholds))
    fanned = pairs.withColumn("iou_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("iou >= iou_threshold")
    ranked = F.sort_array(F.collect_list(F.struct("iou", "gi", "pi", "confidence")), asc=False)
    grouped = fanned.groupBy("image_id", "model_name", "iou_threshold").agg(ranked.alias("r"))
    taken = F.expr("aggregate(r, slice(r, 1, 0), (held, x) -> if(exists(held, y -> y.gi = x.gi or y.pi = x.pi), held, array_append(held, x)))")
    return grouped.select("image_id", "model_name", "iou_threshold", F.explode(taken).alias("m")).select("image_id", "model_name", "iou_threshold", "m.gi", "m.pi", "m.iou", "m.confidence")


def image_facts(meta: DataFrame, truth: DataFrame, predictions: DataFrame, models: list[str], thresholds: list[float], matches: DataFrame | None = None) -> DataFrame:
    """One row for each image, model and threshold, images without predictions included.

    Columns beside ``meta``'s: model_name, iou_threshold, gt_count, pred_count, tp, fn, fp, detected, missed,
    false_positive_image, best_iou, matched_conf, fp_conf_mean.  Means and maxima over nothing are 0.
    """
    found = match_single(truth, predictions, thresholds) if matches is None else matches
    matched = found.groupBy("image_id", "model_name", "iou_threshold").agg(
        F.count("*").alias("tp"), F.max("iou").alias("best_iou"), F.max("confidence").alias("matched_conf"), F.sum("confidence").alias("conf_taken")
    )
    predicted = predictions.groupBy("image_id", "model_name").agg(F.count("*").alias("pred_count"), F.sum("confidence").alias("conf_all"))
    true = truth.groupBy("image_id").agg(F.count("*").alias("gt_count"))
    spark = meta.sparkSession
    grid = spark.createDataFrame([(m, float(t)) for m in models for t in thresholds], "model_name string, iou_threshold double")
    rows = meta.crossJoin(F.broadcast(grid)).join(true, "image_id", "left").join(predicted, ["image_id", "model_name"], "left")
    rows = rows.join(matched, ["image_id", "model_name", "iou_threshold"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    fp = n("pred_count") - n("tp")
    return rows.select(
        *meta.columns,
        "model_name",
        "iou_threshold",
        n("gt_count").alias("gt_count"),
        n("pred_count").alias("pred_count"),
        n("tp").alias("tp"),
        (n("gt_count") - n("tp")).alias("fn"),
        fp.alias("fp"),
        (F.col("target_present") & (n("tp") > 0)).cast("int").alias("detected"),
        (F.col("target_present") & (n("tp") == 0)).cast("int").alias("missed"),
        (~F.col("target_present") & (n("pred_count") > 0)).cast("int").alias("false_positive_image"),
        F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"),
        F.coalesce("matched_conf", F.lit(0.0)).alias("matched_conf"),
        F.when(fp > 0, F.round((F.col("conf_all") - F.coalesce("conf_taken", F.lit(0.0))) / fp, 6)).otherwise(0.0).alias("fp_conf_mean"),
    )


def matched_pairs(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with the corners of both boxes."""
    g = truth.select("image_id", "gi", F.col("x").alias("gt_x1"), F.col("y").alias("gt_y1"), (F.col("x") + F.col("w")).alias("gt_x2"), (F.col("y") + F.col("h")).alias("gt_y2"))
    p = predictions.select(
        "image_id", "pi", "pred_class_name", F.col("x").alias("pred_x1"), F.col("y").alias("pred_y1"), (F.col("x") + F.col("w")).alias("pred_x2"), (F.col("y") + F.col("h")).alias("pred_y2")
    )
    return matches.join(g, ["image_id", "gi"]).join(p, ["image_id", "pi"])
