"""Queries by name, and the SQL that DuckDB compares them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, rule_sql
from .functions import geometry as geo
from .functions import scalars as sca
from .operators import annotations, dedup, matching, metrics, packs, relations, selection
from .plans import rules

MODELS = ["det_a", "det_b"]
THRESHOLDS = [0.25, 0.5]
CLASSES = ["quadcopter", "uav", "drone"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = fixtures.with_relations(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fixtures.table(spark, d, name)


# Evaluation ------------------------------------------------------------------------------------------------


def _truth(spark, d):
    return t(spark, d, "fx_gt").withColumn("gi", F.lit(0))


def _predictions(spark, d):
    p = t(spark, d, "fx_pred")
    return p.where(sca.drone_like("ultralytics_yolo", F.col("pred_class_name"), CLASSES))


def _facts(spark, d):
    return matching.image_facts(t(spark, d, "fx_meta"), _truth(spark, d), _predictions(spark, d), MODELS, THRESHOLDS)


POLICY = "lower(trim(pred_class_name)) IN ('quadcopter', 'uav', 'drone')"
IOU = """CASE WHEN least(p.x + p.w, g.x + g.w) > greatest(p.x, g.x) AND least(p.y + p.h, g.y + g.h) > greatest(p.y, g.y) THEN
  CAST((least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * (least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS DOUBLE)
  / CAST(p.w * p.h + g.w * g.h - (least(p.x + p.w, g.x + g.w) - greatest(p.x, g.x)) * (least(p.y + p.h, g.y + g.h) - greatest(p.y, g.y)) AS DOUBLE) ELSE 0.0 END"""
FACTS = f"""WITH fp AS (SELECT * FROM fx_pred WHERE {POLICY}),
th AS (SELECT unnest([0.25, 0.5]) :: DOUBLE AS iou_threshold), mo AS (SELECT unnest(['det_a', 'det_b']) AS model_name),
pr AS (SELECT p.image_id, p.model_name, p.pi, CAST(p.confidence AS DOUBLE) AS confidence, {IOU} AS iou FROM fp p JOIN fx_gt g ON g.image_id = p.image_id),
mt AS (SELECT * FROM (SELECT pr.*, iou_threshold, row_number() OVER (PARTITION BY image_id, model_name, iou_threshold ORDER BY iou DESC, pi DESC) AS rk FROM pr, th WHERE iou >= iou_threshold AND iou > 0) WHERE rk = 1),
pc AS (SELECT image_id, model_name, count(*) AS pred_count, sum(CAST(confidence AS DOUBLE)) AS conf_all FROM fp GROUP BY ALL),
facts AS (SELECT m.*, mo.model_name, th.iou_threshold, CASE WHEN m.target_present THEN 1 ELSE 0 END AS gt_count, coalesce(pc.pred_count, 0) AS pred_count,
  CASE WHEN mt.pi IS NULL THEN 0 ELSE 1 END AS tp, CASE WHEN m.target_present AND mt.pi IS NULL THEN 1 ELSE 0 END AS fn,
  coalesce(pc.pred_count, 0) - CASE WHEN mt.pi IS NULL THEN 0 ELSE 1 END AS fp,
  CASE WHEN m.target_present AND mt.pi IS NOT NULL THEN 1 ELSE 0 END AS detected, CASE WHEN m.target_present AND mt.pi IS NULL THEN 1 ELSE 0 END AS missed,
  CASE WHEN NOT m.target_present AND coalesce(pc.pred_count, 0) > 0 THEN 1 ELSE 0 END AS false_positive_image,
  coalesce(mt.iou, 0.0) AS best_iou, coalesce(mt.confidence, 0.0) AS matched_conf,
  CASE WHEN coalesce(pc.pred_count, 0) - CASE WHEN mt.pi IS NULL THEN 0 ELSE 1 END > 0
    THEN round((pc.conf_all - coalesce(mt.confidence, 0.0)) / (pc.pred_count - CASE WHEN mt.pi IS NULL THEN 0 ELSE 1 END), 6) ELSE 0.0 END AS fp_conf_mean
  FROM fx_meta m CROSS JOIN mo CROSS JOIN th LEFT JOIN pc ON pc.image_id = m.image_id AND pc.model_name = mo.model_name
  LEFT JOIN mt ON mt.image_id = m.image_id AND mt.model_name = mo.model_name AND mt.iou_threshold = th.iou_threshold)
"""
SUMMARY = """SELECT model_name, iou_threshold, count(*) FILTER (WHERE target_present) AS n_target_present, count(*) FILTER (WHERE NOT target_present AND subset = 'synthetic_distractor_only') AS n_distractor_only,
  round(avg(detected) FILTER (WHERE target_present), 6) AS recall, CAST(coalesce(sum(tp) FILTER (WHERE target_present), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fn) FILTER (WHERE target_present), 0) AS BIGINT) AS fn,
  round(avg(best_iou) FILTER (WHERE target_present), 6) AS mean_best_iou, round(avg(false_positive_image) FILTER (WHERE NOT target_present), 6) AS false_positive_image_rate,
  CAST(coalesce(sum(fp) FILTER (WHERE NOT target_present), 0) AS BIGINT) AS fp_count
"""
RECALL = """count(*) AS n_images, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn,
  round(avg(best_iou), 9) AS mean_best_iou, round(avg(matched_conf), 9) AS mean_matched_conf, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall"""
FALSE = """count(*) AS n_images, CAST(sum(false_positive_image) AS BIGINT) AS false_positive_images, CAST(sum(fp) AS BIGINT) AS fp_count,
  round(avg(fp_conf_mean), 9) AS mean_fp_conf, round(sum(false_positive_image) / count(*), 6) AS false_positive_image_rate"""


@query(f"{FACTS} {SUMMARY} FROM facts GROUP BY model_name, iou_threshold")
def eval_summary_corrected(spark, d):
    return metrics.model_summary(_facts(spark, d))


@query(f"{FACTS} {SUMMARY} FROM facts WHERE pred_count > 0 GROUP BY model_name, iou_threshold")
def eval_summary_uncorrected(spark, d):
    return metrics.model_summary(metrics.predicted_only(_facts(spark, d)))


@query(f"{FACTS} SELECT image_id, model_name, iou_threshold, CAST(gt_count AS BIGINT) AS gt_count, CAST(pred_count AS BIGINT) AS pred_count, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, detected, missed, false_positive_image, best_iou, matched_conf, fp_conf_mean FROM facts")
def image_level_metrics(spark, d):
    f = _facts(spark, d)
    whole = ("gt_count", "pred_count", "tp", "fn", "fp")
    return f.select("image_id", "model_name", "iou_threshold", *[F.col(c).cast("long").alias(c) for c in whole], "detected", "missed", "false_positive_image", "best_iou", "matched_conf", "fp_conf_mean")


@query(f"""{FACTS}, x AS (SELECT mt.image_id, mt.model_name, mt.iou_threshold, mt.pi, mt.iou, mt.confidence FROM mt)
SELECT x.*, 0 AS gi, g.x AS gt_x1, g.y AS gt_y1, g.x + g.w AS gt_x2, g.y + g.h AS gt_y2, p.pred_class_name, p.x AS pred_x1, p.y AS pred_y1, p.x + p.w AS pred_x2, p.y + p.h AS pred_y2
FROM x JOIN fx_gt g ON g.image_id = x.image_id JOIN fp p ON p.image_id = x.image_id AND p.pi = x.pi""")
def matched_predictions(spark, d):
    truth, preds = _truth(spark, d), _predictions(spark, d)
    return matching.matched_pairs(truth, preds, matching.match_single(truth, preds, THRESHOLDS)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"SELECT p.image_id, p.model_name, 0 AS gi, p.pi, CAST(p.confidence AS DOUBLE) AS confidence, {IOU} AS iou FROM fx_pred p JOIN fx_gt g ON g.image_id = p.image_id WHERE {IOU} > 0")
def iou_pairs(spark, d):
    return matching.iou_pairs(_truth(spark, d), t(spark, d, "fx_pred")).withColumn("confidence", F.col("confidence").cast("double"))


@query()
def greedy_match_multi(spark, d):
    truth = t(spark, d, "fx_pred").where("model_name = 'det_a'").select("image_id", F.col("pi").alias("gi"), "x", "y", "w", "h")
    preds = t(spark, d, "fx_pred").where("model_name = 'det_b'")
    return matching.match_greedy(truth, preds, THRESHOLDS)


@query(f"{FACTS} SELECT model_name, iou_threshold, subset, {RECALL} FROM facts GROUP BY ALL")
def recall_by_subset(spark, d):
    return metrics.group_recall(_facts(spark, d), ["model_name", "iou_threshold", "subset"])


@query(f"{FACTS} SELECT model_name, iou_threshold, drone_size_px, gaussian_noise_sigma, blur_level, {RECALL} FROM facts WHERE target_present GROUP BY ALL")
def recall_by_size_noise_blur(spark, d):
    return metrics.group_recall(_facts(spark, d).where("target_present"), ["model_name", "iou_threshold", "drone_size_px", "gaussian_noise_sigma", "blur_level"])


@query(f"{FACTS} SELECT model_name, iou_threshold, distractor_present, {RECALL} FROM facts WHERE target_present GROUP BY ALL")
def recall_by_distractor_present(spark, d):
    return metrics.group_recall(_facts(spark, d).where("target_present"), ["model_name", "iou_threshold", "distractor_present"])


@query(f"{FACTS} SELECT model_name, iou_threshold, distractor_type, {FALSE} FROM facts GROUP BY ALL")
def fp_by_distractor_type(spark, d):
    return metrics.group_false_positives(_facts(spark, d), ["model_name", "iou_threshold", "distractor_type"])


GROUPED = ["model_name", "subset", "iou_threshold", "drone_size_px", "gaussian_noise_sigma", "blur_level", "distractor_present", "distractor_type", "background_type", "target_present"]


@query(f"""{FACTS}, a AS (SELECT {', '.join(GROUPED)}, {RECALL} FROM facts WHERE target_present GROUP BY {', '.join(GROUPED)}),
b AS (SELECT {', '.join(GROUPED)}, {FALSE} FROM facts WHERE NOT target_present GROUP BY {', '.join(GROUPED)})
SELECT *, 'recall' AS part FROM a UNION ALL BY NAME SELECT *, 'false_positive' AS part FROM b""")
def grouped_metrics(spark, d):
    return metrics.grouped_metrics(_facts(spark, d), GROUPED)


DIMENSIONS = ["subset", "drone_size_px", "gaussian_noise_sigma", "blur_level", "background_type", "distractor_type"]
_FAN = " UNION ALL ".join(f"SELECT facts.*, '{c}' AS dimension, CAST({c} AS VARCHAR) AS level FROM facts" for c in DIMENSIONS)


@query(f"""{FACTS}, fan AS ({_FAN}), a AS (SELECT model_name, iou_threshold, dimension, level, {RECALL} FROM fan WHERE target_present GROUP BY ALL),
b AS (SELECT model_name, iou_threshold, dimension, level, {FALSE} FROM fan WHERE NOT target_present GROUP BY ALL)
SELECT *, 'recall' AS part FROM a UNION ALL BY NAME SELECT *, 'false_positive' AS part FROM b""")
def metrics_by_dimension(spark, d):
    return metrics.robustness(_facts(spark, d), DIMENSIONS)


@query(f"""{FACTS}, g AS (SELECT model_name, iou_threshold, distractor_type, sum(false_positive_image) / count(*) AS rate FROM facts GROUP BY ALL)
SELECT model_name, distractor_type, round(avg(rate), 6) AS false_positive_image_rate FROM g WHERE iou_threshold = 0.25 AND trim(coalesce(distractor_type, '')) <> '' GROUP BY ALL""")
def plotted_false_positives(spark, d):
    rates = metrics.group_false_positives(_facts(spark, d), ["model_name", "iou_threshold", "distractor_type"])
    return metrics.plotted_false_positives(rates, THRESHOLDS[0])


@query(f"{FACTS} SELECT model_name, iou_threshold, drone_size_px, round(avg(detected), 6) AS recall, count(*) AS n_images FROM facts WHERE target_present GROUP BY ALL")
def recall_vs_size(spark, d):
    return metrics.detection_rate(_facts(spark, d), ["model_name", "iou_threshold", "drone_size_px"])


@query(f"{FACTS} SELECT model_name, iou_threshold, blur_level, round(avg(detected), 6) AS recall, count(*) AS n_images FROM facts WHERE target_present GROUP BY ALL")
def recall_by_blur(spark, d):
    return metrics.detection_rate(_facts(spark, d), ["model_name", "iou_threshold", "blur_level"])


@query(f"""{FACTS} SELECT model_name, iou_threshold, drone_size_px, round(avg(CASE WHEN gaussian_noise_sigma = 0 THEN detected END), 6) AS "0",
round(avg(CASE WHEN gaussian_noise_sigma = 10 THEN detected END), 6) AS "10", round(avg(CASE WHEN gaussian_noise_sigma = 20 THEN detected END), 6) AS "20" FROM facts WHERE target_present GROUP BY 1, 2, 3""")
def recall_heatmap_pivot(spark, d):
    return metrics.recall_heatmap(_facts(spark, d), ["model_name", "iou_threshold", "drone_size_px"], "gaussian_noise_sigma", [0, 10, 20])


@query("SELECT model_name, CAST(least(floor(CAST(confidence AS DOUBLE) / (1.0::DOUBLE / 30)), 29) AS INT) AS bin, count(*) AS n FROM fx_pred WHERE confidence BETWEEN 0 AND 1 GROUP BY ALL")
def confidence_histogram(spark, d):
    p = t(spark, d, "fx_pred").withColumn("confidence", F.col("confidence").cast("double"))
    return metrics.histogram(p, "confidence", ["model_name"])


@query(f"""{FACTS}, r AS (SELECT model_name, iou_threshold, subset, {RECALL} FROM facts GROUP BY ALL)
SELECT model_name, iou_threshold, max(CASE WHEN subset = 'synthetic_drone_positive' THEN recall END) AS synthetic_drone_positive,
max(CASE WHEN subset = 'synthetic_drone_plus_distractor' THEN recall END) AS synthetic_drone_plus_distractor FROM r GROUP BY ALL""")
def metrics_pivot_first(spark, d):
    r = metrics.group_recall(_facts(spark, d), ["model_name", "iou_threshold", "subset"])
    return metrics.pivot_first(r, ["model_name", "iou_threshold"], "subset", ["synthetic_drone_positive", "synthetic_drone_plus_distractor"], "recall")


@query(f"""{FACTS}, s AS (SELECT model_name, iou_threshold, subset AS kind_, CAST(sum(tp) AS BIGINT) AS tp, round(avg(best_iou), 6) AS mean_best_iou, count(*) AS prediction_unique_images FROM facts WHERE pred_count > 0 GROUP BY ALL),
n AS (SELECT subset AS kind_, count(*) AS total FROM fx_meta GROUP BY 1)
SELECT model_name, iou_threshold, CASE s.kind_ WHEN 'synthetic_drone_positive' THEN 'positive' WHEN 'synthetic_distractor_only' THEN 'hard_negative' ELSE 'mixed' END AS kind, tp, mean_best_iou, prediction_unique_images, total AS metadata_total_images,
CASE WHEN s.kind_ <> 'synthetic_distractor_only' THEN total END AS n_target, CASE WHEN s.kind_ <> 'synthetic_distractor_only' THEN total - tp END AS fn,
CASE WHEN s.kind_ <> 'synthetic_distractor_only' THEN tp / total END AS recall, CASE WHEN s.kind_ = 'synthetic_distractor_only' THEN prediction_unique_images / total END AS false_positive_rate
FROM s JOIN n ON n.kind_ = s.kind_""")
def denominator_correction(spark, d):
    kind = F.when(F.col("subset") == "synthetic_drone_positive", "positive").when(F.col("subset") == "synthetic_distractor_only", "hard_negative").otherwise("mixed")
    seen = metrics.predicted_only(_facts(spark, d)).groupBy("model_name", "iou_threshold", kind.alias("kind"))
    summary = seen.agg(F.sum("tp").cast("long").alias("tp"), F.round(F.avg("best_iou"), 6).alias("mean_best_iou"), F.count("*").alias("prediction_unique_images"))
    totals = t(spark, d, "fx_meta").groupBy(kind.alias("kind")).agg(F.count("*").alias("metadata_total_images"))
    return metrics.correct_denominators(summary.join(totals, "kind"))


@query("""SELECT m.image_id, m.subset, CAST(coalesce(c.n, 0) AS BIGINT) AS n_predictions FROM fx_meta m LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_pred GROUP BY 1) c ON c.image_id = m.image_id""")
def predictions_per_image(spark, d):
    counts = t(spark, d, "fx_pred").groupBy("image_id").agg(F.count("*").alias("n_predictions"))
    return t(spark, d, "fx_meta").select("image_id", "subset").join(counts, "image_id", "left").na.fill(0, ["n_predictions"])


@query("""WITH g AS (SELECT subset, model_name, iou_threshold FROM (SELECT DISTINCT subset FROM fx_meta) CROSS JOIN (SELECT unnest(['det_a', 'det_b', 'det_c']) AS model_name) CROSS JOIN (SELECT unnest([0.25, 0.5]) :: DOUBLE AS iou_threshold)),
s AS (SELECT subset, count(*) FILTER (WHERE target_present) AS n_target_present, count(*) FILTER (WHERE NOT target_present) AS n_distractor_only FROM fx_meta GROUP BY 1),
p AS (SELECT DISTINCT m.subset, p.model_name FROM fx_pred p JOIN fx_meta m ON m.image_id = p.image_id)
SELECT g.subset, g.model_name, g.iou_threshold, n_target_present, n_distractor_only, 0.0 :: DOUBLE AS recall, 0 :: BIGINT AS tp, n_target_present AS fn, 0.0 :: DOUBLE AS mean_best_iou,
0.0 :: DOUBLE AS false_positive_image_rate, 0 :: BIGINT AS fp_count FROM g JOIN s ON s.subset = g.subset WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.subset = g.subset AND p.model_name = g.model_name)""")
def zero_prediction_models(spark, d):
    return metrics.zero_prediction_rows(t(spark, d, "fx_meta"), t(spark, d, "fx_pred"), [*MODELS, "det_c"], THRESHOLDS)


# Geometry and scalars --------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT *, CASE WHEN x < 0 THEN 0 WHEN x >= image_width THEN image_width - 1 ELSE x END AS x1, CASE WHEN y < 0 THEN 0 WHEN y >= image_height THEN image_height - 1 ELSE y END AS y1 FROM fx_ann)
SELECT image_id, line, l_partkey, l_suppkey, x1 AS cx, y1 AS cy, greatest(0, least(w, image_width - x1)) AS cw, greatest(0, least(h, image_height - y1)) AS ch, least(w, image_width - x1) <= 0 OR least(h, image_height - y1) <= 0 AS gone,
CASE WHEN w <= 0 OR h <= 0 THEN 'non_positive_size' WHEN NOT (x BETWEEN 0 AND image_width - w AND y BETWEEN 0 AND image_height - h) THEN 'outside_image' WHEN w < 40 AND h < 40 THEN 'below_min_bbox_px' END AS problem FROM b""")
def bbox_clip_validate(spark, d):
    a = t(spark, d, "fx_ann")
    b, size = geo.box(), (F.col("image_width"), F.col("image_height"))
    c = geo.clip(b, *size)
    return a.select("image_id", "line", "l_partkey", "l_suppkey", *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cw", "ch"))], geo.clipped_away(c).alias("gone"), geo.problem(b, *size, 40).alias("problem"))


@query("""WITH b AS (SELECT *, least(greatest(x, 0), image_width - 1) AS x1, least(greatest(y, 0), image_height - 1) AS y1 FROM fx_ann)
SELECT image_id, line, l_partkey, l_suppkey, x1 AS cx, y1 AS cy, greatest(1, least(w, image_width - x1)) AS cw, greatest(1, least(h, image_height - y1)) AS ch FROM b""")
def bbox_clamp(spark, d):
    c = geo.clamp(geo.box(), F.col("image_width"), F.col("image_height"))
    return t(spark, d, "fx_ann").select("image_id", "line", "l_partkey", "l_suppkey", *[v.alias(n) for v, n in zip(c, ("cx", "cy", "cw", "ch"))])


@query("""SELECT image_id, line, l_partkey, l_suppkey, printf('%d %d.%06d %d.%06d %d.%06d %d.%06d', line, (((2 * x + w) * 1000000::BIGINT + image_width) // (2 * image_width)) // 1000000, ((((2 * x + w) * 1000000::BIGINT + image_width) // (2 * image_width)) % 1000000 + 1000000) % 1000000, (((2 * y + h) * 1000000::BIGINT + image_height) // (2 * image_height)) // 1000000, ((((2 * y + h) * 1000000::BIGINT + image_height) // (2 * image_height)) % 1000000 + 1000000) % 1000000, (((2 * w) * 1000000::BIGINT + image_width) // (2 * image_width)) // 1000000, ((((2 * w) * 1000000::BIGINT + image_width) // (2 * image_width)) % 1000000 + 1000000) % 1000000, (((2 * h) * 1000000::BIGINT + image_height) // (2 * image_height)) // 1000000, ((((2 * h) * 1000000::BIGINT + image_height) // (2 * image_height)) % 1000000 + 1000000) % 1000000) AS label, x, y, w, h FROM (SELECT * EXCLUDE (x, y, w, h), least(greatest(x, 0), image_width - 1) AS x, least(greatest(y, 0), image_height - 1) AS y, least(w, image_width - least(greatest(x, 0), image_width - 1)) AS w, least(h, image_height - least(greatest(y, 0), image_height - 1)) AS h FROM fx_ann) WHERE w > 0 AND h > 0""")
def yolo_roundtrip(spark, d):
    a = t(spark, d, "fx_ann")
    size = (F.col("image_width"), F.col("image_height"))
    inside = geo.clip(geo.box(), *size)
    lines = a.where(~geo.clipped_away(inside)).select("image_id", "line", "l_partkey", "l_suppkey", *size, geo.yolo_line(F.col("line"), inside, *size).alias("label"))
    n = [F.split("label", " ")[i].cast("double") for i in range(1, 5)]
    back = geo.yolo_to_pixels(*n, *size)
    return lines.select("image_id", "line", "l_partkey", "l_suppkey", "label", *[v.alias(c) for v, c in zip(back, "xywh")])


@query("""WITH p AS (SELECT *, CAST(round_even(w * 0.1::DOUBLE, 0) AS INT) AS px, CAST(round_even(h * 0.1::DOUBLE, 0) AS INT) AS py FROM fx_ann),
b AS (SELECT *, greatest(0, x - px) AS x1, greatest(0, y - py) AS y1, least(image_width, x + w + px) AS x2, least(image_height, y + h + py) AS y2 FROM p)
SELECT image_id, line, l_partkey, l_suppkey, x1 AS ex, y1 AS ey, greatest(1, x2 - x1) AS ew, greatest(1, y2 - y1) AS eh FROM b""")
def bbox_expand(spark, d):
    e = geo.expand(geo.box(), 0.1, F.col("image_width"), F.col("image_height"))
    return t(spark, d, "fx_ann").select("image_id", "line", "l_partkey", "l_suppkey", *[v.alias(n) for v, n in zip(e, ("ex", "ey", "ew", "eh"))])


@query("""WITH b AS (SELECT image_id, drone_size_px * (1 + image_id % 9) AS s FROM fx_meta),
c AS (SELECT *, greatest(4, CAST(ceil(640 * 0.2::DOUBLE - s / 2.0) AS INT)) AS xl, least(636 - s, CAST(floor(640 * 0.8::DOUBLE - s / 2.0) AS INT)) AS xh, greatest(4, CAST(ceil(480 * 0.1::DOUBLE - s / 2.0) AS INT)) AS yl,
  least(476 - s, CAST(floor(480 * 0.55::DOUBLE - s / 2.0) AS INT)) AS yh FROM b)
SELECT image_id, CASE WHEN xl > xh THEN 4 ELSE xl END AS x_min, CASE WHEN xl > xh THEN greatest(4, 636 - s) ELSE xh END AS x_max, CASE WHEN yl > yh THEN 4 ELSE yl END AS y_min,
  CASE WHEN yl > yh THEN greatest(4, least(476 - s, CAST(trunc(480 * 0.55::DOUBLE) AS INT) - s)) ELSE yh END AS y_max FROM c""")
def placement_bounds(spark, d):
    size = F.expr("drone_size_px * (1 + image_id % 9)").cast("int")
    bounds = geo.placement_bounds(size, size, F.lit(640), F.lit(480), (0.2, 0.8), (0.1, 0.55), 4)
    return t(spark, d, "fx_meta").select("image_id", *[c.alias(n) for c, n in zip(bounds, ("x_min", "x_max", "y_min", "y_max"))])


@query("""SELECT image_id, line, l_partkey, l_suppkey, w * h / CAST(image_width * image_height AS DOUBLE) AS area_ratio, greatest(w, h) / CAST(least(image_width, image_height) AS DOUBLE) AS max_dim_ratio,
(y + h / 2) / image_height AS cy, (y + h) / image_height AS bottom, w * h / CAST(image_width * image_height AS DOUBLE) >= 0.10 OR greatest(w, h) / CAST(least(image_width, image_height) AS DOUBLE) >= 0.28 AS large FROM fx_ann""")
def scene_geometry(spark, d):
    f = geo.scene_features(geo.box(), F.col("image_width"), F.col("image_height"))
    return t(spark, d, "fx_ann").select("image_id", "line", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in f.items()])


@query("""WITH p AS (SELECT *, CASE WHEN drone_size_px <= 15 THEN 2 WHEN drone_size_px <= 30 THEN 1 ELSE 0 END + CASE WHEN gaussian_noise_sigma >= 20 THEN 2 WHEN gaussian_noise_sigma >= 10 THEN 1 ELSE 0 END
+ CASE WHEN blur_level <> 'none' THEN 1 ELSE 0 END AS points FROM fx_meta)
SELECT image_id, CASE WHEN drone_size_px >= 60 THEN 'near' WHEN drone_size_px >= 30 THEN 'medium' WHEN drone_size_px >= 15 THEN 'far' ELSE 'very_far' END AS distance_bin,
CASE WHEN points >= 4 THEN 'hard' WHEN points >= 2 THEN 'medium' ELSE 'easy' END AS difficulty FROM p""")
def distance_bin_difficulty(spark, d):
    bins = {"near": 60, "medium": 30, "far": 15, "very_far": 8}
    return t(spark, d, "fx_meta").select(
        "image_id", geo.distance_bin(F.col("drone_size_px"), bins).alias("distance_bin"), geo.difficulty(F.col("drone_size_px"), F.col("gaussian_noise_sigma"), F.col("blur_level"), F.col("subset")).alias("difficulty")
    )


_LABEL = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none') THEN lower(trim({c})) END"
_QA_LABELS = ("qa_final_label", "quality_label", "mask_quality_label")
QA_LABELS_SQL = f"""SELECT doc_id, path, extraction_failed, n_chars, coalesce({', '.join(_LABEL(c) for c in _QA_LABELS)}) AS label,
CASE {' '.join(f"WHEN {_LABEL(c)} IS NOT NULL THEN '{c}'" for c in _QA_LABELS)} END AS label_source FROM fx_qa"""


def _qa(spark, d):
    label, source = sca.qa_label(*_QA_LABELS)
    return t(spark, d, "fx_qa").select("doc_id", "path", "extraction_failed", "n_chars", label.alias("label"), source.alias("label_source"))


@query(f"SELECT doc_id, label, label_source FROM ({QA_LABELS_SQL})")
def qa_label_coalesce(spark, d):
    return _qa(spark, d).select("doc_id", "label", "label_source")


@query(f"SELECT path, min(doc_id) AS doc_id FROM ({QA_LABELS_SQL}) WHERE NOT extraction_failed AND label = 'accept' GROUP BY path")
def approved_assets(spark, d):
    return _qa(spark, d).where("not extraction_failed and label = 'accept'").groupBy("path").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH r AS (SELECT event_id, regexp_replace(regexp_replace(trim(reply), '^```[a-z]*\\s*', ''), '\\s*```$', '') AS j FROM fx_llm),
x AS (SELECT event_id, lower(trim(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.decision') END)) AS word, lower(trim(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.sky') END)) AS sky FROM r),
y AS (SELECT event_id, CASE WHEN word IN ('accept', 'accept_candidate', 'candidate', 'keep', 'approved') THEN 'accept_candidate' WHEN word IN ('review', 'maybe', 'uncertain') THEN 'review'
  WHEN word IN ('reject', 'drop') THEN 'reject' WHEN word = 'error' THEN 'error' ELSE '' END AS decision, CASE WHEN sky IN ('large', 'medium', 'small', 'none') THEN sky ELSE '' END AS sky FROM x),
z AS (SELECT *, CASE WHEN decision = 'reject' AND sky IN ('large', 'medium') THEN 'accept_candidate' WHEN decision = 'reject' AND sky = 'small' THEN 'review' ELSE decision END AS corrected FROM y)
SELECT *, CASE corrected WHEN 'accept_candidate' THEN 'accept' WHEN 'review' THEN 'accept' WHEN 'reject' THEN 'reject' ELSE '' END AS manifest_decision FROM z""")
def vision_triage(spark, d):
    parsed = F.from_json(sca.reply_json(F.col("reply")), "decision string, sky string")
    return rules.vision_triage(t(spark, d, "fx_llm").select("event_id", parsed.alias("p")).select("event_id", "p.decision", "p.sky"))


_WORDS = "CASE event_id % 9 WHEN 0 THEN ' Approved' WHEN 1 THEN 'NO ' WHEN 2 THEN 'y' WHEN 3 THEN 'Keep' WHEN 4 THEN 'drop' WHEN 5 THEN 'nan' WHEN 6 THEN ' N' WHEN 7 THEN 'uncertain' ELSE event_type END"


@query(f"""SELECT event_id, CASE WHEN e IS NULL OR e IN ('', 'nan', 'none') THEN '' WHEN e IN ('accept', 'yes', 'y', 'keep', 'approved') THEN 'accept' WHEN e IN ('reject', 'no', 'n', 'drop', 'rejected') THEN 'reject' ELSE e END AS decision
FROM (SELECT event_id, lower(trim({_WORDS})) AS e FROM events)""")
def decision_normalize(spark, d):
    return t(spark, d, "events").select("event_id", sca.decision(F.expr(_WORDS)).alias("decision"))


_REVIEWED = f"""SELECT event_id, {_WORDS} AS decision, CASE event_id % 4 WHEN 0 THEN 'accept_candidate' WHEN 1 THEN 'reject' WHEN 2 THEN '' ELSE 'Maybe' END AS vision_decision,
CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'cloudy_sky' END AS corrected_category, CASE event_id % 5 WHEN 0 THEN ' ' ELSE 'clear_upper_sky' END AS final_category,
CASE event_id % 10 WHEN 0 THEN '' ELSE 'runway_or_airport' END AS mapped_background_type, event_id % 11 <> 0 AS there FROM events"""


@query(f"""WITH m AS ({_REVIEWED}), e AS (SELECT *, lower(trim(decision)) IN ('accept', 'yes', 'y', 'keep', 'approved') OR lower(trim(vision_decision)) = 'accept_candidate' AS ok,
coalesce(nullif(trim(corrected_category), ''), nullif(trim(final_category), ''), nullif(trim(mapped_background_type), ''), 'uncategorized') AS export_category FROM m)
SELECT event_id, export_category, CASE WHEN NOT ok THEN 'skipped_not_accepted' WHEN there THEN 'exported' ELSE 'missing_source' END AS export_status FROM e""")
def export_accepted(spark, d):
    m = t(spark, d, "events").sparkSession.sql(_REVIEWED.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))
    return rules.export_status(m, F.col("there")).select("event_id", "export_category", "export_status")


@query("SELECT p_partkey, regexp_replace(lower(trim(p_type)), '\\s+', ' ', 'g') AS class_name, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def class_normalize(spark, d):
    return t(spark, d, "part").select("p_partkey", sca.class_name(F.col("p_type")).alias("class_name"), sca.slug(F.col("p_name")).alias("slug"))


@query("SELECT page_id, substr(sha256(concat_ws('|', CAST(page_id AS VARCHAR), url)), 1, 12) AS short_id, concat('img_', lpad(CAST(page_id AS VARCHAR), 6, '0')) AS name FROM pages")
def sha_ids(spark, d):
    return t(spark, d, "pages").select("page_id", sca.short_id(12, F.col("page_id"), F.col("url")).alias("short_id"), F.format_string("img_%06d", F.col("page_id")).alias("name"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN source ELSE concat(source, '_', CAST(n AS VARCHAR)) END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)""")
def safe_ids(spark, d):
    return dedup.numbered_ids(t(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"]).select("doc_id", "unique_id")


@query("SELECT event_id, sequence_key, CAST(row_number() OVER (PARTITION BY sequence_key ORDER BY event_id) AS INT) AS place FROM fx_frames")
def natural_sort(spark, d):
    f = t(spark, d, "fx_frames")
    from pyspark.sql import Window

    order = Window.partitionBy("sequence_key").orderBy(sca.natural_key(F.col("filename")))
    return f.select("event_id", "sequence_key", F.row_number().over(order).alias("place"))


@query("""SELECT event_id, coalesce(TRY_CAST(j AS INT[]), []) AS boxes FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'oops' ELSE concat('[', CAST(event_id % 100 AS VARCHAR), ',', CAST(user_id % 100 AS VARCHAR), ']') END AS j FROM events)""")
def json_lists(spark, d):
    text = F.expr("case when event_id % 5 = 0 then 'oops' else concat('[', event_id % 100, ',', user_id % 100, ']') end")
    return t(spark, d, "events").select("event_id", sca.int_list(text).alias("boxes"))


# Rule cascades ---------------------------------------------------------------------------------------------


def _cascade(name: str, cascade, table: str, keep: str, sql: str, before=(), after=None):
    """Register a cascade; ``before`` are cascades whose outputs it needs, ``after`` the priorities of reasons."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = t(spark, d, table)
        for c in before:
            df = c.apply(df)
        out = cascade.apply(df).select(*keep.split(", "), *cascade.outputs)
        return out if after is None else out.withColumn("priority", rules.priority("reason", *after))

    run.__name__ = name
    query(sql)(run)


_cascade("scene_filter_heuristic", rules.SCENE, "fx_feat", "id", f"SELECT id, disposition, reason, viewpoint FROM ({rule_sql.SCENE})")
_cascade("scene_merge_asset", rules.SCENE_ASSET, "fx_feat", "id, disposition", rule_sql.SCENE_ASSET, (rules.SCENE,))
_cascade("scene_merge_real_eval", rules.SCENE_EVAL, "fx_feat", "id, disposition", rule_sql.SCENE_EVAL, (rules.SCENE,))
_cascade("background_classify", rules.BACKGROUND, "fx_feat", "id", f"SELECT id, type, status, reason FROM ({rule_sql.BACKGROUND})")
_cascade("background_merge_v1", rules.BACKGROUND_V1, "fx_feat", "id, status", rule_sql.BACKGROUND_V1, (rules.BACKGROUND,))
_cascade("coco_strict_decision", rules.COCO_STRICT, "fx_feat", "id", rule_sql.COCO_STRICT, (rules.BACKGROUND,))
_cascade("coco_permissive_decision", rules.COCO_PERMISSIVE, "fx_feat", "id", rule_sql.COCO_PERMISSIVE, (rules.BACKGROUND,))
_cascade("hard_negative_filter", rules.HARD_NEGATIVE, "fx_hard", "id, cls", rule_sql.HARD_NEGATIVE, (rules.HARD_NEGATIVE_BASE,), (rules.HARD_PRIORITY, 20))
_cascade("distractor_semantic", rules.DISTRACTOR, "fx_asset", "id, cls", rule_sql.DISTRACTOR, (), (rules.DISTRACTOR_PRIORITY, 0))


@query(rule_sql.PLACES)
def places_light_filter(spark, d):
    f = t(spark, d, "fx_feat").selectExpr("id", "u", "width + 300 as width", "height + 300 as height", "case when id % 4 = 0 then 'runway' else 'sky' end as mapped")
    return rules.PLACES.apply(f).select("id", "status", "reason")


@query(rule_sql.OVERLAY)
def background_qa_overlay(spark, d):
    return rules.overlay(rules.BACKGROUND.apply(t(spark, d, "fx_feat"))).select("id", "status", "qa_status", "qa_reasons", "background_category")


@query(rule_sql.MASK)
def mask_qa(spark, d):
    return rules.mask_quality(t(spark, d, "fx_asset")).select("id", "reasons", "label", "score")


@query(rule_sql.SEGMENT)
def seg_mask_qa(spark, d):
    return rules.segment_quality(t(spark, d, "fx_asset")).select("id", "reasons", "label")


@query(f"SELECT id, auto_label, auto_reasons FROM ({rule_sql.ASSET})")
def asset_qa(spark, d):
    return rules.asset_quality(t(spark, d, "fx_asset")).select("id", "auto_label", "auto_reasons")


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(no, ';')) AS reason FROM ({rule_sql.ASSET})) WHERE reason <> '' GROUP BY 1")
def asset_reject_reasons(spark, d):
    q = rules.asset_quality(t(spark, d, "fx_asset")).select(F.when(F.col("auto_label") == "reject", F.col("auto_reasons")).alias("why"))
    return metrics.reason_counts(q, "why")


@query("""SELECT id FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'manual' ELSE 'coco_segmentation_mask' END AS how, CASE id % 4 WHEN 0 THEN 'no' ELSE 'True' END AS alpha, failed, area, label FROM fx_asset)
WHERE how = 'coco_segmentation_mask' AND alpha = 'True' AND NOT failed AND area > 0 AND label IN ('accept', 'review')""")
def technical_candidates(spark, d):
    a = t(spark, d, "fx_asset").selectExpr(
        "id", "case id % 5 when 0 then 'manual' else 'coco_segmentation_mask' end as extraction_method", "case id % 4 when 0 then 'no' else 'True' end as has_alpha", "failed as extraction_failed",
        "area as mask_area_px", "label as mask_quality_label",
    )
    return rules.technical_candidates(a).select("id")


@query("""WITH s AS (SELECT id, k, comps, area, r, expand, centre, inverted, CASE WHEN area = 0 THEN -1.0 ELSE 1.0::DOUBLE - CASE WHEN r > 0.60 THEN 0.55::DOUBLE WHEN r > 0.45 THEN 0.20::DOUBLE WHEN r < 0.02 THEN 0.50::DOUBLE ELSE 0.0::DOUBLE END
- CASE WHEN k >= 3 THEN 0.35::DOUBLE WHEN k = 2 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN expand > 2.5 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
+ CASE WHEN centre < 0.25 THEN -0.30::DOUBLE ELSE 0.15::DOUBLE * centre END + 0.10::DOUBLE * (1.0::DOUBLE - abs(r - 0.25::DOUBLE)) - CASE WHEN inverted THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM fx_asset),
z AS (SELECT id, id // 3 AS image, round(CAST(score AS DOUBLE), 6) AS score, area > 0 AND r >= 0.02 AND r <= 0.60 AND k < 3 AND centre >= 0.35 AS may_invert FROM s)
SELECT image, id, score, may_invert FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS rk FROM z) WHERE rk = 1""")
def best_mask(spark, d):
    scored = rules.mask_candidate_score(t(spark, d, "fx_asset")).withColumn("image", F.expr("id div 3"))
    return selection.best_by(scored, "image", F.col("score"), ["id"]).select("image", "id", "score", "may_invert")


# Annotations -----------------------------------------------------------------------------------------------

_LINE_SQL = """WITH p AS (SELECT *, string_split(trim(line_text), ' ') AS tk FROM fx_label_text WHERE trim(line_text) <> '' AND NOT starts_with(line_text, '#')),
c AS (SELECT *, CAST(trunc(TRY_CAST(tk[1] AS DOUBLE)) AS INT) AS cls, TRY_CAST(tk[2] AS DOUBLE) AS a, TRY_CAST(tk[3] AS DOUBLE) AS b, TRY_CAST(tk[4] AS DOUBLE) AS e, TRY_CAST(tk[5] AS DOUBLE) AS f FROM p),
v AS (SELECT *, CAST(round_even((a - e / 2) * 640, 0) AS INT) AS rx, CAST(round_even((b - f / 2) * 480, 0) AS INT) AS ry, CAST(round_even(e * 640, 0) AS INT) AS rw, CAST(round_even(f * 480, 0) AS INT) AS rh FROM c),
o AS (SELECT *, greatest(0, least(rx, 639)) AS x, greatest(0, least(ry, 479)) AS y FROM v), k AS (SELECT *, least(rw, 640 - x) AS w, least(rh, 480 - y) AS h FROM o),
r AS (SELECT *, CASE WHEN len(tk) < 5 THEN 'malformed_label_line' WHEN (cls + a + b + e + f) IS NULL THEN 'parse_error' WHEN cls > 2 OR cls < 0 THEN 'class_id_not_exported' WHEN least(w, h) <= 0 THEN 'clip_failed'
  WHEN w < 30 AND h < 30 THEN 'below_min_bbox_px' END AS reason FROM k)"""


@query(f"{_LINE_SQL} SELECT coalesce(reason, 'exported') AS reason, count(*) AS n FROM r GROUP BY 1")
def annotation_filter_reasons(spark, d):
    return annotations.label_lines(t(spark, d, "fx_label_text")).groupBy(F.coalesce("reason", F.lit("exported")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{_LINE_SQL} SELECT image_id, cls, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area FROM r WHERE reason IS NULL GROUP BY ALL")
def annotation_export(spark, d):
    return annotations.label_lines(t(spark, d, "fx_label_text")).where("reason is null").groupBy("image_id", "cls").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).cast("long").alias("area"))


_BOXES = """SELECT category, iscrowd, x + 0.25 AS x, y + 0.25 AS y, CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE w + 0.5 END AS w, h + 0.5 AS h, CASE WHEN image_id % 23 = 0 THEN NULL ELSE image_width END AS image_width,
CASE WHEN image_id % 19 = 0 THEN 0 ELSE image_height END AS image_height, image_id % 17 <> 0 AS there FROM fx_ann"""


_WANTED = tuple(f"Brand#{i}" for i in range(1, 16))


@query(f"""WITH a AS ({_BOXES}) SELECT CASE WHEN category NOT IN {_WANTED} THEN 'category_not_requested' WHEN iscrowd THEN 'iscrowd' WHEN w IS NULL OR w <= 0 OR h <= 0 THEN 'invalid_bbox' WHEN w < 40 AND h < 40 THEN 'bbox_too_small'
WHEN w > 150 OR h > 150 THEN 'bbox_too_large' WHEN image_width IS NULL OR NOT there THEN 'image_missing' WHEN image_height = 0 THEN 'other' WHEN least(x, y) < 0 OR x + w - image_width > 0.5 OR y + h - image_height > 0.5 THEN 'invalid_bbox' ELSE 'exported' END AS reason,
count(*) AS n FROM a GROUP BY 1""")
def coco_filter_reasons(spark, d):
    boxes = spark.sql(_BOXES.replace("FROM fx_ann", "FROM {a}"), a=t(spark, d, "fx_ann"))
    return annotations.coco_boxes(boxes, _WANTED, 40, 150).groupBy(F.coalesce("reason", F.lit("exported")).alias("reason")).agg(F.count("*").alias("n"))


_GROUPS = {"person": ["Brand#11", "Brand#12"], "food": ["Brand#21", "Brand#22"], "vehicle": ["Brand#31", "Brand#32", "Brand#33"]}


def _group_sql() -> str:
    cols = []
    for n, members in _GROUPS.items():
        m = ", ".join(f"'{x}'" for x in members)
        cols.append(f"round(sum(CASE WHEN category IN ({m}) THEN total ELSE 0.0 END), 6) AS {n}_sum, round(max(CASE WHEN category IN ({m}) THEN most ELSE 0.0 END), 6) AS {n}_max, round(max(CASE WHEN category IN ({m}) THEN total ELSE 0.0 END), 6) AS {n}_top")
    return ", ".join(cols)


@query(f"""WITH p AS (SELECT image_id, category, sum(area / CAST(image_width * image_height AS DOUBLE)) AS total, max(area / CAST(image_width * image_height AS DOUBLE)) AS most FROM fx_ann GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(total, 9) DESC, category) AS rk FROM p)
SELECT image_id, round(max(most), 6) AS largest, {_group_sql()}, coalesce(string_agg(category, ',' ORDER BY rk) FILTER (WHERE rk <= 5 AND total > 0.01), '') AS leading FROM k GROUP BY image_id""")
def coco_scene_stats(spark, d):
    return metrics.scene_statistics(t(spark, d, "fx_ann"), _GROUPS)


@query("""SELECT image_id, arg_max(class_name, (area, -line, -l_partkey, -l_suppkey)) AS largest_class, array_to_string(list_sort(list(DISTINCT class_name)), ',') AS classes, count(*) AS n,
CAST(bool_and(greatest(w, h) < 60) AS INT) AS all_small FROM fx_ann GROUP BY image_id""")
def hard_negative_candidates(spark, d):
    return metrics.image_candidates(t(spark, d, "fx_ann"), 60)


# Selection, split, design ----------------------------------------------------------------------------------

_H = lambda seed, c: f"sha256(concat_ws('|', '{seed}', CAST({c} AS VARCHAR)))"


@query("""SELECT p_partkey, CASE WHEN p_retailprice < 1200 THEN 'low_score' WHEN row_number() OVER (PARTITION BY p_brand, p_retailprice >= 1200 ORDER BY p_retailprice DESC, p_size DESC, p_partkey) <= 5 THEN 'selected_top_k' ELSE 'below_top_k' END AS selection FROM part""")
def topk_per_category(spark, d):
    return selection.top_k(t(spark, d, "part"), "p_brand", "p_retailprice", [F.col("p_size").desc(), F.col("p_partkey")], 5, 1200.0).select("p_partkey", "selection")


_CAPS = {"Brand#11": 40, "Brand#12": 7, "Brand#13": 1, "Brand#14": 100000}


@query(f"""WITH c(p_brand, cap) AS (VALUES {', '.join(f"('{m}', {n})" for m, n in _CAPS.items())}),
a AS (SELECT p_partkey, part.p_brand, cap, row_number() OVER (PARTITION BY part.p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) <= greatest(1, (cap + 1) // 2) AS head FROM part JOIN c ON c.p_brand = part.p_brand),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, head ORDER BY {_H(11, 'p_partkey')}, p_partkey) AS dr FROM a) SELECT p_partkey, p_brand FROM b WHERE head OR dr <= cap - greatest(1, (cap + 1) // 2)""")
def capped_select(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return selection.capped(p, "p_brand", _CAPS, [F.col("p_size").desc(), F.col("p_retailprice")], 11, "p_partkey").select("p_partkey", "p_brand")


@query(f"""WITH a AS (SELECT p_partkey, p_brand, p_size, CASE p_brand WHEN 'Brand#11' THEN 34 WHEN 'Brand#12' THEN 33 WHEN 'Brand#13' THEN 33 END AS cap FROM part WHERE p_size > 47 OR p_brand <> 'Brand#11'),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= (cap + 1) // 2 AS head FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, head ORDER BY {_H(12, 'p_partkey')}, p_partkey) AS dr FROM b), k AS (SELECT * FROM c WHERE cap IS NOT NULL AND (head OR dr <= cap - (cap + 1) // 2)),
r AS (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rk FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM k))
SELECT p_partkey, p_brand FROM k UNION ALL SELECT p_partkey, p_brand FROM r WHERE rk <= 100 - (SELECT count(*) FROM k)""")
def balanced_top_up(spark, d):
    p = t(spark, d, "part").where("p_size > 47 or p_brand <> 'Brand#11'").select("p_partkey", "p_brand", "p_size")
    return selection.balanced_top_up(p, "p_brand", ["Brand#11", "Brand#12", "Brand#13"], 100, "p_size", 12, "p_partkey").select("p_partkey", "p_brand")


@query("""WITH i AS (SELECT image_id, CASE image_id % 4 WHEN 0 THEN 'bird' WHEN 1 THEN 'airplane' WHEN 2 THEN 'drone' ELSE 'kite' END AS kind FROM fx_meta),
p AS (SELECT image_id, pi, CASE pi % 3 WHEN 0 THEN 14 WHEN 1 THEN 4 ELSE 0 END AS c, CAST(confidence AS DOUBLE) AS confidence, x, y, w, h FROM fx_pred),
s AS (SELECT p.*, i.kind, confidence * sqrt(w * h) * (1.0::DOUBLE - 0.35::DOUBLE * (abs((x + (x + w)) / 2.0::DOUBLE - 320) / 640 + abs((y + (y + h)) / 2.0::DOUBLE - 240) / 480)) AS score FROM p JOIN i ON i.image_id = p.image_id
  WHERE kind = 'drone' OR (kind = 'bird' AND c = 14) OR (kind = 'airplane' AND c = 4)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pi) AS rk FROM s) WHERE rk = 1)
SELECT i.image_id, CASE WHEN b.image_id IS NULL THEN 'center_heuristic' WHEN i.kind = 'drone' THEN 'largest_detection_fallback' ELSE 'yolo_' || i.kind END AS method, coalesce(b.confidence, 0.0) AS confidence,
  CAST(CASE WHEN b.image_id IS NULL THEN 89 ELSE greatest(0, least(b.x, 639)) END AS INT) AS x, CAST(CASE WHEN b.image_id IS NULL THEN 67 ELSE greatest(0, least(b.y, 479)) END AS INT) AS y,
  CAST(CASE WHEN b.image_id IS NULL THEN 461 ELSE greatest(1, least(b.w, 640 - greatest(0, least(b.x, 639)))) END AS INT) AS w, CAST(CASE WHEN b.image_id IS NULL THEN 346 ELSE greatest(1, least(b.h, 480 - greatest(0, least(b.y, 479)))) END AS INT) AS h
FROM i LEFT JOIN b ON b.image_id = i.image_id""")
def box_proposals(spark, d):
    images = t(spark, d, "fx_meta").selectExpr("image_id", "case image_id % 4 when 0 then 'bird' when 1 then 'airplane' when 2 then 'drone' else 'kite' end as asset_type", "640 as width", "480 as height")
    found = t(spark, d, "fx_pred").selectExpr("image_id", "pi", "case pi % 3 when 0 then 14 when 1 then 4 else 0 end as class_id", "cast(confidence as double) as confidence", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    return packs.propose(images, found)


@query("SELECT id, label, CAST(CASE WHEN label = 'accept' THEN 0 WHEN label = 'review' THEN 1 WHEN label = 'reject' THEN 2 ELSE 3 END AS INT) AS label_rank FROM fx_asset")
def label_order(spark, d):
    return packs.by_label(t(spark, d, "fx_asset").select("id", "label"), "label", "id")


@query(f"""WITH a AS (SELECT p_partkey, p_brand, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 4 THEN 'head' ELSE 'tail' END AS part FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, part ORDER BY {_H(42, 'p_partkey')}, p_partkey) AS dr FROM a) SELECT p_partkey, p_brand, part FROM b WHERE part = 'head' OR dr <= 3""")
def quota_select(spark, d):
    return selection.quota(t(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.col("p_retailprice").desc()], 7, 42, "p_partkey").select("p_partkey", "p_brand", "part")


@query(f"""WITH a AS (SELECT o_orderkey, o_orderpriority AS grp, o_custkey % 50 AS image, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) = 1 AS best FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY best DESC, CASE WHEN best THEN '' ELSE {_H(7, 'o_orderkey')} END, o_totalprice DESC, o_orderkey) AS turn FROM a) SELECT o_orderkey, grp, image, best AS best_of_image FROM b WHERE turn <= 70""")
def diverse_select(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.expr("o_custkey % 50").alias("image"), "o_totalprice")
    return selection.diverse(o, "grp", "image", [F.col("o_totalprice").desc()], 70, 7, "o_orderkey").drop("o_totalprice")


@query(f"SELECT image_id, target_present FROM (SELECT image_id, target_present, row_number() OVER (PARTITION BY target_present ORDER BY {_H(3, 'image_id')}, image_id) AS rk FROM fx_meta) WHERE rk <= 50")
def balanced_sample(spark, d):
    return selection.balanced(t(spark, d, "fx_meta").select("image_id", "target_present"), "target_present", 100, 3, "image_id")


@query(f"SELECT image_id FROM fx_meta ORDER BY {_H(9, 'image_id')}, image_id LIMIT 60")
def seeded_sample(spark, d):
    return selection.sample(t(spark, d, "fx_meta").select("image_id"), 60, 9, "image_id")


@query("""WITH s AS (SELECT image_id, pi, CAST(confidence AS DOUBLE) * sqrt(w * h) * (1.0::DOUBLE - 0.35::DOUBLE * (abs(x + w / 2 - 320) / 640 + abs(y + h / 2 - 240) / 480)) AS score FROM fx_pred)
SELECT image_id, pi, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pi) AS rk FROM s) WHERE rk = 1""")
def best_detection(spark, d):
    cx, cy = geo.centre(geo.box())
    score = selection.detection_score(F.col("confidence").cast("double"), F.col("w"), F.col("h"), cx, cy, F.lit(640), F.lit(480))
    return selection.best_by(t(spark, d, "fx_pred"), "image_id", score, ["pi"]).select("image_id", "pi", "score")


@query("SELECT event_id, sequence_key FROM (SELECT event_id, sequence_key, row_number() OVER (PARTITION BY sequence_key ORDER BY ts, event_id) AS n FROM fx_frames) WHERE (n - 1) % 5 = 0")
def temporal_stride(spark, d):
    return selection.stride(t(spark, d, "fx_frames"), "sequence_key", ["ts", "event_id"], 5).select("event_id", "sequence_key")


@query("SELECT doc_id, source, CAST(floor(n / 12) AS INT) AS page, CAST(n % 12 AS INT) AS tile FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def tile_pages(spark, d):
    return selection.pages(t(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 12, "source")


def _split_sql(whole: str) -> str:
    return f"""WITH s AS (SELECT image_id, subset, count(*) OVER (PARTITION BY subset) AS n, row_number() OVER (PARTITION BY subset ORDER BY {_H(42, 'image_id')}, image_id) AS rk FROM fx_meta),
split_ AS (SELECT image_id, subset, CASE WHEN rk <= {whole.format('n * 0.7::DOUBLE')} THEN 'train' WHEN rk <= {whole.format('n * 0.7::DOUBLE')} + {whole.format('n * 0.15::DOUBLE')} THEN 'val' ELSE 'test' END AS split FROM s)"""


def _split(spark, d, rounded=False):
    return selection.stratified_split(t(spark, d, "fx_meta").select("image_id", "subset"), "subset", "image_id", 42, rounded=rounded)


@query(_split_sql("floor({})") + " SELECT * FROM split_")
def stratified_split(spark, d):
    return _split(spark, d)


@query(_split_sql("round_even({}, 0)") + " SELECT * FROM split_")
def stratified_split_rounded(spark, d):
    return _split(spark, d, True)


@query(_split_sql("floor({})") + """ SELECT subset, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM split_ GROUP BY 1""")
def split_crosstab(spark, d):
    return metrics.crosstab(_split(spark, d), "subset", "split", ["train", "val", "test"])


@query(_split_sql("floor({})") + " SELECT image_id, subset FROM split_ WHERE split = 'test' AND subset = 'synthetic_distractor_only'")
def eval_subsets(spark, d):
    return _split(spark, d).where("split = 'test' and subset = 'synthetic_distractor_only'").select("image_id", "subset")


_AXES = {"size_px": [8, 15, 30, 60], "noise": [0, 10, 20], "blur": ["none", "mild"], "contrast": ["low", "normal"]}


def _design_sql(columns: str, ranks: str) -> str:
    """Every image of the table has a place in the design, so its size is the table's."""
    return f"WITH n AS (SELECT count(*) AS n FROM orders), g AS (SELECT o_orderkey AS id, {ranks} FROM orders) SELECT id, {columns} FROM g CROSS JOIN n"


def _level_sql(rank: str, values: list) -> str:
    """The level at a place when n places are dealt out evenly: the first n mod k levels get one more."""
    k = len(values)
    level = f"CASE WHEN {rank} < (n % {k}) * (n // {k} + 1) THEN {rank} // (n // {k} + 1) ELSE (n % {k}) + ({rank} - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END"
    return f"([{', '.join(repr(v) for v in values)}])[CAST({level} AS INT) + 1]"


_RANKS = ", ".join(f"row_number() OVER (ORDER BY {_H(42 + i, 'o_orderkey')}, o_orderkey) - 1 AS r{i}" for i in range(len(_AXES)))


@query(_design_sql(", ".join(f"{_level_sql(f'r{i}', v)} AS {n}" for i, (n, v) in enumerate(_AXES.items())), _RANKS))
def balanced_schedule(spark, d):
    ids = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return selection.balanced_schedule(ids, "id", ids.count(), _AXES, 42)


@query(_design_sql("""CASE WHEN r0 < CAST(trunc(n * 0.3::DOUBLE) AS BIGINT) + CASE WHEN n - 2 * CAST(trunc(n * 0.3::DOUBLE) AS BIGINT) - CAST(trunc(n * 0.4::DOUBLE) AS BIGINT) > 0 THEN 1 ELSE 0 END THEN 'positive'
WHEN r0 < 2 * CAST(trunc(n * 0.3::DOUBLE) AS BIGINT) + least(2, n - 2 * CAST(trunc(n * 0.3::DOUBLE) AS BIGINT) - CAST(trunc(n * 0.4::DOUBLE) AS BIGINT)) THEN 'negative' ELSE 'mixed' END AS subset""", f"row_number() OVER (ORDER BY {_H(5, 'o_orderkey')}, o_orderkey) - 1 AS r0"))
def subset_assignment(spark, d):
    ids = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return selection.assign_by_ratio(ids, "id", ids.count(), {"positive": 0.3, "negative": 0.3, "mixed": 0.4}, 5)


_PICK = lambda seed, what, n: f"CAST(('0x' || substr(sha256(concat_ws('|', '{seed}', CAST(id AS VARCHAR), '{what}')), 1, 8)) AS BIGINT) % {n}"


@query(f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier),
x AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
g AS (SELECT id, {_PICK(42, 'bg', '(SELECT count(*) FROM part)')} AS bk, {_PICK(42, 'asset', '(SELECT count(*) FROM supplier)')} AS ak, {_PICK(42, 'size', 4)} AS zk, {_PICK(42, 'noise', 3)} AS nk FROM x)
SELECT id, concat('img_', lpad(CAST(id AS VARCHAR), CAST(greatest(6, len(CAST(id AS VARCHAR))) AS INT), '0')) AS image_id, p_partkey AS background_id, s_suppkey AS asset_id, ([8, 15, 30, 60])[zk + 1] AS drone_size_px, ([0, 10, 20])[nk + 1] AS noise_sigma
FROM g JOIN p ON p.k = bk JOIN s ON s.k = ak""")
def generation_plan(spark, d):
    pools = {"bg": ("part", "p_partkey", "background_id"), "asset": ("supplier", "s_suppkey", "asset_id")}
    ids = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    plan = ids.withColumn("image_id", F.concat(F.lit("img_"), F.lpad(F.col("id").cast("string"), F.greatest(F.lit(6), F.length(F.col("id").cast("string"))), "0")))
    for what, (name, key, out) in pools.items():
        pool = selection.ranked(t(spark, d, name).select(F.col(key).alias(out)), [], [out], "k_")
        # One number; the pool itself is joined by its place.
        size = F.broadcast(pool.agg(F.count("*").alias("n_" + what)))
        plan = plan.crossJoin(size).withColumn("k_" + what, selection.pick(42, "id", what, F.col("n_" + what)) + 1).join(pool.withColumnRenamed("k_", "k_" + what), "k_" + what)
    sizes, noise = F.array(*[F.lit(x) for x in (8, 15, 30, 60)]), F.array(*[F.lit(x) for x in (0, 10, 20)])
    level = lambda levels, what, n: F.element_at(levels, (selection.pick(42, "id", what, n) + 1).cast("int"))
    return plan.select("id", "image_id", "background_id", "asset_id", level(sizes, "size", 4).alias("drone_size_px"), level(noise, "noise", 3).alias("noise_sigma"))


@query(f"""WITH a AS (SELECT image_id AS id, drone_size_px AS w, gx, gy, unnest(generate_series(1, 50)) AS attempt FROM fx_meta),
b AS (SELECT *, CAST(('0x' || substr(sha256(concat_ws('|', '8', CAST(id AS VARCHAR), CAST(attempt AS VARCHAR), 'x')), 1, 8)) AS BIGINT) % 561 AS px, CAST(('0x' || substr(sha256(concat_ws('|', '8', CAST(id AS VARCHAR), CAST(attempt AS VARCHAR), 'y')), 1, 8)) AS BIGINT) % 321 AS py FROM a),
c AS (SELECT *, greatest(0, least(px + w, gx + 60) - greatest(px, gx)) * greatest(0, least(py + w, gy + 60) - greatest(py, gy)) AS i FROM b),
e AS (SELECT *, i / CAST(w * w + 3600 - i AS DOUBLE) <= 0.05 AND sqrt((px + w / 2 - gx - 30) * (px + w / 2 - gx - 30) + (py + w / 2 - gy - 30) * (py + w / 2 - gy - 30)) >= 20 AS good FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY good DESC, CASE WHEN good THEN attempt ELSE -attempt END) AS rk FROM e)
SELECT id AS image_id, CAST(attempt AS INT) AS attempt, px, py FROM f WHERE rk = 1""")
def placement_sampling(spark, d):
    m = t(spark, d, "fx_meta").withColumn("s", F.lit(60))
    return selection.rejection_placement(m, "image_id", 8, (0, 560), (0, 320), "drone_size_px", ("gx", "gy", "s", "s"))


@query("SELECT s_suppkey, copy FROM (SELECT s_suppkey, unnest(generate_series(0, s_suppkey % 4 - 1)) AS copy FROM supplier)")
def schedule_expansion(spark, d):
    return selection.expand_counts(t(spark, d, "supplier").withColumn("n", F.expr("s_suppkey % 4")), "n").select("s_suppkey", "copy")


# Summaries -------------------------------------------------------------------------------------------------

_SUMMARY = ["subset", "distractor_type", "blur_level", "background_type"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM fx_meta GROUP BY {c}" for c in _SUMMARY))
def dataset_summary(spark, d):
    return metrics.value_counts(t(spark, d, "fx_meta"), _SUMMARY)


@query("SELECT category, min(greatest(w, h)) AS least, round(median(greatest(w, h)), 6) AS median, max(greatest(w, h)) AS greatest, round(avg(greatest(w, h)), 6) AS mean FROM fx_ann GROUP BY 1")
def report_min_med_max(spark, d):
    return metrics.spread(t(spark, d, "fx_ann"), F.greatest("w", "h"), ["category"])


@query(f"SELECT disposition AS before, final_disposition AS after, count(*) AS n FROM ({rule_sql.SCENE_ASSET}) GROUP BY ALL")
def transition_counts(spark, d):
    return metrics.transitions(rules.SCENE_ASSET.apply(rules.SCENE.apply(t(spark, d, "fx_feat"))), "disposition", "final_disposition")


# Near-duplicates and scorers -------------------------------------------------------------------------------

_HASH = "SELECT vec_id, label, (SELECT sum(CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END) FROM range(64) r(i)) AS h FROM embeddings"


def _hashes(spark, d):
    """The signs of the 64 dimensions as a signed long."""
    e = t(spark, d, "embeddings")
    h = F.expr("aggregate(sequence(0, 63), 0L, (a, i) -> a | if(embedding[i] > 0, shiftleft(1L, i), 0L))")
    return e.select("vec_id", "label", h.alias("h"))


_D = "bit_count(CAST(xor(a.h, b.h) % 4294967296 AS BIGINT)) + bit_count(CAST(xor(a.h, b.h) // 4294967296 AS BIGINT))"


@query(f"WITH e AS ({_HASH}) SELECT a.vec_id AS a, b.vec_id AS b, CAST({_D} AS INT) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_D} <= 16")
def phash_pairs(spark, d):
    return dedup.near_pairs(_hashes(spark, d), "vec_id", "h", 16)


def _first_fit_sql(within: str) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, h, CAST(row_number() OVER (ORDER BY vec_id) AS INT) AS n FROM ({_HASH})),
p AS MATERIALIZED (SELECT b.n AS n, list(a.n) AS before FROM e a JOIN e b ON a.vec_id < b.vec_id {within} AND {_D} <= 16 GROUP BY b.n),
w AS (SELECT 0 AS n, CAST([] AS INT[]) AS reps UNION ALL SELECT w.n + 1, CASE WHEN len(list_intersect(coalesce(p.before, []), w.reps)) = 0 THEN list_append(w.reps, w.n + 1) ELSE w.reps END FROM w LEFT JOIN p ON p.n = w.n + 1 WHERE w.n < (SELECT max(n) FROM e)),
r AS (SELECT reps FROM w ORDER BY n DESC LIMIT 1)
SELECT e.vec_id, coalesce((SELECT f.vec_id FROM e f WHERE f.n = list_min(list_intersect(p.before, r.reps))), e.vec_id) AS representative FROM e LEFT JOIN p ON p.n = e.n CROSS JOIN r"""


@query(_first_fit_sql(""))
def phash_dedup_global(spark, d):
    return dedup.first_fit(_hashes(spark, d), "vec_id", "h", 16)


@query(_first_fit_sql("AND a.label = b.label"))
def phash_dedup_by_type(spark, d):
    return dedup.first_fit(_hashes(spark, d), "vec_id", "h", 16, "label")


_COS = "list_sum(list_transform(list_zip(i.embedding, p.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _prompt_scores(spark, d):
    """Cosines of images with the eight prompts, which are a bounded table."""
    e = t(spark, d, "embeddings")
    prompts = e.where("vec_id < 8").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("pe"))
    dot = F.expr("aggregate(zip_with(embedding, pe, (x, y) -> double(x) * double(y)), 0D, (a, x) -> a + x)")
    return e.where("vec_id >= 8").crossJoin(F.broadcast(prompts)).select("vec_id", "prompt", F.expr("concat('group_', prompt % 4)").alias("grp"), F.round(dot, 6).alias("s"))


_SCORES = f"WITH s AS (SELECT i.vec_id, p.vec_id AS prompt, concat('group_', CAST(p.vec_id % 4 AS VARCHAR)) AS grp, round({_COS}, 6) AS s FROM embeddings i JOIN embeddings p ON p.vec_id < 8 AND i.vec_id >= 8)"


@query(f"""{_SCORES}, b AS (SELECT vec_id, grp, max(s) AS s, arg_max(prompt, (s, -prompt)) AS prompt FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, grp) AS rk FROM b)
SELECT a.vec_id, a.grp AS first_group, round(a.s, 6) AS first_score, a.prompt AS first_prompt, c.grp AS second_group, round(c.s, 6) AS second_score, c.prompt AS second_prompt, round(a.s - c.s, 6) AS margin FROM r a JOIN r c ON c.vec_id = a.vec_id AND a.rk = 1 AND c.rk = 2""")
def clip_group_scores(spark, d):
    return metrics.group_scores(_prompt_scores(spark, d), "vec_id", "grp", "s", "prompt")


@query(f"{_SCORES} SELECT vec_id, round(max(CASE WHEN prompt < 4 THEN s END) - max(CASE WHEN prompt >= 4 THEN s END), 6) AS suitability FROM s GROUP BY 1")
def clip_suitability(spark, d):
    s = _prompt_scores(spark, d)
    pick = lambda c: F.max(F.when(F.expr(c), F.col("s")))
    return s.groupBy("vec_id").agg(F.round(pick("prompt < 4") - pick("prompt >= 4"), 6).alias("suitability"))


@query("SELECT source, lang, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def last_of_source(spark, d):
    return dedup.keep_last(t(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])


@query("SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup_keep_last(spark, d):
    return dedup.keep_last(t(spark, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


# Joins and validation --------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def keep_list_join(spark, d):
    ids = t(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"))
    return relations.kept(t(spark, d, "documents").select("doc_id", "source"), ids, "doc_id")


@query("SELECT item_id * 60 AS doc_id FROM benchmark WHERE item_id * 60 NOT IN (SELECT doc_id FROM documents)")
def keep_list_missing(spark, d):
    ids = t(spark, d, "benchmark").select((F.col("item_id") * 60).alias("doc_id"))
    return relations.missing(ids, t(spark, d, "documents").select("doc_id"), "doc_id")


@query("""SELECT p.page_id, coalesce(a.quality, b.quality, c.quality) AS quality FROM pages p LEFT JOIN labels a ON a.doc_id = p.page_id LEFT JOIN labels b ON b.doc_id = p.page_id + 100 LEFT JOIN labels c ON c.doc_id = p.page_id + 200""")
def metadata_lookup_fallback(spark, d):
    known = t(spark, d, "labels").select("doc_id", "quality")
    keys = [F.col("page_id") + k for k in (0, 100, 200)]
    return relations.fallback_join(t(spark, d, "pages").select("page_id"), [(k, known, "doc_id") for k in keys], "quality", "quality")


@query(f"""SELECT n.doc_id, CASE WHEN o.qa_final_label IS NOT NULL AND trim(o.qa_final_label) <> '' THEN o.qa_final_label ELSE n.qa_final_label END AS qa_final_label FROM (SELECT doc_id, 'auto' AS qa_final_label FROM documents) n LEFT JOIN (SELECT doc_id, qa_final_label FROM fx_qa WHERE doc_id % 2 = 0) o ON o.doc_id = n.doc_id""")
def qa_upsert(spark, d):
    new = t(spark, d, "documents").select("doc_id", F.lit("auto").alias("qa_final_label"))
    old = t(spark, d, "fx_qa").where("doc_id % 2 = 0").select("doc_id", "qa_final_label")
    return relations.upsert(new, old, "doc_id", ["qa_final_label"])


_CHECKS = {"no_label": ("warning", "label is null"), "not_accepted": ("error", "label is not null and label <> 'accept'"), "extraction_failed": ("error", "extraction_failed"), "short": ("warning", "n_chars < 100")}


@query(f"""WITH x AS MATERIALIZED ({QA_LABELS_SQL}) {' UNION ALL '.join(f"SELECT '{n}' AS check, '{lv}' AS level, count(*) FILTER (WHERE {c}) AS n FROM x" for n, (lv, c) in _CHECKS.items())}
UNION ALL SELECT 'duplicate_path', 'error', coalesce(CAST(sum(c) AS BIGINT), 0) FROM (SELECT count(*) AS c FROM x GROUP BY path HAVING count(*) > 1)""")
def pack_validation(spark, d):
    return relations.checks(_qa(spark, d), _CHECKS, ["path"])


_CANDIDATES = """SELECT concat('in/', CAST(id AS VARCHAR(20)), '.jpg') AS original_path, CASE WHEN id % 2 = 0 THEN concat('out/c', CAST(id AS VARCHAR(20)), '.png') ELSE '' END AS clip_output_path, CASE WHEN id % 5 = 0 THEN '' ELSE concat('out/', CAST(id AS VARCHAR(20)), '.jpg') END AS output_path,
'field' AS places365_category, CASE id % 3 WHEN 0 THEN 'cloudy_sky' WHEN 1 THEN ' ' ELSE 'clear_upper_sky' END AS mapped_background_type, u AS upper_sky_ratio, 'good' AS clip_good_prompt, 'bad' AS clip_bad_prompt, green AS clip_suitability_score,
CASE WHEN id % 7 = 0 THEN 'reject' ELSE 'accept' END AS clip_filter_status FROM fx_feat"""


@query(f"""WITH c AS (SELECT * REPLACE (coalesce(nullif(clip_output_path, ''), output_path) AS output_path, CASE WHEN trim(mapped_background_type) = '' THEN 'sky_with_natural_landscape' ELSE mapped_background_type END AS mapped_background_type) FROM ({_CANDIDATES}) WHERE clip_filter_status = 'accept'),
f AS (SELECT *, parse_filename(CASE WHEN output_path = '' THEN original_path ELSE output_path END) AS file, row_number() OVER (ORDER BY mapped_background_type, clip_suitability_score DESC, upper_sky_ratio DESC, original_path) AS n FROM c)
SELECT concat('p365_bg_', lpad(CAST(n AS VARCHAR), CAST(greatest(4, len(CAST(n AS VARCHAR))) AS INT), '0'), '_', substr(sha256(file), 1, 6)) AS candidate_id, original_path, output_path, places365_category, mapped_background_type, upper_sky_ratio, clip_good_prompt, clip_bad_prompt,
clip_suitability_score, '' AS decision, mapped_background_type AS final_category, '' AS notes FROM f""")
def review_manifest(spark, d):
    return packs.review_manifest(spark.sql(_CANDIDATES.replace("FROM fx_feat", "FROM {f}"), f=t(spark, d, "fx_feat")))


@query(f"""WITH m AS ({_REVIEWED}), w AS (SELECT event_id, lower(trim(decision)) AS e, coalesce(nullif(trim(final_category), ''), nullif(trim(mapped_background_type), ''), '') AS final_category FROM m),
x AS (SELECT event_id, CASE WHEN e IN ('', 'nan', 'none') THEN '' WHEN e IN ('accept', 'yes', 'y', 'keep', 'approved') THEN 'accept' WHEN e IN ('reject', 'no', 'n', 'drop', 'rejected') THEN 'reject' ELSE e END AS decision, final_category FROM w)
SELECT *, CASE WHEN decision NOT IN ('', 'accept', 'reject') THEN 'decision' WHEN decision = 'accept' AND final_category = '' THEN 'final_category' END AS invalid FROM x""")
def applied_decisions(spark, d):
    m = spark.sql(_REVIEWED.replace("FROM events", "FROM {events}"), events=t(spark, d, "events"))
    return packs.applied_decisions(m).select("event_id", "decision", "final_category", "invalid")


_EXPORT = f"SELECT doc_id AS id, label, extraction_failed, CASE WHEN doc_id % 13 = 0 THEN 'shared/path' ELSE path END AS path FROM ({QA_LABELS_SQL})"


@query(f"""WITH x AS ({_EXPORT}), l AS (SELECT DISTINCT path AS there FROM x WHERE id % 6 <> 1 OR path = 'shared/path'),
s AS (SELECT x.*, CASE WHEN extraction_failed THEN 'skipped_extraction_failed' WHEN label IS NULL OR label <> 'accept' THEN 'skipped_label' WHEN there IS NULL THEN 'skipped_missing_file' END AS stop FROM x LEFT JOIN l ON l.there = x.path)
SELECT export_status, count(*) AS n FROM (SELECT CASE WHEN stop IS NOT NULL THEN stop WHEN row_number() OVER (PARTITION BY path, stop ORDER BY id) = 1 THEN 'exported' ELSE 'skipped_duplicate_path' END AS export_status FROM s) GROUP BY 1""")
def export_approved(spark, d):
    rows = _qa(spark, d).select(F.col("doc_id").alias("id"), "label", "extraction_failed", F.when(F.col("doc_id") % 13 == 0, "shared/path").otherwise(F.col("path")).alias("path"))
    listing = rows.where("id % 6 <> 1 or path = 'shared/path'").select("path")
    return packs.export_counts(packs.export_approved(rows, listing))


_PACK = """SELECT doc_id % 1000 AS background_id, concat('f', CAST(doc_id % 997 AS VARCHAR(20)), '.png') AS file_name, concat('images/', CAST(doc_id AS VARCHAR(20))) AS path, CASE WHEN doc_id % 9 = 0 THEN 'review' ELSE 'Accept' END AS qa_final_label,
doc_id AS asset_id, CASE WHEN doc_id % 10 = 3 THEN 'target' ELSE 'distractor' END AS class_group, CASE WHEN doc_id % 10 = 4 THEN NULL ELSE 'bird ' END AS class_name, doc_id % 8 <> 0 AS there FROM documents"""
_REPEATED = lambda c: f"SELECT 'duplicate_{c}' AS check, 'error' AS level, coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM (SELECT count(*) AS n FROM p GROUP BY {c} HAVING count(*) > 1)"


@query(f"""WITH p AS ({_PACK}) SELECT 'not_accepted' AS check, 'error' AS level, count(*) FILTER (WHERE qa_final_label <> 'Accept') AS n FROM p UNION ALL SELECT 'missing_file', 'error', count(*) FILTER (WHERE NOT there) FROM p
UNION ALL {_REPEATED('background_id')} UNION ALL {_REPEATED('file_name')} UNION ALL SELECT 'below_min_count', 'warning', CASE WHEN count(*) < 5000 THEN count(*) ELSE 0 END FROM p""")
def sky_pack_validation(spark, d):
    p = spark.sql(_PACK.replace("FROM documents", "FROM {d}"), d=t(spark, d, "documents"))
    return packs.sky_pack_checks(p.drop("there"), p.where("there").select("path"), 5000)


@query(f"""WITH p AS ({_PACK}) SELECT 'missing_file' AS check, 'error' AS level, count(*) FILTER (WHERE NOT there) AS n FROM p UNION ALL SELECT 'unexpected_group', 'error', count(*) FILTER (WHERE class_group = 'target') FROM p
UNION ALL SELECT 'unexpected_class', 'error', count(*) FILTER (WHERE class_name IS NULL) FROM p UNION ALL SELECT 'not_accepted', 'warning', count(*) FILTER (WHERE qa_final_label <> 'Accept') FROM p
UNION ALL {_REPEATED('asset_id')} UNION ALL {_REPEATED('path')} UNION ALL SELECT 'empty_pack', 'error', 0 FROM (SELECT 1)""")
def asset_pack_validation(spark, d):
    p = spark.sql(_PACK.replace("FROM documents", "FROM {d}"), d=t(spark, d, "documents"))
    return packs.asset_pack_checks(p.drop("there"), p.where("there").select("path"), "distractor", "bird")


@query("SELECT 'pool' AS check, count(*) AS n FROM fx_asset UNION ALL SELECT c, (SELECT count(*) FROM fx_asset WHERE cls = c) FROM (VALUES ('bird'), ('airplane'), ('balloon')) v(c)")
def pool_validation(spark, d):
    return packs.pool_checks(t(spark, d, "fx_asset"), "cls", ["bird", "airplane", "balloon"])


@query("SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_event(spark, d):
    e = t(spark, d, "events").withColumn("position", F.struct("ts", "event_id"))
    return relations.last_of(e, "user_id", "event_type", "position").join(e.groupBy("user_id").agg(F.max("ts").alias("last_ts")), "user_id")


@query("""SELECT p.page_id, CASE WHEN b.doc_id IS NOT NULL THEN 'first' WHEN c.doc_id IS NOT NULL THEN 'second' END AS resolved FROM pages p LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) b ON b.doc_id = p.page_id LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) c ON c.doc_id = p.page_id""")
def path_resolution(spark, d):
    there = t(spark, d, "labels").select(F.concat(F.when(F.col("quality") == 1, "good/").otherwise("bad/"), F.col("doc_id").cast("string")).alias("path"))
    p = t(spark, d, "pages").select("page_id", F.concat(F.lit("good/"), "page_id").alias("a"), F.concat(F.lit("bad/"), "page_id").alias("b"))
    found = relations.resolve_paths(p, "page_id", ["a", "b"], there)
    return found.select("page_id", F.when(F.col("resolved") == F.col("a"), "first").when(F.col("resolved") == F.col("b"), "second").alias("resolved"))


@query("SELECT doc_id, printf('cand_%06d', row_number() OVER (ORDER BY source, doc_id) - 1) AS candidate_id FROM documents")
def candidate_ids(spark, d):
    return relations.ids_in_order(t(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "cand_%06d", "candidate_id").select("doc_id", "candidate_id")
