"""Recall and false alarms by group, with every image in the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(c: str | Column) -> Column:
    return F.round(F.avg(c), 6)


def group_recall(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Recall by ``keys``; null keys are a group, misses count 0 in the means, recall of nothing is null."""
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n_images"),
        F.sum("detected").cast("long").alias("detected"),
        F.sum("tp").cast("long").alias("tp"),
        F.sum("fn").cast("long").alias("fn"),
        F.round(F.avg("best_iou"), 9).alias("mean_best_iou"),
        F.round(F.avg("matched_conf"), 9).alias("mean_matched_conf"),
        F.round(F.try_divide(F.sum("tp"), F.sum("tp") + F.sum("fn")), 6).alias("recall"),
    )


def group_false_positives(facts: DataFrame, keys: list[str]) -> DataFrame:
    """False alarms by ``keys``."""
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n_images"),
        F.sum("false_positive_image").cast("long").alias("false_positive_images"),
        F.sum("fp").cast("long").alias("fp_count"),
        F.round(F.avg("fp_conf_mean"), 9).alias("mean_fp_conf"),
        F.round(F.try_divide(F.sum("false_positive_image"), F.count("*")), 6).alias("false_positive_image_rate"),
    )


def model_summary(facts: DataFrame) -> DataFrame:
    """By model and threshold: recall over images with a target, false alarms over those without; null over none."""
    there = F.col("target_present")
    over = lambda where, c: F.when(where, F.col(c))
    total = lambda where, c: F.coalesce(F.sum(over(where, c)), F.lit(0)).cast("long")
    return facts.groupBy("model_name", "iou_threshold").agg(
        F.count_if(there).alias("n_target_present"),
        F.count_if(~there & (F.col("subset") == "synthetic_distractor_only")).alias("n_distractor_only"),
        _mean(over(there, "detected")).alias("recall"),
        total(there, "tp").alias("tp"),
        total(there, "fn").alias("fn"),
        _mean(over(there, "best_iou")).alias("mean_best_iou"),
        _mean(over(~there, "false_positive_image")).alias("false_positive_image_rate"),
        total(~there, "fp").alias("fp_count"),
    )


def grouped_metrics(facts: DataFrame, keys: list[str]) -> DataFrame:
    """By all ``keys`` together: recall over images with a target, and false alarms over those without; ``part`` tells which.

    Columns that a part lacks are null.
    """
    there, away = group_recall(facts.where("target_present"), keys), group_false_positives(facts.where("not target_present"), keys)
    return there.withColumn("part", F.lit("recall")).unionByName(away.withColumn("part", F.lit("false_positive")), allowMissingColumns=True)


def plotted_false_positives(rates: DataFrame, threshold: float) -> DataFrame:
    """Mean of the rates by model and kind of distractor at one threshold, the first of the table; blank kinds are left out."""
    told = F.trim(F.coalesce("distractor_type", F.lit(""))) != ""
    shown = rates.where((F.col("iou_threshold") == threshold) & told)
    return shown.groupBy("model_name", "distractor_type").agg(_mean("false_positive_image_rate").alias("false_positive_image_rate"))


def zero_prediction_rows(meta: DataFrame, predictions: DataFrame, models: list[str], thresholds: list[float]) -> DataFrame:
    """Summary rows for every subset, model and threshold without any prediction: nothing found, nothing raised."""
    sizes = meta.groupBy("subset").agg(F.count_if("target_present").alias("n_target_present"), F.count_if(~F.col("target_present")).alias("n_distractor_only"))
    grid = sizes.withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in models])))
    seen = predictions.select("image_id", "model_name").distinct().join(meta.select("image_id", "subset"), "image_id").select("subset", "model_name").distinct()
    none = grid.join(seen, ["subset", "model_name"], "left_anti")
    none = none.withColumn("iou_threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    zero, nothing = F.lit(0.0), F.lit(0).cast("long")
    return none.select(
        "subset", "model_name", "iou_threshold", "n_target_present", "n_distractor_only", zero.alias("recall"), nothing.alias("tp"), F.col("n_target_present").alias("fn"),
        zero.alias("mean_best_iou"), zero.alias("false_positive_image_rate"), nothing.alias("fp_count"),
    )


def predicted_only(facts: DataFrame) -> DataFrame:
    """Only images with predictions: the denominator that overstates recall, kept to reproduce it."""
    return facts.where("pred_count > 0")


def correct_denominators(summary: DataFrame) -> DataFrame:
    """Summaries over predicted images only, put right from the number of all images.

    Needs ``kind`` (positive, mixed or hard_negative), ``tp, metadata_total_images, prediction_unique_images,
    mean_best_iou``; the mean is passed on as it is.
    """
    total = F.col("metadata_total_images")
    negative = F.col("kind") == "hard_negative"
    return summary.select(
        *[c for c in summary.columns if c not in ("fn", "recall", "false_positive_rate", "n_target")],
        F.when(~negative, total).alias("n_target"),
        F.when(~negative, total - F.col("tp")).alias("fn"),
        F.when(~negative, F.try_divide(F.col("tp").cast("double"), total)).alias("recall"),
        F.when(negative, F.try_divide(F.col("prediction_unique_images").cast("double"), total)).alias("false_positive_rate"),
    )


def robustness(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Recall on images with a target and false alarms on those without, by one dimension after another.

    One pass: each image is fanned out over the dimensions, then grouped once.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])).alias("p")
    fanned = facts.select("*", pairs).withColumns({"dimension": F.col("p.dimension"), "level": F.col("p.level")})
    keys = ["model_name", "iou_threshold", "dimension", "level"]
    there, away = group_recall(fanned.where("target_present"), keys), group_false_positives(fanned.where("not target_present"), keys)
    return there.withColumn("part", F.lit("recall")).unionByName(away.withColumn("part", F.lit("false_positive")), allowMissingColumns=True)


def detection_rate(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean detection by ``keys`` over images with a target."""
    return facts.where("target_present").groupBy(*keys).agg(_mean("detected").alias("recall"), F.count("*").alias("n_images"))


def recall_heatmap(facts: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Mean detection, one column for each of ``values``, which are given so that no pass has to find them."""
    return facts.where("target_present").groupBy(*rows).pivot(column, values).agg(_mean("detected"))


def histogram(df: DataFrame, value: str, keys: list[str], bins: int = 30, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in equal bins; ``high`` is in the last bin, and values outside are left out."""
    width = (high - low) / bins
    bucket = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(*keys, bucket.alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, dimensions: list[str], most: int | None = None) -> DataFrame:
    """Counts of each value of each dimension, nulls among them; ``most`` keeps the most frequent (ties by value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("p")
    counts = df.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    if most is None:
        return counts
    order = Window.partitionBy("dimension").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def crosstab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by the given values of ``column``, 0 where there are none."""
    return df.groupBy(rows).pivot(column, values).count().na.fill(0, values)


def pivot_first(df: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One value for each of ``values``; the table has one row for each key and value."""
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value, ignorenulls=True))


def reason_counts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """How often each reason stands in separated lists."""
    return df.select(F.explode_outer(F.split(column, separator)).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def spread(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Least, median, greatest and mean."""
    return df.withColumn("v_", value).groupBy(*keys).agg(F.min("v_").alias("least"), F.round(F.median("v_"), 6).alias("median"), F.max("v_").alias("greatest"), _mean("v_").alias("mean"))


def scene_statistics(annotations: DataFrame, groups: dict[str, list[str]], width: str = "image_width", height: str = "image_height", top: int = 5) -> DataFrame:
    """By image: the largest box's share, shares summed and greatest by group of categories, the greatest
    sum of one category of the group, and the leading categories.

    Categories are added up before images, so an image's annotations are never collected.
    """
    share = F.col("area").cast("double") / (F.col(width) * F.col(height))
    per = annotations.withColumn("share", share).groupBy("image_id", "category").agg(F.sum("share").alias("total"), F.max("share").alias("most"))
    order = Window.partitionBy("image_id").orderBy(F.round("total", 9).desc(), "category")
    ranked = per.withColumn("rank", F.row_number().over(order))
    aggregates = [F.round(F.max("most"), 6).alias("largest")]
    for name, members in groups.items():
        member = F.col("category").isin(*members)
        aggregates += [F.round(F.sum(F.when(member, F.col("total")).otherwise(0.0)), 6).alias(name + "_sum"), F.round(F.max(F.when(member, F.col("most")).otherwise(0.0)), 6).alias(name + "_max"), F.round(F.max(F.when(member, F.col("total")).otherwise(0.0)), 6).alias(name + "_top")]
    leading = F.sort_array(F.collect_list(F.when((F.col("rank") <= top) & (F.col("total") > 0.01), F.struct("rank", "category"))))
    return ranked.groupBy("image_id").agg(*aggregates, F.array_join(F.transform(leading, lambda x: x["category"]), ",").alias("leading"))


def image_candidates(annotations: DataFrame, least_px: int) -> DataFrame:
    """By image: the largest box's class (the first of equals), the classes, the count, and whether all boxes are too small."""
    return annotations.groupBy("image_id").agg(
        F.max_by("class_name", F.struct("area", -F.col("line"), -F.col("l_partkey"), -F.col("l_suppkey"))).alias("largest_class"),
        F.array_join(F.sort_array(F.collect_set("class_name")), ",").alias("classes"),
        F.count("*").alias("n"),
        F.bool_and(F.greatest("w", "h") < least_px).cast("int").alias("all_small"),
    )


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows went from one label to another."""
    return df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))


def group_scores(scores: DataFrame, id_col: str, group_col: str, score_col: str, prompt_col: str) -> DataFrame:
    """By id: the leading groups by their greatest score, the margin between them and the leading prompts."""
    best = scores.groupBy(id_col, group_col).agg(F.max(F.struct(F.col(score_col).alias("s"), (-F.col(prompt_col)).alias("p"))).alias("b"))
    order = Window.partitionBy(id_col).orderBy(F.col("b.s").desc(), group_col)
    ranked = best.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, c))
    return ranked.groupBy(id_col).agg(
        pick(1, F.col(group_col)).alias("first_group"),
        F.round(pick(1, F.col("b.s")), 6).alias("first_score"),
        pick(1, -F.col("b.p")).alias("first_prompt"),
        pick(2, F.col(group_col)).alias("second_group"),
        F.round(pick(2, F.col("b.s")), 6).alias("second_score"),
        pick(2, -F.col("b.p")).alias("second_prompt"),
        F.round(pick(1, F.col("b.s")) - pick(2, F.col("b.s")), 6).alias("margin"),
    )
