"""Why annotations are left out: label lines and COCO boxes, each with its first reason or null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo


def label_lines(df: DataFrame, text: str = "line_text", classes: tuple[int, ...] = (0, 1, 2), width: int = 640, height: int = 480, least: int = 30) -> DataFrame:
    """Label lines as clipped pixel boxes (``cls, x, y, w, h``) with the ``reason`` why a line is left out, or null.

    Blank lines and comments are no lines.  A class may be written as a decimal number.
    """
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    read = df.withColumn("line_", line).where("line_ <> '' and not startswith(line_, '#')")
    parts = F.split("line_", " ")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    read = read.withColumns({"n_": F.size(parts), "cls": number(0).cast("int")} | {f"v{i}_": number(i) for i in range(1, 5)})
    size = F.lit(width), F.lit(height)
    raw = geo.yolo_to_pixels(*[F.col(f"v{i}_") for i in range(1, 5)], *size, least=None)
    read = read.withColumns(dict(zip(("x0_", "y0_", "w0_", "h0_"), raw)))
    clipped = geo.clip(tuple(F.col(c) for c in ("x0_", "y0_", "w0_", "h0_")), *size)
    read = read.withColumns(dict(zip("xywh", clipped)))
    bad = F.col("cls").isNull() | F.col("v1_").isNull() | F.col("v2_").isNull() | F.col("v3_").isNull() | F.col("v4_").isNull()
    # The reasons.
    reason = (
        F.when(F.col("n_") < 5, "malformed_label_line")
        .when(bad, "parse_error")
        .when(~F.col("cls").isin(*classes), "class_id_not_exported")
        .when(geo.clipped_away(geo.box()), "clip_failed")
        .otherwise(geo.problem(geo.box(), *size, least))
    )
    return read.withColumn("reason", reason).drop("line_", "n_", "x0_", "y0_", "w0_", "h0_", *[f"v{i}_" for i in range(1, 5)])


def coco_boxes(df: DataFrame, categories: tuple[str, ...], least: float, most: float | None = None, crowds: bool = False) -> DataFrame:
    """``reason`` why a COCO annotation is left out, or null.

    Needs category, iscrowd, x, y, w, h, image_width, image_height (null without an image record) and there, whether the file exists.
    Boxes may stick out of the image by half a pixel on the right and below.
    """
    longer = F.greatest("w", "h")
    known = F.col("image_width").isNotNull() & F.col("image_height").isNotNull() & F.coalesce(F.col("there"), F.lit(False))
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("image_width") + 0.5) | (F.col("y") + F.col("h") > F.col("image_height") + 0.5)
    sizes = F.col("x").isNull() | F.col("y").isNull() | F.col("w").isNull() | F.col("h").isNull() | (F.col("w") <= 0) | (F.col("h") <= 0)
    # The reasons.
    reason = (
        F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category_not_requested")
        .when((F.coalesce(F.col("iscrowd").cast("int"), F.lit(0)) != 0) & F.lit(not crowds), "iscrowd")
        .when(sizes, "invalid_bbox")
        .when(longer < least, "bbox_too_small")
        .when(longer > (F.lit(most) if most is not None else F.lit(float("inf"))), "bbox_too_large")
        .when(~known, "image_missing")
        .when((F.col("image_width") <= 0) | (F.col("image_height") <= 0), "other")
        .when(out, "invalid_bbox")
    )
    return df.withColumn("reason", reason)
