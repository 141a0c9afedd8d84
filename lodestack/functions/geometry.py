"""Boxes as Column expressions: overlap, conversion, clipping, validation, placement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x, y, w, h, with a prefix."""
    return tuple(F.col(prefix + n) for n in "xywh")


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of integer boxes; 0 without overlap or without area."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    ih = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    shared = F.when((iw > 0) & (ih > 0), iw * ih).otherwise(F.lit(0))
    union = aw * ah + bw * bh - shared
    return F.when((shared > 0) & (union > 0), shared.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def centre(b: Box) -> tuple[Column, Column]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def corners_to_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Box:
    """Rounded to even halves; sizes come from the differences before rounding and are at least 1."""
    whole = lambda c: F.bround(c).cast("int")
    return whole(x1), whole(y1), F.greatest(F.lit(1), whole(x2 - x1)), F.greatest(F.lit(1), whole(y2 - y1))


def box_to_corners(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def yolo_to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, least: int | None = 1) -> Box:
    """Normalised centre form to pixels; ``least`` is the smallest size, None for no limit."""
    out = [F.bround((cx - w / 2) * width), F.bround((cy - h / 2) * height), F.bround(w * width), F.bround(h * height)]
    out = [c.cast("int") for c in out]
    return (out[0], out[1], *[F.greatest(F.lit(least), c) for c in out[2:]]) if least is not None else tuple(out)


def yolo_line(class_id: Column, b: Box, width: Column, height: Column) -> Column:
    """The label line of a box, six decimals, halves up; computed in whole numbers, so that it is the same everywhere."""

    def share(twice: Column, full: Column) -> list[Column]:
        top = twice.cast("long") * 1000000 + full.cast("long")
        micro = (top - F.pmod(top, full.cast("long") * 2)) / (full * 2)
        return [F.floor(micro / 1000000), F.pmod(micro.cast("long"), F.lit(1000000))]

    parts = [*share(b[0] * 2 + b[2], width), *share(b[1] * 2 + b[3], height), *share(b[2] * 2, width), *share(b[3] * 2, height)]
    return F.format_string("%d %d.%06d %d.%06d %d.%06d %d.%06d", class_id, *parts)


def clip(b: Box, width: Column, height: Column) -> Box:
    """Origin moved into the image, sizes cut to what is left there; sizes may become 0, which ``clipped_away`` tells."""
    x = F.greatest(F.lit(0), F.least(b[0], width - 1))
    y = F.greatest(F.lit(0), F.least(b[1], height - 1))
    return x, y, F.greatest(F.lit(0), F.least(b[2], width - x)), F.greatest(F.lit(0), F.least(b[3], height - y))


def clipped_away(b: Box) -> Column:
    return (b[2] <= 0) | (b[3] <= 0)


def clamp(b: Box, width: Column, height: Column) -> Box:
    """Origin moved into the image, sizes cut to what is left there, at least 1."""
    x = F.least(F.greatest(b[0], F.lit(0)), width - 1)
    y = F.least(F.greatest(b[1], F.lit(0)), height - 1)
    return x, y, F.greatest(F.lit(1), F.least(b[2], width - x)), F.greatest(F.lit(1), F.least(b[3], height - y))


def problem(b: Box, width: Column, height: Column, least: int) -> Column:
    """Why a box is unusable, or null."""
    return (
        F.when((b[2] <= 0) | (b[3] <= 0), "non_positive_size")
        .when((b[0] < 0) | (b[1] < 0) | (b[0] + b[2] > width) | (b[1] + b[3] > height), "outside_image")
        .when(F.greatest(b[2], b[3]) < least, "below_min_bbox_px")
    )


def parse(a: Column, b: Column, c: Column, d: Column, form: Column) -> Box:
    """Numbers as ``xywh`` or ``xyxy``, by the format column."""
    corners = form == "xyxy"
    return a, b, F.when(corners, c - a).otherwise(c), F.when(corners, d - b).otherwise(d)


def expand(b: Box, ratio: float, width: Column, height: Column) -> Box:
    """Grown on every side by a share of its size, rounded to even halves, within the image."""
    px, py = F.bround(b[2] * ratio).cast("int"), F.bround(b[3] * ratio).cast("int")
    x1, y1 = F.greatest(F.lit(0), b[0] - px), F.greatest(F.lit(0), b[1] - py)
    x2, y2 = F.least(width, b[0] + b[2] + px), F.least(height, b[1] + b[3] + py)
    return x1, y1, F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)


def pad(b: Box, share: float, width: Column, height: Column) -> Box:
    """As ``expand``, with the padding cut to whole pixels."""
    px, py = (b[2] * share).cast("int"), (b[3] * share).cast("int")
    x1, y1 = F.greatest(F.lit(0), b[0] - px), F.greatest(F.lit(0), b[1] - py)
    return x1, y1, F.least(width, b[0] + b[2] + px) - x1, F.least(height, b[1] + b[3] + py) - y1


def scene_features(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Shares of the image that a box takes, where it lies, and whether it is large."""
    area = (b[2] * b[3]).cast("double") / (width * height)
    side = F.greatest(b[2], b[3]).cast("double") / F.least(width, height)
    return {
        "area_ratio": area,
        "max_dim_ratio": side,
        "cy": (b[1] + b[3] / 2) / height,
        "bottom": (b[1] + b[3]) / height,
        "large": (area >= 0.10) | (side >= 0.28),
    }


def annotation_geometry(b: Box, area: Column, width: Column, height: Column) -> dict[str, Column]:
    """Hard-negative geometry: the annotated area counts before width times height."""
    return {
        "a": F.try_divide(F.coalesce(F.when(area > 0, area), b[2] * b[3]).cast("double"), width * height),
        "m": F.greatest(b[2], b[3]),
        "cy": F.try_divide(b[1] + b[3] / 2, height),
        "aspect": F.try_divide(b[2].cast("double"), b[3]),
    }


def aspect(w: Column, h: Column) -> Column:
    """Width by height to four decimals, null without height."""
    return F.bround(F.try_divide(w.cast("double"), h), 4)


def placement_bounds(w: Column, h: Column, width: Column, height: Column, across: tuple[float, float], down: tuple[float, float], margin: int = 0) -> tuple[Column, Column, Column, Column]:
    """First and last origin across and down, so that an object's centre lies in a share of the image and the object inside it.

    An empty range gives way to all places inside the margin, downwards no lower than the share allows.
    """
    side = F.lit(margin)

    def bounds(size: Column, full: Column, low: float, high: float) -> tuple[Column, Column]:
        return F.greatest(side, F.ceil(full * low - size / 2).cast("int")), F.least(full - size - margin, F.floor(full * high - size / 2).cast("int"))

    (x1, x2), (y1, y2) = bounds(w, width, *across), bounds(h, height, *down)
    x_all = F.greatest(side, width - w - margin)
    y_all = F.greatest(side, F.least(height - h - margin, (height * down[1]).cast("int") - h))
    return F.when(x1 > x2, side).otherwise(x1), F.when(x1 > x2, x_all).otherwise(x2), F.when(y1 > y2, side).otherwise(y1), F.when(y1 > y2, y_all).otherwise(y2)


def resized(w: Column, h: Column, target: Column) -> tuple[Column, Column]:
    """Sizes so that the longer side becomes ``target``, at least 1."""
    scale = target.cast("double") / F.greatest(w, h)
    return tuple(F.greatest(F.lit(1), F.bround(c * scale).cast("int")) for c in (w, h))


def distance_bin(size: Column, bins: dict[str, int]) -> Column:
    """The bin with the greatest threshold that ``size`` reaches; the least bin if it reaches none."""
    order = sorted(bins.items(), key=lambda kv: -kv[1])
    out = F.when(size >= order[0][1], order[0][0])
    for name, least in order[1:]:
        out = out.when(size >= least, name)
    return out.otherwise(order[-1][0])


def difficulty(size: Column, noise: Column, blur: Column, subset: Column) -> Column:
    """easy, medium or hard, by points for small objects, noise, blur and mixed scenes."""
    points = (
        F.when(size <= 15, 2).when(size <= 30, 1).otherwise(0)
        + F.when(noise >= 20, 2).when(noise >= 10, 1).otherwise(0)
        + F.when(blur != "none", 1).otherwise(0)
        + F.when(subset == "mixed_challenge", 1).otherwise(0)
    )
    return F.when(subset == "hard_negative", "hard_negative").when(points >= 4, "hard").when(points >= 2, "medium").otherwise("easy")
