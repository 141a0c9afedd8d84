"""Pixel kernels in NumPy, and pandas functions over Spark's image struct.

Hue runs from 0 to 180, as in 8-bit HSV.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's bytes (BGR or BGRA) as an RGB or RGBA array."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return x[..., [2, 1, 0, 3][:channels]] if channels >= 3 else np.repeat(x, 3, axis=2)


def hsv(image: np.ndarray) -> np.ndarray:
    c = image[..., :3].astype(np.float64)
    v, low = c.max(-1), c.min(-1)
    span = v - low
    safe = np.where(span == 0, 1, span)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    h = np.where(span == 0, 0, np.where(h < 0, h + 180, h))
    s = np.where(v == 0, 0, span / np.where(v == 0, 1, v) * 255)
    return np.stack([np.rint(h) % 180, np.rint(s), v], -1)


def sky(image: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv(image), -1, 0)
    return ((v >= 120) & (s <= 85)) | ((h >= 90) & (h <= 140) & (s >= 15) & (v >= 70))


def split_row(height: int) -> int:
    """The first row of the lower part."""
    return max(1, int(height * 0.55))


def colour_shares(image: np.ndarray) -> dict[str, float]:
    """Shares of blue sky, of grey or white cloud and of green; 0 without pixels."""
    if not image.size:
        return {"blue": 0.0, "cloud": 0.0, "green": 0.0}
    h, s, v = np.moveaxis(hsv(image), -1, 0)
    g = grey(image)
    return {
        "blue": float(((h >= 90) & (h <= 140) & (s >= 15) & (v >= 70)).mean()),
        "cloud": float(((g >= 145) & (g <= 235) & (s <= 70) & (v >= 100)).mean()),
        "green": float(((h >= 35) & (h <= 90) & (s >= 25) & (v >= 25)).mean()),
    }


def edges(g: np.ndarray, low: int, high: int) -> np.ndarray:
    """Canny edges of grey values: 3 x 3 Sobel, |dx| + |dy|, thinning, and weak edges that 8-connect to strong ones."""
    p = np.pad(g.astype(np.int64), 1, mode="edge")
    column = p[:-2] + 2 * p[1:-1] + p[2:]
    row = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = column[:, 2:] - column[:, :-2], row[2:] - row[:-2]
    strength = np.abs(dx) + np.abs(dy)
    around = np.pad(strength, 1)

    def at(i: int, j: int) -> np.ndarray:
        return around[1 + i : 1 + i + g.shape[0], 1 + j : 1 + j + g.shape[1]]

    # The direction is one of four; 13573 / 2**15 is the tangent of 22.5 degrees.
    x, y = np.abs(dx) * 13573, np.abs(dy) << 15
    flat, steep = y < x, y > x + (np.abs(dx) << 16)
    across = (strength > at(0, -1)) & (strength >= at(0, 1))
    along = (strength > at(-1, 0)) & (strength >= at(1, 0))
    falling = (strength > at(-1, -1)) & (strength > at(1, 1))
    rising = (strength > at(-1, 1)) & (strength > at(1, -1))
    ridge = np.where(flat, across, np.where(steep, along, np.where((dx ^ dy) < 0, rising, falling)))
    weak = ridge & (strength > low)
    return reached(weak & (strength > high), weak)


def reached(start: np.ndarray, within: np.ndarray) -> np.ndarray:
    """What 8-connects to ``start`` inside ``within``; each pixel is visited once."""
    out = start.copy()
    todo = list(zip(*np.nonzero(start)))
    while todo:
        r, c = todo.pop()
        top, left = max(r - 1, 0), max(c - 1, 0)
        near = within[top : r + 2, left : c + 2] & ~out[top : r + 2, left : c + 2]
        out[top : r + 2, left : c + 2] |= near
        todo.extend((top + i, left + j) for i, j in zip(*np.nonzero(near)))
    return out


def dark_structure(image: np.ndarray) -> float:
    """The share of dark, pale pixels on edges."""
    if not image.size:
        return 0.0
    g = grey(image)
    dark = (g >= 25) & (g <= 120) & (hsv(image)[..., 1] <= 80)
    return float((dark & edges(g, 50, 140)).mean())


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114]))


def laplacian_variance(image: np.ndarray) -> float:
    g = np.pad(grey(image), 1, mode="reflect") if min(image.shape[:2]) > 1 else np.pad(grey(image), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def perceptual_hash(image: np.ndarray) -> str:
    """64 bits: low frequencies of a 32 x 32 reduction above their median (without first row and column)."""
    g = grey(image)
    small = _stretched(g, 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.where(k[:, None] == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low[1:, 1:])).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _weights(n: int, m: int, average: bool) -> np.ndarray:
    """Weights that make ``m`` samples of ``n``: averages over equal stretches, or else steps with a linear share at borders."""
    if average:
        cuts = np.linspace(0, n, m + 1)
        lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
        w = np.clip(np.minimum(cuts[1:, None], hi) - np.maximum(cuts[:-1, None], lo), 0, None)
        return w / w.sum(1, keepdims=True)
    to = np.arange(m)
    left = np.minimum(to * n // m, n - 1)
    share = (to + 1) - (left + 1) * (m / n)
    share = np.where(share <= 0, 0, share - np.floor(share))
    w = np.zeros((m, n))
    w[to, left] += 1 - share
    w[to, np.minimum(left + 1, n - 1)] += share
    return w


def _stretched(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape[:2]
    average = height <= h and width <= w
    down = np.tensordot(_weights(h, height, average), image.astype(np.float64), 1)
    return np.moveaxis(np.tensordot(_weights(w, width, average), down, (1, 1)), 0, 1)


def resized(image: np.ndarray, longest: int) -> np.ndarray:
    """The image with ``longest`` as its larger side; sides of at least 1."""
    if longest <= 0:
        raise ValueError("the larger side must be positive")
    h, w = image.shape[:2]
    scale = longest / max(h, w, 1)
    height, width = max(1, round(h * scale)), max(1, round(w * scale))
    if (height, width) == (h, w):
        return image
    return np.clip(np.rint(_stretched(image, height, width)), 0, 255).astype(np.uint8)


def blurred(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with a kernel of ``size``, the next odd number if even; 0 or less leaves the image."""
    if size <= 0:
        return image
    size += 1 - size % 2
    # The binomial kernels that stand for small sizes.
    small = {1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}
    half = size // 2
    kernel = np.array(small[size], float) if size in small else np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * (0.3 * (half - 1) + 0.8) ** 2))
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        mirror = np.abs(np.arange(-half, n + half)) % max(2 * n - 2, 1)
        p = np.take(out, np.where(mirror < n, mirror, 2 * n - 2 - mirror), axis)
        out = sum(k * np.take(p, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return np.floor(out + 0.5).astype(np.uint8)


def components(mask: np.ndarray, least: int = 16) -> list[int]:
    """Sizes of 8-connected parts with at least ``least`` pixels, largest first."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        best = np.max([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        best = np.where(mask, best, 0)
        if (best == label).all():
            break
        label = best
    _, n = np.unique(label[mask], return_counts=True)
    return sorted((int(x) for x in n if x >= least), reverse=True)


def alpha_statistics(alpha: np.ndarray) -> dict[str, float]:
    """Share of visible pixels, share of these on the edge, parts, the largest part's share, and how much it looks like an
    uncut rectangle: 0 unless all four edges are touched, the box is filled over 0.88 and the area is over 0.75."""
    mask = alpha > 12
    n = int(mask.sum())
    if not n:
        return {"alpha_area": 0.0, "border": 0.0, "comps": 0, "largest": 0.0, "rectangle": 0.0}
    area = n / mask.size
    edge = np.zeros_like(mask)
    edge[[0, -1]] = edge[:, [0, -1]] = True
    parts = components(mask)
    x, y, w, h = mask_box(mask)
    filled = float(mask[y : y + h, x : x + w].mean())
    around = mask[0].any() and mask[-1].any() and mask[:, 0].any() and mask[:, -1].any()
    rectangle = min(1.0, filled * area) if around and filled > 0.88 and area > 0.75 else 0.0
    facts = {"alpha_area": area, "border": (mask & edge).sum() / n, "comps": len(parts), "largest": parts[0] / n if parts else 0.0, "rectangle": rectangle}
    return {k: v if k == "comps" else round(float(v), 6) for k, v in facts.items()}


def alpha_class(alpha: np.ndarray) -> str:
    return "transparent" if alpha.max(initial=0) == 0 else "opaque" if alpha.min() == 255 else "with_transparency"


def mask_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (int(cols[0]), int(rows[0]), int(cols[-1] - cols[0] + 1), int(rows[-1] - rows[0] + 1)) if len(rows) else None


def touched_borders(mask: np.ndarray, share: float = 0.08) -> int:
    """Edges that hold at least a share of the mask's pixels."""
    n = mask.sum()
    return sum(int(n > 0 and e.sum() >= share * n) for e in (mask[0], mask[-1], mask[:, 0], mask[:, -1]))


def run_lengths_to_mask(counts: list[int], height: int, width: int) -> np.ndarray:
    """Runs of zeros and ones in turn, down the columns."""
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    return flat.reshape(width, height).T


def polygon_mask(points: list[float], height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside a polygon, by the even-odd rule."""
    xs, ys = np.array(points[0::2]), np.array(points[1::2])
    px, py = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for i in range(len(xs)):
        x1, y1, x2, y2 = xs[i - 1], ys[i - 1], xs[i], ys[i]
        if y1 != y2:
            inside ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return inside


def composite(background: np.ndarray, paste: np.ndarray, x: int, y: int) -> np.ndarray:
    """An RGBA object over an RGB image; what lies outside the image is cut off, fractions are dropped."""
    out = background.copy()
    top, left = max(y, 0), max(x, 0)
    bottom, right = min(y + paste.shape[0], out.shape[0]), min(x + paste.shape[1], out.shape[1])
    if top < bottom and left < right:
        part = paste[top - y : bottom - y, left - x : right - x].astype(np.float32)
        a = part[..., 3:] / np.float32(255)
        out[top:bottom, left:right] = (a * part[..., :3] + (1 - a) * out[top:bottom, left:right].astype(np.float32)).astype(np.uint8)
    return out


def noisy(image: np.ndarray, sigma: float, seed: int) -> np.ndarray:
    """Gaussian noise of its own seed, so that order and partitions do not matter; fractions are dropped."""
    return np.clip(image + np.random.default_rng(seed).normal(0, sigma, image.shape), 0, 255).astype(np.uint8) if sigma > 0 else image


def cropped(image: np.ndarray, box: tuple[int, int, int, int], mask: np.ndarray | None = None) -> np.ndarray | None:
    """A box of an RGB image as RGBA, opaque or by the image's mask; None if nothing of the box is inside."""
    x, y, w, h = box
    part = image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0), :3]
    if not part.size:
        return None
    shown = np.ones(part.shape[:2], bool) if mask is None else mask[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)].astype(bool)
    return np.dstack([part, np.where(shown, 255, 0).astype(np.uint8)])


def on_checkerboard(image: np.ndarray, cell: int = 12) -> np.ndarray:
    """An RGBA image over squares of light and dark grey."""
    rows, cols = np.indices(image.shape[:2]) // cell
    board = np.where((rows + cols) % 2, 240, 192).astype(np.uint8)
    return composite(np.repeat(board[..., None], 3, 2), image, 0, 0)


def without_white(image: np.ndarray, least: int) -> np.ndarray:
    """RGBA with pixels transparent whose every colour is at least ``least``."""
    return _cleared(image, (image[..., :3] >= least).all(-1))


def without_corner_colour(image: np.ndarray, tolerance: int = 18) -> np.ndarray:
    """RGBA with pixels transparent that differ from the mean of the four corners by at most ``tolerance`` in every colour."""
    mean = image[[0, 0, -1, -1], [0, -1, 0, -1], :3].astype(np.float64).mean(0)
    return _cleared(image, (np.abs(image[..., :3] - mean) <= tolerance).all(-1))


def clean_alpha(image: np.ndarray, least: int, least_share: float) -> tuple[np.ndarray, list[str]]:
    """RGBA with alpha under ``least`` set to 0, and notes on what was done and on too small a visible share."""
    notes = []
    if least > 0:
        image = _cleared(image, image[..., 3] < least)
        notes.append(f"threshold<{least}_zeroed")
    share = float((image[..., 3] > 0).mean()) if image.size else 0.0
    return image, notes + [f"low_alpha_fraction={share:.4f}"] * (share < least_share)


def _cleared(image: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[where, 3] = 0
    return out


def mask_facts(mask: np.ndarray, proposal: tuple[int, int, int, int]) -> dict[str, float]:
    """Size, place and borders of a mask in its crop, and how it fits a proposed box."""
    x, y, w, h = proposal
    bx, by, bw, bh = mask_box(mask) or (0, 0, 0, 0)
    cx, cy, r = int(x + w / 2), int(y + h / 2), max(3, min(w, h) // 6)
    middle = mask[max(cy - r, 0) : max(cy + r + 1, 0), max(cx - r, 0) : max(cx + r + 1, 0)]
    whole, touched = max(mask.size, 1), touched_borders(mask)
    return {
        "area": int(mask.sum()),
        "r": float(mask.sum() / whole),
        "bbox_share": bw * bh / whole,
        "k": touched,
        "border_share": touched / 4,
        "centre": float(middle.mean()) if middle.size else 0.0,
        "expansion": max(bw * bh, 1) / max(w * h, 1),
        "x": bx,
        "y": by,
        "w": bw,
        "h": bh,
    }


def png(image: np.ndarray) -> bytes:
    """An RGB or RGBA array as a PNG file."""
    h, w, c = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("u", "l", "f", "blue", "cloud", "green", "dark", "tex", "bri")] + [T.StructField("phash", T.StringType())]
)


def features(image: np.ndarray) -> dict[str, float | str]:
    """What the scene and background rules read; features of a part without pixels are 0."""
    s, cut = sky(image), split_row(image.shape[0])
    upper, lower = image[:cut], image[cut:]
    above = colour_shares(upper)
    return {
        "u": float(s[:cut].mean()),
        "l": float(s[cut:].mean()) if lower.size else 0.0,
        "f": float(s.mean()),
        "blue": above["blue"],
        "cloud": above["cloud"],
        "green": colour_shares(lower)["green"],
        "dark": dark_structure(lower),
        "tex": laplacian_variance(lower) if lower.size else 0.0,
        "bri": float(image[..., :3].mean()),
        "phash": perceptual_hash(image),
    }


@F.pandas_udf(FEATURES)
def image_features(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """``features`` of Spark's images."""
    rows = [features(rgb(d, h, w, c)) for d, h, w, c in zip(data, height, width, channels)]
    return pd.DataFrame(rows, columns=FEATURES.names)
