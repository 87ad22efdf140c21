"""What images need beyond their boxes: scales, colour shares, timeline places. Pixels come decoded, as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The range of blue in (hue in half degrees, saturation, value), bounds included.
BLUE = ((90, 50, 50), (130, 255, 255))


def hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit BGR to hue in half degrees, saturation and value."""
    b, g, r = np.moveaxis(np.asarray(bgr, float), -1, 0)
    top = np.max([b, g, r], axis=0)
    spread = top - np.min([b, g, r], axis=0)
    safe = np.where(spread == 0, 1, spread)
    hue = np.where(top == r, 60 * (g - b) / safe, np.where(top == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    hue = np.where(spread == 0, 0, np.where(hue < 0, hue + 360, hue))
    return np.stack([np.round(hue / 2), np.round(np.where(top == 0, 0, 255 * spread / np.where(top == 0, 1, top))), top], axis=-1)


def blue_share(bgr: np.ndarray, box: tuple[int, int, int, int]) -> float:
    """The share of blue pixels within a box, clipped to the image; 0 for an empty one."""
    h, w = bgr.shape[:2]
    x1, y1, x2, y2 = max(0, min(w - 1, box[0])), max(0, min(h - 1, box[1])), max(0, min(w, box[2])), max(0, min(h, box[3]))
    if x2 <= x1 or y2 <= y1:
        return 0.0
    part = hsv(bgr[y1:y2, x1:x2])
    return float(((part >= BLUE[0]) & (part <= BLUE[1])).all(axis=-1).mean())


def crop_box(width: int, height: int, size: int | None) -> tuple[int, int, int, int] | None:
    """The centred square of a frame, or None without a size; a frame that is smaller is an error."""
    if size is None:
        return None
    if width < size or height < size:
        raise ValueError(f"a frame of {width} x {height} is smaller than the crop of {size}")
    x, y = (width - size) // 2, (height - size) // 2
    return x, y, x + size, y + size


def cropped(image: np.ndarray, box: tuple[int, int, int, int] | None, flip: bool = False) -> np.ndarray:
    """The part of an image within a box, turned upside down if ``flip``."""
    if box is not None:
        x1, y1, x2, y2 = box
        if image.shape[1] < x2 - x1 or image.shape[0] < y2 - y1:
            raise ValueError(f"an image of {image.shape[1]} x {image.shape[0]} is smaller than the crop")
        image = image[y1:y2, x1:x2]
    return image[::-1] if flip else image


def centred(image: np.ndarray, means: tuple[float, float, float] = (102.9801, 115.9465, 122.7717)) -> np.ndarray:
    """Pixels (BGR) as floats without the training set's means, which are fixed values."""
    return image.astype(np.float32) - np.array(means, np.float32)


def blob(images: list[np.ndarray]) -> np.ndarray:
    """Images of several sizes in one array, filled up with zeros to the right and below."""
    out = np.zeros((len(images), max(i.shape[0] for i in images), max(i.shape[1] for i in images), images[0].shape[2]), np.float32)
    for k, image in enumerate(images):
        out[k, : image.shape[0], : image.shape[1]] = image
    return out


def image_scale(w: Column, h: Column, short: int = 600, long: int = 1000) -> Column:
    """The factor that brings the short side to ``short``, less if the long side would pass ``long``."""
    low, high = F.least(w, h).cast("double"), F.greatest(w, h).cast("double")
    return F.when(F.round(F.lit(short) / low * high) > long, F.lit(long) / high).otherwise(F.lit(short) / low)


def timeline_edge(i: Column, n: Column, width: int) -> Column:
    """The left edge, in pixels, of frame i of n on a timeline."""
    return F.floor(i * F.lit(width) / n)
