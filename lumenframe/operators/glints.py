"""Glints: bright spots are masked on the half-size image and filled with a harmonic surface.

Mask refinement and relaxation visit pixels row by row and see what was changed before, so an image is one group and is worked on as an array;
images are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The relaxation factor, its rounds, brightness and contrast limits of the mask.
FACTOR, ROUNDS = 1.65, 10
TOP_PIXELS, TOP_SHARE, BRIGHT = 50, 200, 200
OWN_CONTRAST, SIDE_CONTRAST, GAIN, DARK, SEAM = 10, 25, 5, 100, 10


def by_image(df: DataFrame, run: Callable[[np.ndarray], np.ndarray], extra: str | None = None) -> DataFrame:
    """(img_id, y, x, v) with each image replaced by run(image), or by run(image, second) where df has a second channel."""
    kind = df.schema["img_id"].dataType.simpleString()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        planes = []
        for c in ["v", *([extra] if extra else [])]:
            a = np.zeros(shape, np.int32)
            a[pdf["y"], pdf["x"]] = pdf[c]
            planes.append(a)
        out = run(*planes)
        y, x = np.indices(out.shape, np.int32).reshape(2, -1)
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[0], "y": y, "x": x, "v": out.reshape(-1).astype(np.int32)})

    return df.groupBy("img_id").applyInPandas(each, f"img_id {kind}, y int, x int, v int")


def halved(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return (a[0:h:2, 0:w:2] + a[0:h:2, 1:w:2] + a[1:h:2, 0:w:2] + a[1:h:2, 1:w:2] + 2) // 4


def around(a: np.ndarray, cross: bool, pick: Callable) -> np.ndarray:
    """pick over the 3 x 3 neighbours, or the cross of five, of inner pixels; the border is 0."""
    h, w = a.shape
    out = np.zeros_like(a)
    if h > 2 and w > 2:
        places = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)] if cross else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        out[1:-1, 1:-1] = pick.reduce([a[1 + i : h - 1 + i, 1 + j : w - 1 + j] for i, j in places])
    return out


def bordered(a: np.ndarray) -> np.ndarray:
    """The border takes the values beside it."""
    return np.pad(a[1:-1, 1:-1], 1, mode="edge") if min(a.shape) > 2 else a


def from_top(hist: np.ndarray, more_than: int) -> int:
    """The largest bin from which more than so many values lie at or above; 0 if there is none above it."""
    above = np.cumsum(hist[::-1])[::-1]
    found = np.flatnonzero(above > more_than)
    return int(found[-1]) if len(found) else 0


def spots(small: np.ndarray) -> np.ndarray:
    """Mask of pixels that stand out of their surroundings near bright ones, 255 or 0, before it is refined."""
    low = small
    for _ in range(2):
        low = bordered(around(low, False, np.minimum))
        low = bordered(around(low, True, np.minimum))
    over = np.clip(small - low, 0, 255)
    hist = np.bincount(over.reshape(-1), minlength=256)
    first, second = from_top(hist, TOP_PIXELS), from_top(hist, small.size // TOP_SHARE) - 10
    limit = int((first + 2 * second) / 3)
    out = np.where(over > limit, 255, 0)
    for cross in (True, False, True):
        out = around(out, cross, np.maximum)
    near = np.where(small > BRIGHT, 255, 0)
    for cross in (False, True) * 3:
        near = around(near, cross, np.maximum)
    return np.minimum(out, near)


def refined(mask: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The mask's rim by contrast with the darkest of 5 x 5 pixels; each decision sees those before it in row order."""
    h, w = mask.shape
    mask = mask.copy()
    if h < 7 or w < 7:
        return mask
    dark = np.minimum.reduce([small[1 + i : h - 5 + i, 1 + j : w - 5 + j] for i in range(5) for j in range(5)])  # of the pixel at (3, 3) on
    for y in range(3, h - 3):
        for x in range(3, w - 3):
            column = int(mask[y - 1, x] > 0) + int(mask[y, x] > 0) + int(mask[y + 1, x] > 0)
            line = int(mask[y, x - 1] > 0) + int(mask[y, x] > 0) + int(mask[y, x + 1] > 0)
            if column in (0, 3) or line in (0, 3):
                continue
            least = dark[y - 3, x - 3]
            if mask[y, x] and small[y, x] < least + OWN_CONTRAST:
                mask[y, x] = 0
            if not mask[y, x] and small[y, x] > least + OWN_CONTRAST:
                mask[y, x] = 255
            if any(not mask[y, x + s] and small[y, x + s] > least + SIDE_CONTRAST for s in (-1, 1)):
                mask[y, x] = 255
    return mask


def relaxed(surface: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Successive over-relaxation towards the mean of four neighbours inside the mask, row by row."""
    surface = surface.astype(np.float64)
    inner = np.zeros(mask.shape, bool)
    inner[1:-1, 1:-1] = mask[1:-1, 1:-1] != 0
    places = np.argwhere(inner).tolist()
    for _ in range(ROUNDS):
        for y, x in places:
            mean = 0.25 * (surface[y - 1, x] + surface[y, x - 1] + surface[y + 1, x] + surface[y, x + 1])
            surface[y, x] = FACTOR * mean + (1 - FACTOR) * surface[y, x]
    return surface


def put_back(image: np.ndarray, surface: np.ndarray, mask: np.ndarray, seams: bool) -> np.ndarray:
    """Each masked half-size pixel into its four pixels; with seams the pixels beside them that are much brighter are brought half way down."""
    out = image.copy()
    for y, x in np.argwhere(mask[1:-1, 1:-1] != 0).tolist():
        y, x = y + 1, x + 1
        v = min(255.0, max(0.0, float(surface[y, x])))
        out[2 * y : 2 * y + 2, 2 * x : 2 * x + 2] = int(v)
        for r in (2 * y, 2 * y + 1) if seams else ():
            for c in (2 * x - 1, 2 * x + 2):
                if c < out.shape[1] and out[r, c] > v + SEAM:
                    out[r, c] = int((out[r, c] + v) / 2)
    return out


def mask_of(image: np.ndarray) -> np.ndarray:
    small = halved(image)
    found = refined(spots(small), small)
    return put_back(np.zeros_like(image), found, found, False)


def removed(image: np.ndarray) -> np.ndarray:
    small = halved(image)
    mask = refined(spots(small), small)
    surface = relaxed(small, mask)
    # What relaxation made brighter in a dark place was no glint.
    wrong = np.zeros(mask.shape, bool)
    wrong[2:-2, 2:-2] = ((mask == 255) & (surface > small + GAIN) & (small < DARK))[2:-2, 2:-2]
    mask = np.where(wrong, 0, mask)
    return put_back(image, relaxed(surface, mask), mask, True)


def removed_by(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    small = halved(image)
    own = mask[0 : 2 * small.shape[0] : 2, 0 : 2 * small.shape[1] : 2]
    return put_back(image, relaxed(small, own), own, False)


def glint_mask(df: DataFrame) -> DataFrame:
    """255 where a glint was found, else 0. Images of fewer than 8 x 8 pixels have none."""
    return by_image(df, mask_of)


def without_glints(df: DataFrame) -> DataFrame:
    """The images with their glints filled."""
    return by_image(df, removed)


def filled(df: DataFrame, mask: str = "m") -> DataFrame:
    """The images (img_id, y, x, v, m) with the pixels of a given mask filled."""
    return by_image(df, removed_by, mask)
