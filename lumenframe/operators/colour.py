"""Fixed-point affine resampling of grey, colour (r, g, b) and Bayer images (rows R G R G, G B G B), and colour to grey."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import whole

# Fixed value: places have 16 bits after the point.
ONE = 1 << 16
RGB = ("r", "g", "b")


def places(df: DataFrame, matrix: tuple[float, float, float, float], height: int, width: int, origin: tuple[float, float] = (0.0, 0.0), steps: tuple[int, ...] | None = None) -> DataFrame:
    """(img_id, y, x, gy, gx, inside): where each destination pixel lies in the source, in 2^-16 pixels; inside: all four pixels around it exist.

    matrix (a, b, c, d) maps (x, y) to (a x + b y, c x + d y); its rounded steps may be given instead.
    """
    a, b, c, d = steps or (math.trunc(m * ONE + 0.5) for m in matrix)
    ox, oy = (math.trunc(o * ONE) for o in origin)
    images = df.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    grid = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    grid = grid.withColumns({"gx": F.col("x").cast("long") * a + F.col("y") * b + ox, "gy": F.col("x").cast("long") * c + F.col("y") * d + oy})
    return grid.withColumn("inside", F.expr("gx >= 0 and shiftright(gx, 16) + 1 < w and gy >= 0 and shiftright(gy, 16) + 1 < h")).drop("h", "w")


def around(df: DataFrame, where: DataFrame, channels: tuple[str, ...], total: bool = False) -> DataFrame:
    """Bilinear values of the channels at `where`, rounded; with total one value v, the mean of all channels. Outside they are 0."""
    corner = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))).alias("k")
    part = lambda g, k: F.when(F.col(k) == 1, F.shiftright(F.col(g).bitwiseAND(0xFFFF), 8)).otherwise(F.shiftright(ONE - F.col(g).bitwiseAND(0xFFFF), 8))
    p = where.select("*", corner).select(
        "img_id", "y", "x", "inside", (part("gy", "k.dy") * part("gx", "k.dx")).alias("wt"), (F.shiftright("gy", 16) + F.col("k.dy")).cast("int").alias("sy"), (F.shiftright("gx", 16) + F.col("k.dx")).cast("int").alias("sx")
    )
    src = df.select("img_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *channels)
    met = p.join(src, ["img_id", "sy", "sx"], "left").groupBy("img_id", "y", "x", "inside").agg(*(F.sum(F.col("wt") * F.col(c)).alias(c) for c in channels))
    if total:
        value = F.shiftright(F.call_function("div", sum((F.col(c) for c in channels[1:]), F.col(channels[0])) + len(channels) * (ONE // 2), F.lit(len(channels))), 16)
        return met.select("img_id", "y", "x", F.when(F.col("inside"), value).otherwise(0).cast("int").alias("v"))
    return met.select("img_id", "y", "x", *(F.when(F.col("inside"), F.shiftright(F.col(c) + ONE // 2, 16)).otherwise(0).cast("int").alias(c) for c in channels))


def nearest(df: DataFrame, where: DataFrame, channels: tuple[str, ...], down: bool = False) -> DataFrame:
    """The channels of the pixel nearest to each place, or of the one left above it; outside they are 0."""
    side = lambda g: F.shiftright(g, 16) + (F.lit(0) if down else (F.col(g).bitwiseAND(0xFFFF) > ONE // 2).cast("int"))
    src = df.select("img_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *channels)
    met = where.withColumns({"sy": side("gy").cast("int"), "sx": side("gx").cast("int")}).join(src, ["img_id", "sy", "sx"], "left")
    return met.select("img_id", "y", "x", *(F.when(F.col("inside"), F.col(c)).otherwise(0).cast("int").alias(c) for c in channels))


def affine_rgb(df: DataFrame, matrix, height: int, width: int, origin=(0.0, 0.0), smooth: bool = True) -> DataFrame:
    at = places(df, matrix, height, width, origin)
    return around(df, at, RGB) if smooth else nearest(df, at, RGB)


def affine_rgb_to_grey(df: DataFrame, matrix, height: int, width: int, origin=(0.0, 0.0)) -> DataFrame:
    return around(df, places(df, matrix, height, width, origin), RGB, total=True)


def affine_luma(df: DataFrame, matrix, height: int, width: int, origin=(0.0, 0.0), channel: str = "v") -> DataFrame:
    """Of an image with luma and colour the luma alone counts."""
    return around(df, places(df, matrix, height, width, origin), (channel,)).withColumnRenamed(channel, "v")


def bayer_cells(df: DataFrame) -> DataFrame:
    """(img_id, y, x, r, g, b): each 2 x 2 cell's red, the green beside it and the blue; odd edges go."""
    pick = lambda dy, dx, name: F.max(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col("v"))).alias(name)
    full = df.withColumns({"__h": F.max("y").over(whole()) + 1, "__w": F.max("x").over(whole()) + 1}).filter("y < __h - __h % 2 and x < __w - __w % 2")
    return full.groupBy("img_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(pick(0, 0, "r"), pick(0, 1, "g"), pick(1, 1, "b"))


def affine_bayer_to_grey(df: DataFrame, matrix, height: int, width: int, origin=(0.0, 0.0), smooth: bool = True) -> DataFrame:
    """Grey from Bayer cells; steps count pixels, of which a cell has two each way. Not smooth: the mean of the three colours of the cell, rounded down."""
    cells = bayer_cells(df)
    at = places(cells, tuple(m / 2 for m in matrix), height, width, origin)
    if smooth:
        return around(cells, at, RGB, total=True)
    return nearest(cells, at, RGB, down=True).select("img_id", "y", "x", F.expr("cast((r + g + b) div 3 as int)").alias("v"))


def scale(width: int, height: int, to_width: int, to_height: int) -> tuple[float, float, float, float]:
    """The matrix that brings a width x height image to another size."""
    return (width / to_width, 0.0, 0.0, height / to_height)


def crop(df: DataFrame, y: int, x: int, h: int, w: int, out_h: int, out_w: int, y_to: int = 0, x_to: int = 0) -> DataFrame:
    """An out_h x out_w image of zeros that holds the source's rectangle at (y_to, x_to), as far as it lies in both."""
    part = df.filter((F.col("y") >= max(0, y)) & (F.col("x") >= max(0, x)) & (F.col("y") < y + h) & (F.col("x") < x + w))
    moved = part.select("img_id", (F.col("y") - max(0, y) + y_to).alias("y"), (F.col("x") - max(0, x) + x_to).alias("x"), "v").filter((F.col("y") < out_h) & (F.col("x") < out_w))
    grid = df.select("img_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))))
    return grid.join(moved, ["img_id", "y", "x"], "left").select("img_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


def rotate_scale(df: DataFrame, angle: float, height: int, width: int, roi: tuple[float, float, float, float]) -> DataFrame:
    """A region (x, y, w, h) turned by `angle` and brought to another size; sines have 20 bits, steps 16."""
    x, y, w, h = roi
    from_20 = lambda f: math.floor(f(angle) * (1 << 20) + 0.5)
    c, s = from_20(math.cos), from_20(math.sin)
    steps = (math.trunc(c * w / (width << 4)), -math.trunc(s * h / (height << 4)), math.trunc(s * w / (width << 4)), math.trunc(c * h / (height << 4)))
    return around(df, places(df, (), height, width, (x, y), steps), ("v",))
