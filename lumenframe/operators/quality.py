"""Image quality: sharpness from an energy pyramid, noise from what a median takes away, motion from half frames."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import along, at, down, inner, stencil, whole
from .edges import SOBEL_X, SOBEL_Y
from .morphology import median3x3
from .transport import split_half_frames


def halved(df: DataFrame) -> DataFrame:
    """Half size, rounded up: rounded means of 2 x 2 pixels, or of the two or one that an odd edge leaves. df has all pixels of each image."""
    cells = df.groupBy("img_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return cells.select("img_id", "y", "x", F.expr("cast((s + n div 2) div n as int)").alias("v"))


def residue(df: DataFrame, small: DataFrame, smooth: bool = True) -> DataFrame:
    """(img_id, y, x, d): the half-size image, brought up again, less the image.

    A pixel takes 5/8 of its parent and 1/8 of the three parents around its corner, the edge repeated; along an odd edge 3/4 and 1/4 of the two along
    it, and an odd corner has none. Without smooth a pixel takes its parent alone.
    """
    p = small
    if smooth:
        p = p.withColumns({"l": F.coalesce(at("v", -1, along()), F.col("v")), "r": F.coalesce(at("v", 1, along()), F.col("v"))})
        p = p.withColumns({f"{k}{c}": F.coalesce(at(c, by, down()), F.col(c)) for k, by in (("u", -1), ("d", 1)) for c in ("v", "l", "r")})
    parts = p.select("img_id", F.col("y").alias("py"), F.col("x").alias("px"), F.struct(*(c for c in p.columns if c not in ("img_id", "y", "x"))).alias("p"))
    own = df.withColumns({"lone_x": (F.col("x") % 2 == 0) & (F.max("x").over(whole()) == F.col("x")), "lone_y": (F.col("y") % 2 == 0) & (F.max("y").over(whole()) == F.col("y"))})
    own = own.withColumns({"py": F.expr("cast(y div 2 as int)"), "px": F.expr("cast(x div 2 as int)")}).join(parts, ["img_id", "py", "px"])
    if not smooth:
        return own.select("img_id", "y", "x", (F.col("p.v") - F.col("v")).alias("d"))
    side = lambda pre="": F.when(F.col("x") % 2 == 0, F.col(f"p.{pre}l")).otherwise(F.col(f"p.{pre}r"))
    over = lambda c: F.when(F.col("y") % 2 == 0, F.col(f"p.u{c}")).otherwise(F.col(f"p.d{c}"))
    corner = F.when(F.col("y") % 2 == 0, side("u")).otherwise(side("d"))
    own = own.withColumns({"v0": F.col("p.v"), "vx": side(), "vy": over("v"), "vc": corner})
    up = F.when(F.col("lone_x") & F.col("lone_y"), F.lit(None)).when(F.col("lone_x"), F.expr("(3 * v0 + vy + 2) div 4")).when(F.col("lone_y"), F.expr("(3 * v0 + vx + 2) div 4")).otherwise(F.expr("(5 * v0 + vx + vy + vc + 4) div 8"))
    return own.select("img_id", "y", "x", (up - F.col("v")).cast("int").alias("d"))


def level_energy(df: DataFrame, small: DataFrame) -> DataFrame:
    """(img_id, e): 256 times the root mean square of the residue, rounded down; the mean is over all pixels. Pixels whose m is 0, if df has a column m, take no part."""
    found = residue(df.select("img_id", "y", "x", "v"), small.select("img_id", "y", "x", "v"))
    if "m" in df.columns:
        found = found.join(df.filter("m <> 0").select("img_id", "y", "x"), ["img_id", "y", "x"])
    return found.groupBy("img_id").agg(F.floor(F.sqrt(F.sum(F.col("d") * F.col("d")).cast("double") / F.count(F.lit(1))) * 256).cast("int").alias("e"))


def energies(df: DataFrame, least: int = 1) -> DataFrame:
    """(img_id, level, e): level_energy() / 2^(level / 2), rounded down, of the image and its half sizes as long as both sides exceed `least`.

    With a column m, a mask, a half-size pixel belongs to it if all its pixels do, and a level without such pixels has energy 0.
    """
    side = (df.groupBy("img_id").agg(F.least(F.max("x"), F.max("y")).alias("k")).agg(F.max("k")).first()[0] or 0) + 1
    found, now, level = [], df, 0
    while side > least:
        # An image that is down to `least` has no further levels.
        now = now.withColumn("__k", F.least(F.max("x").over(whole()), F.max("y").over(whole()))).filter(F.col("__k") >= least).drop("__k")
        small = halved(now)
        own = level_energy(now, small)
        if "m" in df.columns:
            held = now.groupBy("img_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.min(F.when(F.col("m") != 0, 1).otherwise(0)).alias("m"))
            small = small.join(held, ["img_id", "y", "x"])
            own = now.select("img_id").distinct().join(own, "img_id", "left").select("img_id", F.coalesce("e", F.lit(0)).alias("e"))
        found.append(own.select("img_id", F.lit(level).alias("level"), F.floor(F.col("e") / F.pow(F.lit(2.0), F.lit(level / 2))).cast("int").alias("e")))
        now, level, side = small, level + 1, (side + 1) // 2
    if not found:
        return df.sparkSession.createDataFrame([], f"img_id {df.schema['img_id'].dataType.simpleString()}, level int, e int")
    return functools.reduce(DataFrame.unionByName, found)


def sharpness(df: DataFrame) -> DataFrame:
    """(img_id, sharpness): minus 100 times the slope of the energies over the levels, the last level left out, in whole numbers; 0 with fewer than two levels."""
    e = energies(df).withColumn("n", F.count(F.lit(1)).over(whole()) - 1).filter("level < n")
    sums = e.groupBy("img_id", "n").agg(F.sum("e").cast("long").alias("sy"), F.sum(F.col("e") * F.col("level")).cast("long").alias("sxy"))
    return sums.select("img_id", F.expr("cast(case when n < 2 then 0 else -((600 * (2 * sxy - (n - 1) * sy)) div ((n - 1) * n * (n + 1))) end as int)").alias("sharpness"))


def masked_sharpness(df: DataFrame) -> DataFrame:
    """(img_id, sharpness) inside the mask m: energies of the second and third level less those of the last two, down to a size of 16; null without energy."""
    e = energies(df, 16).groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("level", "e"))).alias("e")).select("img_id", F.transform("e", lambda x: x["e"]).alias("e"))
    total = F.aggregate("e", F.lit(0), lambda a, x: a + x)
    value = F.get("e", F.lit(1)) + F.get("e", F.lit(2)) - F.get("e", F.size("e") - 2) - F.get("e", F.size("e") - 1)
    return e.select("img_id", F.when(total > 0, value).alias("sharpness"))


def small_sobel(df: DataFrame) -> DataFrame:
    """(img_id, y, x, v) for inner pixels: an eighth of the sum of both Sobel lengths, at most 255."""
    out = stencil(stencil(df, SOBEL_X, "gx"), SOBEL_Y, "gy").withColumn("in", inner(1, 1)).filter("in")
    return out.select("img_id", "y", "x", F.least(F.lit(255), F.expr("(abs(gx) + abs(gy)) div 8")).cast("int").alias("v"))


def motion(df: DataFrame) -> DataFrame:
    """(img_id, motion): 64 times the mean distance of the Sobel images of both half frames, rounded down."""
    half = lambda r: df.filter(F.col("y") % 2 == r).select("img_id", F.expr("cast(y div 2 as int)").alias("y"), "x", "v")
    even, odd = small_sobel(half(0)), small_sobel(half(1)).withColumnRenamed("v", "v2")
    return even.join(odd, ["img_id", "y", "x"]).groupBy("img_id").agg(F.sum(F.abs(F.col("v") - F.col("v2"))).alias("s"), F.count(F.lit(1)).alias("n")).select("img_id", F.expr("cast((64 * s) div n as int)").alias("motion"))


def minimum(f, a: float, b: float, c: float, eps: float) -> tuple[float, float]:
    """(place, value) of the minimum of f between a and c, b being between them, by golden sections; ends when the bracket is eps of the places."""
    # Fixed value: the golden section, as a 32-bit float.
    golden = float(np.float32(0.61803399))
    ends = [a, c]
    inside = [b, b + (1 - golden) * (c - b)] if abs(c - b) > abs(b - a) else [b - (1 - golden) * (b - a), b]
    values = [f(x) for x in inside]
    while abs(ends[1] - ends[0]) > eps * (abs(inside[0]) + abs(inside[1])):
        if values[1] > values[0]:
            ends[1] = inside[1]
            inside = [golden * inside[0] + (1 - golden) * ends[0], inside[0]]
            values = [f(inside[0]), values[0]]
        else:
            ends[0] = inside[0]
            inside = [inside[1], golden * inside[1] + (1 - golden) * ends[1]]
            values = [values[1], f(inside[1])]
    k = 0 if values[0] < values[1] else 1
    return inside[k], values[k]


def decay_error(hist: np.ndarray):
    """The squared distance of a histogram of 256 bins from a geometric one of equal mass, as a function of the decay."""
    mass, places = float(hist.sum()), np.arange(256)

    def f(decay: float) -> float:
        if decay < 0:
            return 1e100
        first = 1 / 256 if decay == 0 else (1 - np.exp(-decay)) / (1 - np.exp(-256 * decay))
        return float(((first * mass * np.exp(-decay * places) - hist) ** 2).sum())

    return f


def noise(df: DataFrame) -> DataFrame:
    """(img_id, noise): 1000 times the decay that best fits the histogram of what a 3 x 3 median of the split half frames takes away, rounded down; small if noise is strong."""
    frames = split_half_frames(df)
    taken = median3x3(frames).withColumnRenamed("v", "m").join(frames, ["img_id", "y", "x"])
    hist = taken.groupBy("img_id", F.abs(F.col("m") - F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # 256 rows an image

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.bincount(pdf["bin"], weights=pdf["n"], minlength=256)
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[:1], "noise": [int(minimum(decay_error(counts), 0.0, 1.0, 10.0, 1e-6)[0] * 1000)]})

    return hist.groupBy("img_id").applyInPandas(fit, f"img_id {df.schema['img_id'].dataType.simpleString()}, noise int")
