"""From an eye image to the circles of pupil and iris: glints filled, edges, gradient pairs that vote for centres, radii from aligned edge points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, at, down, mirrored
from ..functions.tables import held
from . import edges
from .components import reached
from .filters import blur3x3_sum, blur5x5
from .glints import without_glints
from .morphology import dilate_cross

# Half width of the directions that pair, largest difference of a pair's radii, least radius, margin without edge points.
TURN, HALF_TURN, APART, LEAST, MARGIN = 120, 17, 2, 20, 10
# Limits of the thresholds and of the smoothing, by the median's share of the maximum.
LOW, HIGH, SIGMA, MOST_SIGMA = (0.55, 0.8), (0.8, 1.33), (2.0, 2.5), 4.5
# Fixed value: cosine above which an edge point is aligned with its radius.
ALIGNED = 0.96
# The large kernel's weights along the edge; across it are 1 at -10 and -1 at 10.
WIDE = [1, 1, 2, 2, 4, 5, 7, 8, 10, 11, 11, 11, 10, 8, 7, 5, 4, 2, 2, 1, 1]


def levels(df: DataFrame) -> DataFrame:
    """(img_id, sigma, low, high): smoothing and thresholds from the share of the median in the largest value."""
    ranked = df.groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ranked.withColumns({"cum": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("img_id")), "top": F.max("v").over(Window.partitionBy("img_id"))})
    middle = cum.filter(F.expr("cum > all div 2 + all % 2")).groupBy("img_id", "top").agg(F.min("v").alias("med"))
    share = F.col("med") / F.greatest(F.col("top"), F.lit(1))
    return middle.select("img_id", F.least(F.lit(MOST_SIGMA), SIGMA[0] + SIGMA[1] * share).alias("sigma"), F.greatest(F.lit(LOW[0]), LOW[1] * share).alias("low"), F.least(F.lit(HIGH[0]), HIGH[1] * share).alias("high"))


def edge_points(df: DataFrame, blurred: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(img_id, y, x, gx, gy, dir, h, w): edges of the blurred image with thresholds from df, away from the border; dir in whole degrees."""
    own = levels(df)
    size = df.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    peaks = edges.thinned(edges.smoothed(blurred.join(own.select("img_id", "sigma"), "img_id"), F.col("sigma"), MOST_SIGMA)).join(own.select("img_id", "low", "high"), "img_id")
    limits = edges.thresholds(peaks, "low", "high")
    marked = peaks.join(limits, "img_id").filter("mag >= hi or mag > lo").select("img_id", "y", "x", "gx", "gy", (F.col("mag") >= F.col("hi")).alias("seed"))
    inside = reached(marked).join(size, "img_id").filter(f"y >= {margin} and x >= {margin} and y < h - {margin} and x < w - {margin}")
    turn = F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))) + 0.5
    return inside.select("img_id", "y", "x", "gx", "gy", turn.cast("int").alias("dir"), "h", "w")


def pair_circles(points: DataFrame, turn: int = TURN, half: int = HALF_TURN, apart: int = APART, least: int = LEAST) -> DataFrame:
    """(img_id, yc, xc, r): the circles through pairs of points whose directions differ by turn - half to turn + half degrees, the latter left out.

    Points meet by bins of directions as wide as the span, so a point looks at two bins of its image.
    """
    size = 2 * half
    bins = -(-360 // size)
    d = F.pmod(F.col("dir"), F.lit(360))
    start = F.pmod(d + turn - half, F.lit(360))
    a = points.select("img_id", "h", "w", *(F.col(c).alias(f"{c}1") for c in ("y", "x", "gx", "gy")), d.alias("d1"), F.explode(F.array_distinct(F.array(F.floor(start / size), F.pmod(F.floor(start / size) + 1, F.lit(bins)), F.floor(F.pmod(start + size - 1, F.lit(360)) / size)))).alias("bin"))
    b = points.select("img_id", *(F.col(c).alias(f"{c}2") for c in ("y", "x", "gx", "gy")), d.alias("d2"), F.floor(d / size).alias("bin"))
    pairs = a.join(b, ["img_id", "bin"]).filter(F.pmod(F.col("d2") - F.col("d1") - turn + half, F.lit(360)) < size)
    cross = (F.col("gx2") * F.col("gy1") - F.col("gy2") * F.col("gx1")).cast("double")
    t = (F.col("gx2") * (F.col("y2") - F.col("y1")) - F.col("gy2") * (F.col("x2") - F.col("x1"))) / cross
    met = pairs.withColumn("c", cross).filter("c <> 0").withColumn("t", t).withColumns({"fx": F.col("x1") + F.col("t") * F.col("gx1"), "fy": F.col("y1") + F.col("t") * F.col("gy1")})
    met = met.filter("fx >= 1 and fy >= 1 and fx < w - 1 and fy < h - 1")
    far = lambda k: F.sqrt((F.col("fx") - F.col(f"x{k}")) * (F.col("fx") - F.col(f"x{k}")) + (F.col("fy") - F.col(f"y{k}")) * (F.col("fy") - F.col(f"y{k}")))
    ok = met.withColumns({"r1": far(1), "r2": far(2)}).filter((F.abs(F.col("r1") - F.col("r2")) < apart) & (F.greatest("r1", "r2") >= least))
    return ok.select("img_id", F.col("fy").cast("int").alias("yc"), F.col("fx").cast("int").alias("xc"), ((F.col("r1") + F.col("r2")) / 2).cast("int").alias("r"))


def best(circles: DataFrame, grid: DataFrame, margin: int) -> DataFrame:
    """(img_id, yc, xc): the place of most votes after two 3 x 3 blurs, the first by rows of equal ones; images without a vote are left out."""
    votes = circles.groupBy("img_id", F.col("yc").alias("y"), F.col("xc").alias("x")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    counted = grid.join(votes, ["img_id", "y", "x"], "left").select("img_id", "y", "x", F.coalesce("n", F.lit(0)).alias("v"))
    blurred = blur3x3_sum(blur3x3_sum(counted))
    ends = Window.partitionBy("img_id")
    inner = blurred.withColumns({"h": F.max("y").over(ends), "w": F.max("x").over(ends)}).filter(f"v > 0 and y >= {margin} and x >= {margin} and y <= h - {margin} and x <= w - {margin}")
    first = Window.partitionBy("img_id").orderBy(F.desc("v"), "y", "x")
    return inner.withColumn("k", F.row_number().over(first)).filter("k = 1").select("img_id", F.col("y").alias("yc"), F.col("x").alias("xc"))


def blurred_line(values: np.ndarray, half: int) -> np.ndarray:
    """Sums over 2 half + 1 places; beyond the ends the end values count on."""
    wide = np.pad(values, half, mode="edge")
    return np.convolve(wide, np.ones(2 * half + 1), "valid")


def first_radius(hist: np.ndarray, least: int) -> tuple[int, np.ndarray]:
    """(radius, smoothed histogram): most points for the length of the circle, after two sums over 11 places; 0 if there is none."""
    share = hist.astype(np.float64)
    share[1:] /= np.arange(1, len(hist))
    once = blurred_line(share, 5)
    once[0] = share[0]
    twice = blurred_line(once, 5)
    tail = twice[least:]
    return (least + int(tail.argmax()) if len(tail) and tail.max() > 0 else 0), twice


def second_radius(smooth: np.ndarray, radius: int, least: int) -> int:
    """The best radius that is neither near the first one nor very small; of equal ones the largest."""
    rest = smooth.copy()
    rest[: max(radius // 7, least) + 1] = 0
    rest[3 * radius // 4 : 4 * radius // 3] = 0
    rest = blurred_line(rest, 3)
    tail = rest[least + 1 :]
    return len(rest) - 1 - int(tail[::-1].argmax()) if len(tail) and tail.max() > 0 else 0


def radii(points: DataFrame, centres: DataFrame, least: int) -> DataFrame:
    """(img_id, r1, r2): both radii around each image's centre. The histogram that is worked on has half as many bins as the longer side."""
    p = points.join(centres, "img_id").withColumns({"dx": F.col("x") - F.col("xc"), "dy": F.col("y") - F.col("yc")})
    p = p.withColumns({"d": F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")), "along": F.abs(F.col("dx") * F.col("gx") + F.col("dy") * F.col("gy")) / F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")), "most": F.expr("greatest(h, w) div 2")})
    hist = p.filter((F.col("d") >= least) & (F.col("d") < F.col("most")) & (F.floor("along") / F.col("d") > ALIGNED)).groupBy("img_id", "most", F.floor(F.col("d") + 0.5).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["most"].iloc[0])
        counts = np.bincount(pdf["r"], weights=pdf["n"], minlength=size + 1)[:size]
        one, smooth = first_radius(counts, least)
        return pd.DataFrame({"img_id": pdf["img_id"].iloc[:1], "r1": [one], "r2": [second_radius(smooth, one, least)]})

    return hist.groupBy("img_id").applyInPandas(measured, f"img_id {points.schema['img_id'].dataType.simpleString()}, r1 int, r2 int")


def both_borders(df: DataFrame, blurred: DataFrame, turn: int = TURN, least: int = LEAST, margin: int = MARGIN) -> DataFrame:
    """(img_id, px, py, pr, ix, iy, ir): the smaller and the larger of two borders, by votes of gradient pairs; images without enough edges are left out.

    The second centre comes from circles near the first one whose radii are clearly different; it stands only if it is near the first centre.
    """
    points = held(edge_points(df, blurred, margin), "seg-points")
    circles = held(pair_circles(points, turn, least=least), "seg-circles")
    grid = df.select("img_id", "y", "x")
    top = held(best(circles, grid, 1), "seg-centres")
    sized = held(top.join(radii(points, top, least), "img_id").withColumns({"cx": F.col("xc") + 1, "cy": F.col("yc") + 1}), "seg-radii")
    near = circles.join(sized.select("img_id", "cx", "cy", "r1"), "img_id").withColumn("away", F.expr("(xc - cx) * (xc - cx) + (yc - cy) * (yc - cy)"))
    near = near.filter(F.expr("away <= (r1 div 5) * (r1 div 5) and (r < 3 * r1 div 4 or r > 4 * r1 div 3)")).select("img_id", "yc", "xc")
    second = best(near, grid, margin).select("img_id", F.col("xc").alias("x2"), F.col("yc").alias("y2"))
    both = sized.join(second, "img_id", "left").withColumn("stands", F.expr("coalesce((x2 - cx) * (x2 - cx) + (y2 - cy) * (y2 - cy) < (r1 div 5) * (r1 div 5), false)"))
    both = both.withColumns({"x2": F.when(F.col("stands"), F.col("x2")).otherwise(F.col("cx")), "y2": F.when(F.col("stands"), F.col("y2")).otherwise(F.col("cy")), "swap": F.col("r2") > F.col("r1")})
    pick = lambda a, b: F.when(F.col("swap"), F.col(a)).otherwise(F.col(b))
    return both.select("img_id", pick("cx", "x2").alias("px"), pick("cy", "y2").alias("py"), pick("r1", "r2").alias("pr"), pick("x2", "cx").alias("ix"), pick("y2", "cy").alias("iy"), pick("r2", "r1").alias("ir"))


def segmented(df: DataFrame, turn: int = TURN, least: int = LEAST, margin: int = MARGIN) -> DataFrame:
    """both_borders() of eye images (img_id, y, x, v), glints filled and blurred twice first. An empty table gives an empty result."""
    plain = held(without_glints(df), "seg-plain")
    return both_borders(plain, blur5x5(blur5x5(plain)), turn, least, margin)


def scored(found: DataFrame, markup: DataFrame) -> DataFrame:
    """(img_id, ctr, pup, iri, total) of found circles against an expert's (img_id, px, py, pr, ix, iy, ir): centre distances, pupil and iris radius errors over the iris radius."""
    names = ["px", "py", "pr", "ix", "iy", "ir"]
    both = found.join(markup.select("img_id", *(F.col(c).alias(f"e_{c}") for c in names)), "img_id")
    away = lambda k: F.sqrt((F.pow(F.col(f"{k}x") - F.col(f"e_{k}x"), F.lit(2)) + F.pow(F.col(f"{k}y") - F.col(f"e_{k}y"), F.lit(2))).cast("double"))
    r = F.col("e_ir").cast("double")
    out = both.select("img_id", ((away("p") + away("i")) / r).alias("ctr"), (F.abs(F.col("pr") - F.col("e_pr")) / r).alias("pup"), (F.abs(F.col("ir") - F.col("e_ir")) / r).alias("iri"))
    return out.withColumn("total", F.col("ctr") + F.col("pup") + F.col("iri"))


def sobel_wide(df: DataFrame) -> DataFrame:
    """(img_id, y, x, gx, gy, mag): differences between the weighted lines ten pixels before and after, the image mirrored at its edges; mag is their length, rounded down."""
    half = len(WIDE) // 2
    m = mirrored(df, half, half)
    total = lambda over: sum((at("v", k - half, over) * w for k, w in enumerate(WIDE[1:], 1)), at("v", -half, over) * WIDE[0])
    m = m.withColumns({"a": total(along()), "b": total(down())})
    m = m.withColumns({"gy": at("a", -half, down()) - at("a", half, down()), "gx": at("b", -half, along()) - at("b", half, along())}).filter("gx is not null and gy is not null")
    return m.select("img_id", "y", "x", "gx", "gy", F.floor(F.sqrt((F.col("gx").cast("long") * F.col("gx") + F.col("gy").cast("long") * F.col("gy")).cast("double"))).cast("int").alias("mag"))


def selected(gradient: DataFrame) -> DataFrame:
    """sobel_wide() with lengths outside the ranks 3/4 and 99/100 set to 0, each rank plus one."""
    order = Window.partitionBy("img_id").orderBy("mag")
    ranked = gradient.withColumns({"k": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("img_id"))})
    limits = ranked.groupBy("img_id").agg(F.max(F.when(F.expr("k = 3 * n div 4 + 2"), F.col("mag"))).alias("low"), F.max(F.when(F.expr("k = 99 * n div 100 + 2"), F.col("mag"))).alias("high"))
    keep = (F.col("mag") >= F.col("low")) & (F.col("mag") <= F.coalesce("high", "mag"))
    return gradient.join(limits, "img_id").select("img_id", "y", "x", *(F.when(keep, F.col(c)).otherwise(0).alias(c) for c in ("gx", "gy", "mag")))


def scaled(gradient: DataFrame) -> DataFrame:
    """(img_id, y, x, v): lengths as shares of the largest, 255 at most."""
    return gradient.select("img_id", "y", "x", F.floor(F.col("mag") / F.greatest(F.max("mag").over(Window.partitionBy("img_id")), F.lit(1)) * 255).cast("int").alias("v"))


def iris_gradient(df: DataFrame, circles: DataFrame) -> DataFrame:
    """(img_id, y, x, v): scaled wide gradient of the image, dilated by a cross and blurred, outside 4/3 of the pupil radius around the iris centre, where it points
    within 31 degrees along the radius; 0 elsewhere and within ten pixels of the border."""
    g = sobel_wide(blur5x5(dilate_cross(df)))
    ends = Window.partitionBy("img_id")
    g = g.join(scaled(g).withColumnRenamed("v", "s"), ["img_id", "y", "x"]).withColumns({"eh": F.max("y").over(ends), "ew": F.max("x").over(ends)}).join(circles.select("img_id", "ix", "iy", "pr"), "img_id")
    g = g.withColumns({"dx": F.col("x") - F.col("ix"), "dy": F.col("y") - F.col("iy")}).withColumn("d2", F.expr("dx * dx + dy * dy"))
    cosine = (F.col("dx") * F.col("gx") + F.col("dy") * F.col("gy")) / F.sqrt((F.col("gx").cast("long") * F.col("gx") + F.col("gy").cast("long") * F.col("gy")).cast("double")) / F.sqrt(F.col("d2").cast("double"))
    ok = F.expr("x >= 10 and y >= 10 and x <= ew - 10 and y <= eh - 10 and d2 > 16 * pr * pr div 9 and (gx <> 0 or gy <> 0) and sqrt(d2) < least(eh + 1, ew + 1) div 2")
    return g.select("img_id", "y", "x", F.when(ok & (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) < 31), F.col("s")).otherwise(0).alias("v"))
