"""Rank filters on boxes and circles, chessboard crosses, smoothing by 1 4 6 4 1, spread statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, at, down, inner, replicate
from . import histograms
from .filters import pixels


def box_values(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """Adds s, the sorted values of the box around each pixel, cut at the edge."""
    rows = F.collect_list("v").over(along().rowsBetween(-hx, hx))
    return df.withColumn("__r", rows).withColumn("s", F.sort_array(F.flatten(F.collect_list("__r").over(down().rowsBetween(-hy, hy))))).drop("__r")


def median(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """Median of the box; the border is replicated."""
    n = (2 * hy + 1) * (2 * hx + 1)
    out = box_values(df, hy, hx).withColumn("s", F.when(inner(hy, hx), F.get("s", F.lit(n // 2))))
    return pixels(replicate(out, ["s"], hy, hx), F.col("s"))


def to_extreme(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """The box's largest value where its median lies above the middle of its range, its smallest where it lies below, else the middle; the border is replicated."""
    n = (2 * hy + 1) * (2 * hx + 1)
    out = box_values(df, hy, hx).withColumns({"lo": F.get("s", F.lit(0)), "hi": F.get("s", F.size("s") - 1), "me": F.get("s", F.lit(n // 2))}).withColumn("mid", F.expr("(lo + hi) div 2"))
    out = out.withColumn("s", F.when(F.col("me") > F.col("mid"), F.col("hi")).when(F.col("me") < F.col("mid"), F.col("lo")).otherwise(F.col("mid")))
    return pixels(replicate(out, ["s"], hy, hx), F.col("s"))


def line_median(df: DataFrame, row: int, half: int) -> DataFrame:
    """(img_id, x, v): median of the square around each pixel of one row; columns beyond the edge repeat the outermost. The row moves inside until the square fits."""
    whole = Window.partitionBy("img_id")
    near = df.withColumn("__h", F.max("y").over(whole)).withColumn("__y", F.least(F.greatest(F.lit(row), F.lit(half)), F.col("__h") - half))
    columns = near.filter(f"y >= __y - {half} and y <= __y + {half} and __h >= {2 * half}").groupBy("img_id", "x").agg(F.collect_list("v").alias("c"))
    over = Window.partitionBy("img_id").orderBy("x")
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = columns.withColumns({"first": F.first("c").over(everything), "last": F.last("c").over(everything), "e": F.max("x").over(whole), "box": F.flatten(F.collect_list("c").over(over.rowsBetween(-half, half)))})
    repeat = lambda c, n: F.flatten(F.array_repeat(c, F.greatest(F.lit(0), n)))
    values = F.sort_array(F.concat("box", repeat("first", half - F.col("x")), repeat("last", F.col("x") + half - F.col("e"))))
    return out.select("img_id", "x", F.get(values, F.lit((2 * half + 1) ** 2 // 2)).alias("v"))


def circular_median(seq: DataFrame, size: int, key: str, value: str = "v") -> DataFrame:
    """(key, i, v): of `size` places on a circle, size div 2 of them before, the value of rank size div 2."""
    before = size // 2
    whole = Window.partitionBy(key)
    wide = seq.withColumn("__n", F.max("i").over(whole) + 1).withColumn("__t", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("__p", F.col("i") + F.col("__t") * F.col("__n"))
    own = Window.partitionBy(key).orderBy("__p").rowsBetween(-before, size - before - 1)
    return wide.withColumn("s", F.get(F.sort_array(F.collect_list(value).over(own)), F.lit(before))).filter("__t = 0").select(key, "i", F.col("s").alias("v"))


def spread(df: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, spread): of the distances to the median, what the larger half reaches beyond the middle one, weighted by both.

    With n distances, the middle one of rank h = (n div 2) made odd being d and the largest e: (n - h) (e - d) (d + 1) div 2 h.
    """
    n, h = F.col("__n"), F.expr("(__n div 2) | 1")
    order = Window.partitionBy(key).orderBy(value)
    mid = df.withColumns({"__k": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))}).filter(F.col("__k") == F.least(h, n)).select(key, F.col(value).alias("__m"))
    away = df.join(mid, key).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    ranked = away.withColumns({"__k": F.row_number().over(Window.partitionBy(key).orderBy("__d")), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    found = ranked.groupBy(key, "__n").agg(F.max(F.when(F.col("__k") == F.least(h, n), F.col("__d"))).alias("d"), F.max("__d").alias("e"))
    return found.select(key, F.expr("((__n - ((__n div 2) | 1)) * (e - d) * (d + 1)) div (2 * ((__n div 2) | 1))").cast("long").alias("spread"))


def masked_median(df: DataFrame, key: str, value: str, bits: int = 9) -> DataFrame:
    """(key, median): of the lowest `bits` bits, the first value whose running count reaches (n div 2) made odd."""
    return histograms.median(df.withColumn("__v", F.col(value).bitwiseAND((1 << bits) - 1)), key, "__v")


def positive_mean(df: DataFrame, key: str, value: str = "v") -> DataFrame:
    """(key, mean, deviation): of the values above 0, the mean, rounded, and the standard deviation; 0 and 1000 if there are none."""
    p = F.when(F.col(value) > 0, F.col(value).cast("long"))
    s = df.groupBy(key).agg(F.count(p).alias("n"), F.coalesce(F.sum(p), F.lit(0)).alias("m"), F.coalesce(F.sum(p * p), F.lit(0)).alias("q"))
    return s.select(key, F.when(F.col("n") > 0, F.expr("(m + n div 2) div greatest(1, n)")).otherwise(0).cast("int").alias("mean"), F.round(F.when(F.col("n") > 0, F.sqrt(F.expr("cast(n * q - m * m as double)")) / F.col("n")).otherwise(1000.0), 5).alias("deviation"))


def chess_crosses(eroded: DataFrame, dilated: DataFrame, half: int, falling: bool) -> DataFrame:
    """How far two opposite corners of the square around a pixel are darker than the other two, less the largest difference between opposite corners.

    Corners a b / c d, each with the smallest (eroded) and largest (dilated) value around it. Rising: least of what a and d in the eroded image are
    above b and c in the dilated one; falling: b and c above a and d. Never below 0; a border of `half` pixels is 0.
    """
    df = eroded.join(dilated.withColumnRenamed("v", "w"), ["img_id", "y", "x"])
    for c in ("v", "w"):
        df = df.withColumns({f"{c}l": at(c, -half, along()), f"{c}r": at(c, half, along())})
        df = df.withColumns({f"{c}a": at(f"{c}l", -half, down()), f"{c}b": at(f"{c}r", -half, down()), f"{c}c": at(f"{c}l", half, down()), f"{c}d": at(f"{c}r", half, down())})
    dark, light = (("b", "c"), ("a", "d")) if falling else (("a", "d"), ("b", "c"))
    least = F.least(*(F.col(f"v{p}") - F.col(f"w{q}") for p in dark for q in light))
    most = F.greatest(*(F.abs(F.col(f"v{p}") - F.col(f"w{q}")) for p, q in (("a", "d"), ("d", "a"), ("b", "c"), ("c", "b"))))
    return pixels(df, F.coalesce(F.greatest(F.lit(0), least - most), F.lit(0)))


# The smoothing weights, and what the second pass is divided by.
SMOOTH, SMOOTH_DIVISOR = [1, 4, 6, 4, 1], 4


def smoothed(df: DataFrame, vertical: bool, divisor: int | None = None) -> DataFrame:
    """1 4 6 4 1 along rows or down columns; beyond the edge the image is mirrored, the edge pixel included."""
    over = down() if vertical else along()
    ahead = [at("v", k, over) for k in range(-2, 3)]
    # The place one before the first is the first itself, two before it the second; at the second, two before is the first.
    one_back, one_on = F.coalesce(ahead[1], F.col("v")), F.coalesce(ahead[3], F.col("v"))
    two_back = F.coalesce(ahead[0], F.when(ahead[1].isNull(), at("v", 1, over)).otherwise(ahead[1]))
    two_on = F.coalesce(ahead[4], F.when(ahead[3].isNull(), at("v", -1, over)).otherwise(ahead[3]))
    total = sum((c * w for c, w in zip((one_back, F.col("v"), one_on, two_on), SMOOTH[1:], strict=True)), two_back * SMOOTH[0])
    out = df.withColumn("s", total)
    return pixels(out, F.expr(f"s div {divisor}") if divisor else F.col("s"))


def smoothed_twice(df: DataFrame) -> DataFrame:
    return smoothed(smoothed(df, False), True, SMOOTH_DIVISOR)


def slopes(df: DataFrame, least: int) -> DataFrame:
    """(img_id, y, x, gx, gy, len, dir) of a smoothed image: differences of neighbours (the pixel itself beyond the edge), an approximate length, and
    127 where the horizontal part is larger, -127 where it isn't, 0 below `least`."""
    side = lambda by, over: F.coalesce(at("v", by, over), F.col("v"))
    g = df.withColumns({"gx": side(1, along()) - side(-1, along()), "gy": side(1, down()) - side(-1, down())}).withColumns({"ax": F.abs("gx"), "ay": F.abs("gy")})
    length = F.expr("cast(ax + ay + case when ax > 2 * ay then ax div 3 when ay > 2 * ax then ay div 3 else 0 end as int)")
    g = g.withColumn("len", length)
    return g.select("img_id", "y", "x", "gx", "gy", "len", F.when(F.col("len") < least, 0).when(F.col("ax") > F.col("ay"), 127).otherwise(-127).alias("dir"))


def anchors(g: DataFrame, step_y: int, step_x: int, lead: int = 2) -> DataFrame:
    """(img_id, y, x, len, dir): of slopes(), every step_y-th row's every step_x-th pixel whose length exceeds both neighbours across its edge by more than `lead`.

    Rows and columns start at half a step, one at least; the border has none.
    """
    ends = Window.partitionBy("img_id")
    n = g.withColumns({"l": at("len", -1, along()), "r": at("len", 1, along()), "u": at("len", -1, down()), "d": at("len", 1, down()), "h": F.max("y").over(ends), "w": F.max("x").over(ends)})
    first_y, first_x = max(1, step_y // 2), max(1, step_x // 2)
    inside = n.filter(f"dir <> 0 and y >= {first_y} and x >= {first_x} and (y - {first_y}) % {step_y} = 0 and (x - {first_x}) % {step_x} = 0 and y < h and x < w")
    over = lambda a, b: (F.col("len") > F.col(a) + lead) & (F.col("len") > F.col(b) + lead)
    return inside.filter(F.when(F.col("dir") < 0, over("u", "d")).otherwise(over("l", "r"))).select("img_id", "y", "x", "len", "dir")
