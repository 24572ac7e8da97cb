"""Moving pixels: pyramids, half frames, crops, mirrors, sums over rectangles, scaling and polar unwrapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, column, down, whole, row, at, last
from .filters import pixels


def blocks(df: DataFrame, size: int, bias: int, divisor: int, even_rows: bool = False) -> DataFrame:
    """One pixel for each size x size block: (sum + bias) div divisor, of all rows or of the even ones only. Parts of blocks at the edge go."""
    inside = df.withColumn("__w", F.max("x").over(whole()) + 1).withColumn("__h", F.max("y").over(whole()) + 1).filter(f"x < (__w div {size}) * {size} and y < (__h div {size}) * {size}")
    if even_rows:
        inside = inside.filter("y % 2 = 0")
    sums = inside.groupBy("img_id", F.expr(f"cast(y div {size} as int)").alias("y"), F.expr(f"cast(x div {size} as int)").alias("x")).agg(F.sum("v").alias("s"))
    return pixels(sums, F.expr(f"(s + {bias}) div {divisor}"))


def every_second(df: DataFrame) -> DataFrame:
    return df.filter("x % 2 = 0 and y % 2 = 0").select("img_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), "v")


def doubled(df: DataFrame) -> DataFrame:
    """Each pixel four times."""
    two = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1))
    return df.select("img_id", "v", "y", two("x").alias("x")).select("img_id", "v", "x", two("y").alias("y")).select("img_id", "y", "x", "v")


def doubled_smooth(df: DataFrame) -> DataFrame:
    """Twice as wide and high; new pixels are the means of two or four neighbours, at the far edges of what there is."""
    right, below, both = at("v", 1, along()), at("v", 1, down()), at("r", 1, down())
    out = df.withColumn("r", right).withColumn("b", below).withColumn("d", both).withColumns({"lone_r": F.col("r").isNull(), "lone_b": F.col("b").isNull()})
    v = F.col("v")
    a00 = v
    a01 = F.when(F.col("lone_r"), v).otherwise(F.expr("(v + r) div 2"))
    a10 = F.when(F.col("lone_b"), v).otherwise(F.expr("(v + b) div 2"))
    a11 = F.when(F.col("lone_r") & F.col("lone_b"), v).when(F.col("lone_r"), F.expr("(v + b) div 2")).when(F.col("lone_b"), F.expr("(v + r) div 2")).otherwise(F.expr("(v + r + b + d) div 4"))
    a11 = F.when(~F.col("lone_r") & ~F.col("lone_b"), F.expr("(v + r + b + d + 1) div 4")).otherwise(a11)
    part = lambda dy, dx, c: F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), c.cast("int").alias("w"))
    four = F.explode(F.array(part(0, 0, a00), part(0, 1, a01), part(1, 0, a10), part(1, 1, a11))).alias("p")
    return out.select("img_id", "y", "x", four).select("img_id", (2 * F.col("y") + F.col("p.dy")).alias("y"), (2 * F.col("x") + F.col("p.dx")).alias("x"), F.col("p.w").alias("v"))


def integral(df: DataFrame) -> DataFrame:
    """Sum of all pixels above and left, inclusive."""
    out = df.withColumn("s", F.sum("v").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("s", F.sum("s").over(down().rowsBetween(Window.unboundedPreceding, 0))).select("img_id", "y", "x", F.col("s").cast("long").alias("v"))


def _height() -> Column:
    return last("y", column()) + 1


def split_half_frames(df: DataFrame) -> DataFrame:
    """Even rows first, then the odd ones."""
    out = df.withColumn("h", _height())
    return out.select("img_id", F.expr("cast(y div 2 + (y % 2) * ((h + 1) div 2) as int)").alias("y"), "x", "v")


def combine_half_frames(df: DataFrame) -> DataFrame:
    out = df.withColumn("h", _height())
    return out.select("img_id", F.expr("cast(case when y < (h + 1) div 2 then 2 * y else 2 * (y - (h + 1) div 2) + 1 end as int)").alias("y"), "x", "v")


def interpolate_odd_rows(df: DataFrame, copy: bool = False) -> DataFrame:
    """Odd rows become the mean of the even ones around them, or a copy of the one before; a last odd row is a copy."""
    before, after = at("v", -1, down()), at("v", 1, down())
    out = df.withColumn("b", before).withColumn("a", after)
    new = F.col("b") if copy else F.when(F.col("a").isNull(), F.col("b")).otherwise(F.expr("(a + b) div 2"))
    return pixels(out, F.when(F.col("y") % 2 == 1, new).otherwise(F.col("v")))


def crop_centre(df: DataFrame, h: int, w: int, yc: int, xc: int) -> DataFrame:
    """h x w pixels around (yc, xc), moved inside if they would stand out."""
    out = df.withColumn("x0", F.least(F.greatest(F.lit(0), F.lit(xc - w // 2)), last("x", row()) + 1 - w)).withColumn("y0", F.least(F.greatest(F.lit(0), F.lit(yc - h // 2)), _height() - h))
    return out.filter(f"x >= x0 and x < x0 + {w} and y >= y0 and y < y0 + {h}").select("img_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")


def mirror_x(df: DataFrame) -> DataFrame:
    return df.select("img_id", "y", (last("x", row()) - F.col("x")).alias("x"), "v")


def mirror_y(df: DataFrame) -> DataFrame:
    return df.select("img_id", (last("y", column()) - F.col("y")).alias("y"), "x", "v")


def transpose(df: DataFrame) -> DataFrame:
    return df.select("img_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def gathered(df: DataFrame, places: DataFrame) -> DataFrame:
    """Bilinear values at places (img_id, y, x, sy, sx); outside the image they are 0. One equi-join with the four pixels around each place."""
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))).alias("k")
    p = places.withColumns({"y0": F.floor("sy").cast("int"), "x0": F.floor("sx").cast("int")}).withColumns({"fy": F.col("sy") - F.col("y0"), "fx": F.col("sx") - F.col("x0")}).select("*", around)
    weight = F.when(F.col("k.dy") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.dx") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    p = p.select("img_id", "y", "x", (F.col("y0") + F.col("k.dy")).alias("py"), (F.col("x0") + F.col("k.dx")).alias("px"), weight.alias("w"))
    near = p.join(df.select("img_id", F.col("y").alias("py"), F.col("x").alias("px"), "v"), ["img_id", "py", "px"], "left")
    return near.groupBy("img_id", "y", "x").agg(F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0))), 6).alias("v"))


def affine(df: DataFrame, matrix: tuple[float, ...]) -> DataFrame:
    """Each pixel (y, x) becomes the bilinear value at (a y + b x + c, d y + e x + f)."""
    a, b, c, d, e, f = matrix
    return gathered(df, df.select("img_id", "y", "x", (a * F.col("y") + b * F.col("x") + c).alias("sy"), (d * F.col("y") + e * F.col("x") + f).alias("sx")))


def polar(df: DataFrame, yc: float, xc: float, angles: int, radii: int, first: float) -> DataFrame:
    """Rows are angles, columns radii from `first` on, one pixel apart."""
    images = df.select("img_id").distinct()
    phi = 2 * math.pi * F.col("y") / angles
    places = images.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("y")).select("img_id", "y", F.explode(F.sequence(F.lit(0), F.lit(radii - 1))).alias("x"))
    return gathered(df, places.withColumns({"sy": yc + (first + F.col("x")) * F.sin(phi), "sx": xc + (first + F.col("x")) * F.cos(phi)}))


def resampled_frames(df: DataFrame, frames: int, shift: int = 0) -> DataFrame:
    """A sequence of frames (img_id in order) resampled to `frames` frames; first and last meet.

    Rows of a frame are of two half frames, the even ones earlier: output row y of frame f stands at time (2 f + y % 2) of 2 frames - 1 steps and mixes
    the two source frames around it. shift brightens by twice its value, within 0 to 255.
    """
    order = Window.partitionBy("y", "x").orderBy("img_id")
    src = df.withColumns({"i": F.row_number().over(order) - 1, "b": F.lead("v").over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("y", "x"))})
    last_half = 2 * frames - 1
    # Half frame k lies at k (n - 1) / last_half; a source frame answers those of [i, i + 1) that belong to its row.
    k = F.explode(F.filter(F.sequence(F.expr(f"cast(ceil(i * {last_half}D / greatest(1, n - 1)) as int)"), F.expr(f"cast(least({last_half}, ceil((i + 1) * {last_half}D / greatest(1, n - 1)) - 1) as int)")), lambda h: h % 2 == F.col("y") % 2))
    inside = src.filter(F.expr(f"ceil(i * {last_half}D / greatest(1, n - 1)) <= least({last_half}, ceil((i + 1) * {last_half}D / greatest(1, n - 1)) - 1)")).withColumn("k", k)
    f = F.col("k") * (F.col("n") - 1) / F.lit(float(last_half)) - F.col("i")
    value = F.when(F.col("b").isNull(), F.col("v")).otherwise(F.floor(F.col("v") * (1 - f) + F.col("b") * f + F.lit(0.5 + 1e-9)))
    return inside.select(F.expr("cast(k div 2 as int)").alias("img_id"), "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), value + 2 * shift)).cast("int").alias("v"))


def blocks_of_four(df: DataFrame, y: int, x: int, h: int, w: int) -> DataFrame:
    """(img_id, y, x, v): h x w means of 4 x 4 pixels, of their first and third rows, from (y, x) on; sizes are rounded up to fours, blocks that leave the image are 0."""
    h, w = (-(-n // 4) * 4 for n in (h, w))
    images = df.groupBy("img_id").agg((F.max("y") + 1).alias("ih"), (F.max("x") + 1).alias("iw"))
    grid = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    inside = df.filter((F.col("y") >= y) & (F.col("x") >= x) & ((F.col("y") - y) % 2 == 0))
    sums = inside.groupBy("img_id", F.expr(f"cast((y - {y}) div 4 as int)").alias("y"), F.expr(f"cast((x - {x}) div 4 as int)").alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    met = grid.join(sums, ["img_id", "y", "x"], "left")
    whole_block = (y + 4 * F.col("y") >= 0) & (x + 4 * F.col("x") >= 0) & (F.col("n") == 8)
    return met.select("img_id", "y", "x", F.when(whole_block, F.expr("(s + 3) div 8")).otherwise(0).cast("int").alias("v"))


def resampled_frames_timed(df: DataFrame, frames: int, time: str = "t", shift: int = 0) -> DataFrame:
    """resampled_frames() for frames taken at times of their own, which rise from 0 on: output half frame k stands at the k-th of 2 frames even times and mixes the two
    source frames around it. Repeated times are an error."""
    order = Window.partitionBy("y", "x").orderBy(time)
    last_half = 2 * frames - 1
    src = df.withColumns({"t2": F.lead(time).over(order), "b": F.lead("v").over(order), "t0": F.min(time).over(Window.partitionBy("y", "x")), "t1": F.max(time).over(Window.partitionBy("y", "x"))})
    src = src.withColumn("t2", F.when(F.col("t2") == F.col(time), F.raise_error(F.lit("times must rise"))).otherwise(F.col("t2"))).filter("t1 > t0")
    # A half frame's time is k (t1 - t0) / last_half; a source frame answers those from its own time to the next.
    place = lambda c: F.ceil((F.col(c) - F.col("t0")) * last_half / (F.col("t1") - F.col("t0")) - 1e-9).cast("int")
    span = F.when(F.col("t2").isNull(), F.array(F.lit(last_half))).when(place(time) <= place("t2") - 1, F.sequence(place(time), F.least(F.lit(last_half - 1), place("t2") - 1)))
    k = src.withColumn("k", F.explode(span)).filter("k % 2 = y % 2")
    f = (F.col("t0") + F.col("k") * (F.col("t1") - F.col("t0")) / last_half - F.col(time)) / (F.col("t2") - F.col(time))
    value = F.when(F.col("t2").isNull(), F.col("v")).otherwise(F.floor(F.col("v") * (1 - f) + F.col("b") * f + F.lit(0.5 + 1e-9)))
    return k.select(F.expr("cast(k div 2 as int)").alias("img_id"), "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), value + 2 * shift)).cast("int").alias("v"))
