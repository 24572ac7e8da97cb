"""Polar images between two circles: rubber sheets, their variants and the lines that they follow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectral import cosine
from .transport import gathered

# The rays' vertical half axes as shares of the radii, and pi as the rubber sheet takes it.
INNER, OUTER, PI = 0.94, 0.95, 3.141592653589

#: (x, y, radius)
Circle = tuple[int, int, int]


def rays(df: DataFrame, lines: int, steps: int) -> DataFrame:
    """(img_id, a, i, w, h) for each image, angle and step, with the image's size."""
    images = df.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return images.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))


def carried(found: DataFrame) -> DataFrame:
    """Places outside take the value before them, by angle and step; before the first it is 0."""
    order = Window.partitionBy("img_id").orderBy("a", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(order), F.lit(0)))


def ends(inner: Circle, outer: Circle, lines: int) -> dict[str, Column]:
    """Columns x1, y1 on the inner and x2, y2 on the outer boundary for angle `a`, from the top counterclockwise."""
    angle = 2.0 * PI / lines * F.col("a") + PI / 2
    return {
        "x1": F.cos(angle) * inner[2] + inner[0], "y1": -F.sin(angle) * inner[2] * INNER + inner[1], "x2": F.cos(angle) * outer[2] + outer[0], "y2": -F.sin(angle) * outer[2] * OUTER + outer[1],
    }


def rubber_places(df: DataFrame, inner: Circle, outer: Circle, lines: int, steps: int) -> DataFrame:
    """(img_id, a, i, sy, sx): the pixel of each place; null outside the image's inner part."""
    at = rays(df, lines, steps).withColumns(ends(inner, outer, lines))
    at = at.withColumns({c: F.expr(f"cast(({c}1 * ({steps} - i) + {c}2 * i) / {steps} + 0.5D as int)") for c in ("x", "y")})
    inside = F.expr("y >= 1 and y < h - 1 and x >= 1 and x < w - 1")
    return at.select("img_id", "a", "i", F.when(inside, F.col("y")).alias("sy"), F.when(inside, F.col("x")).alias("sx"))


def rubber(df: DataFrame, inner: Circle, outer: Circle, lines: int, steps: int, upright: bool = False) -> DataFrame:
    """(img_id, y, x, v): rows are angles and columns steps from the inner to the outer circle, or the other way round (upright)."""
    src = df.select("img_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    found = carried(rubber_places(df, inner, outer, lines, steps).join(src, ["img_id", "sy", "sx"], "left"))
    y, x = ("i", "a") if upright else ("a", "i")
    return found.select("img_id", F.col(y).alias("y"), F.col(x).alias("x"), "v")


def rubber_lines(df: DataFrame, inner: Circle, outer: Circle, lines: int = 256, steps: int = 32, every: int = 4) -> DataFrame:
    """The image with every fourth place of the rubber sheet set to 255."""
    marks = rubber_places(df, inner, outer, lines, steps).filter(f"i % {every} = 0 and sy is not null").select("img_id", F.col("sy").alias("y"), F.col("sx").alias("x"), F.lit(255).alias("m")).distinct()
    return df.join(marks, ["img_id", "y", "x"], "left").select("img_id", "y", "x", F.coalesce("m", "v").alias("v"))


def interpolated(df: DataFrame, at: DataFrame) -> DataFrame:
    """Bilinear values, rounded, at (img_id, a, i, h, w, px, py); places outside the inner part take the value before them."""
    inside = at.filter("py >= 1 and py < h - 1 and px >= 1 and px < w - 1")
    values = gathered(df, inside.select("img_id", F.col("a").alias("y"), F.col("i").alias("x"), F.col("py").alias("sy"), F.col("px").alias("sx")))
    values = values.select("img_id", F.col("y").alias("a"), F.col("x").alias("i"), F.floor(F.col("v") + 0.5).cast("int").alias("v"))
    return carried(at.select("img_id", "a", "i").join(values, ["img_id", "a", "i"], "left")).select("img_id", F.col("a").alias("y"), F.col("i").alias("x"), "v")


def rubber_power(df: DataFrame, inner: Circle, outer: Circle, lines: int, steps: int, power: float) -> DataFrame:
    """A rubber sheet whose steps grow as a power of their place."""
    share = F.pow(F.col("i") / steps, F.lit(power))
    at = rays(df, lines, steps).withColumns(ends(inner, outer, lines)).withColumn("s", share)
    return interpolated(df, at.withColumns({"px": F.expr("x1 * (1 - s) + x2 * s"), "py": F.expr("y1 * (1 - s) + y2 * s")}))


def rubber_stretched(df: DataFrame, inner: Circle, outer: Circle, lines: int, steps: int, share: float) -> DataFrame:
    """A rubber sheet that follows tissue of a pupil that fills `share` of the iris when at rest."""
    (xc, yc, rc), (xi, yi, ri) = inner, outer
    now = rc / ri
    rest = (share - now) * now / (1 - now)
    angle = 2.0 * PI / lines * F.col("a") + PI / 2
    at = rays(df, lines, steps).withColumns({"c": F.cos(angle), "s": F.sin(angle), "d": F.lit(rest) + share + (1 - share) * F.pow(F.col("i") / steps, F.lit(1.5))})
    at = at.withColumn("ro", (F.col("d") + F.sqrt(F.col("d") * F.col("d") - 4 * rest)) / 2)
    along = F.col("ro") * ri - rc
    px = xc - (rc * F.col("c") + along * (F.col("c") + (xc - xi) / (ri - rc)))
    py = yc - (rc * F.col("s") + along * (F.col("s") * (ri * OUTER - rc) / (ri - rc) + (yc - yi) / (ri - rc)))
    return interpolated(df, at.withColumns({"px": px, "py": py}))


def unwrapped_between(df: DataFrame, pupil: Circle, iris: Circle, angles: int, radii: int) -> DataFrame:
    """(img_id, y, x, v): the ring between two circles of different centres; columns are angles, rows radii, the outermost first. 0 outside the image.

    The far end of a ray is iris centre + f (sin, cos) + sqrt(R^2 - f) (cos, sin), f being the offset of the centres across the ray.
    """
    (xp, yp, rp), (xi, yi, ri) = pupil, iris
    angle = F.col("a") * 2 * math.pi / angles
    at = rays(df, angles, radii).withColumns({"c": F.cos(angle), "s": F.sin(angle)})
    at = at.withColumn("f", (xp - xi) * F.col("s") - (yp - yi) * F.col("c")).withColumn("q", F.sqrt(ri * ri - F.col("f")))
    at = at.withColumns({"bx": xp + rp * F.col("c"), "by": yp + rp * F.col("s"), "ex": xi + F.col("f") * F.col("s") + F.col("q") * F.col("c"), "ey": yi + F.col("f") * F.col("c") + F.col("q") * F.col("s")})
    at = at.withColumns({"px": F.expr(f"bx + (ex - bx) / {radii} * (i + 0.5D)"), "py": F.expr(f"by + (ey - by) / {radii} * (i + 0.5D)")})
    inside = at.filter("px >= 0 and px < w - 1 and py >= 0 and py < h - 1")
    values = gathered(df, inside.select("img_id", F.col("a").alias("y"), F.col("i").alias("x"), F.col("py").alias("sy"), F.col("px").alias("sx"))).select("img_id", F.col("y").alias("a"), F.col("x").alias("i"), "v")
    found = at.select("img_id", "a", "i").join(values, ["img_id", "a", "i"], "left")
    return found.select("img_id", (radii - 1 - F.col("i")).alias("y"), F.col("a").alias("x"), F.coalesce(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v")))), F.lit(0)).cast("int").alias("v"))


def unwrapped_fixed(df: DataFrame, centre: tuple[int, int], radii: tuple[int, int], angles: tuple[float, float], height: int, width: int, first: int = 0) -> DataFrame:
    """(img_id, y, x, v): rows are angles, columns radii of one circle, in whole numbers; a place outside takes the value before it in its row, or `first`."""
    (cx, cy), (r0, r1), (a0, a1) = centre, radii, angles
    short = lambda c: F.call_function("div", c, F.lit(256))
    turn = F.floor((F.lit(a0) + F.col("id") * (a1 - a0) / height) * (1 << 20)).cast("long")
    # One row an angle, joined rather than computed in each place.
    turns = df.sparkSession.range(height).select(F.col("id").cast("int").alias("a"), short(cosine(turn)).alias("c"), short(cosine(turn - 1647099)).alias("s"))
    at = rays(df, height, width).join(F.broadcast(turns), "a").withColumn("r", 256 * r0 + F.expr(f"256 * i * {r1 - r0} div {width}"))
    at = at.withColumns({"xx": 256 * cx + F.shiftright(F.col("r") * F.col("c"), 12), "yy": 256 * cy - F.shiftright(F.col("r") * F.col("s"), 12)})
    at = at.withColumns({"x": F.shiftright("xx", 8).cast("int"), "y": F.shiftright("yy", 8).cast("int"), "kx": F.col("xx").bitwiseAND(255), "ky": F.col("yy").bitwiseAND(255)})
    four = F.explode(F.array(*(F.struct(F.lit(j).alias("dy"), F.lit(k).alias("dx")) for j in (0, 1) for k in (0, 1)))).alias("k")
    weight = F.when(F.col("k.dy") == 1, F.col("ky")).otherwise(256 - F.col("ky")) * F.when(F.col("k.dx") == 1, F.col("kx")).otherwise(256 - F.col("kx"))
    inside = at.filter("x >= 0 and x < w - 1 and y >= 0 and y < h - 1").select("img_id", "a", "i", "x", "y", "kx", "ky", four).select("img_id", "a", "i", weight.alias("wt"), (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"))
    values = inside.join(df, ["img_id", "y", "x"]).groupBy("img_id", "a", "i").agg(F.shiftright(F.sum(F.col("wt") * F.col("v")), 16).cast("int").alias("v"))
    line = Window.partitionBy("img_id", "a").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = at.select("img_id", "a", "i").join(values, ["img_id", "a", "i"], "left").withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(line), F.lit(first)))
    return found.select("img_id", F.col("a").alias("y"), F.col("i").alias("x"), "v")
